"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Vectors are taken as whole numbers, so sums and deviations are exact. Equal vectors are
one, combined before and after the shuffle. Tasks add up the scatter of the centred vectors,
and d x d numbers are all that leaves them: their size is the square of the vectors'
width, whatever the number of rows. The driver factors that matrix by Cholesky with
pivots, and turns the columns of the factor by Jacobi rotations from one side until they
are orthogonal. Their squared norms are the eigenvalues, and the columns at norm one are the
components; neither the scatter's rounding is squared again nor a second matrix made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, column_of, free_name, staged

by_value(__name__)

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
# Vectors may have at most this many entries: d x d doubles come to the driver.
MAX_WIDTH = 4096
# Whole numbers beyond this aren't taken: 64 times a component has to stay exact and within a long.
LIMIT = 1 << 61
MAX_SWEEPS = 60
_LOW = (1 << 32) - 1


# --- factors ----------------------------------------------------------------


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """L with L L' = ``matrix``; its rows, in the order of the pivots, are lower triangular.

    As many columns as the matrix has rank, to double precision.
    """
    rest = np.diag(matrix).copy()
    least = len(rest) * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros_like(matrix)
    done = np.zeros(len(rest), bool)
    for k in range(len(rest)):
        pivot = int(np.where(done, -1.0, rest).argmax())
        if done[pivot] or rest[pivot] <= least:
            return factor[:, :k]
        done[pivot] = True
        column = matrix[:, pivot] - factor[:, :k] @ factor[pivot, :k]
        root = np.sqrt(rest[pivot])
        factor[:, k] = np.where(done, 0.0, column / root)
        factor[pivot, k] = root
        rest = np.where(done, 0.0, rest - factor[:, k] ** 2)
    return factor


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``n`` columns, in rounds of disjoint ones."""
    ring = list(range(n + n % 2))
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(min(p), max(p)) for p in zip(ring[:half], reversed(ring[half:])) if max(p) < n]
        yield np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi_columns(factor: np.ndarray) -> np.ndarray:
    """``factor`` times rotations, with orthogonal columns."""
    columns = np.array(factor, float)
    n = columns.shape[1]
    rounds = list(_rounds(n)) if n > 1 else []
    for _ in range(MAX_SWEEPS):
        turned = False
        for p, q in rounds:
            a, b = columns[:, p], columns[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            far = np.abs(gamma) > np.finfo(float).eps * np.sqrt(alpha * beta)
            if not far.any():
                continue
            turned = True
            zeta = (beta - alpha) / np.where(far, 2 * gamma, 1.0)
            tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cosine = np.where(far, 1 / np.hypot(1.0, tangent), 1.0)
            sine = np.where(far, cosine * tangent, 0.0)
            columns[:, p], columns[:, q] = cosine * a - sine * b, sine * a + cosine * b
        if not turned:
            break
    return columns


@dataclass
class Whitening:
    """n vectors of sums ``total``; eigenvalues by falling size, components as columns."""

    n: int
    total: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.total)


def factored(n: int, total: list[int], scatter: np.ndarray) -> Whitening:
    covariance = scatter / n if n else scatter
    turned = jacobi_columns(pivoted_cholesky(covariance))
    values = (turned * turned).sum(0)
    order = np.argsort(-values, kind="stable")
    values, components = values[order], turned[:, order] / np.sqrt(values[order])
    # Either sign is right; the largest entry decides.
    lead = components[np.abs(components).argmax(0), np.arange(len(values))] if len(values) else values
    return Whitening(n, total, values, components * np.where(lead < 0, -1.0, 1.0), float(np.trace(covariance)))


# --- whole numbers ----------------------------------------------------------


def whole(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """The vector's entries as longs, or null if it is null or empty, or any entry has none."""
    entries = F.transform(vector.cast("array<double>"), lambda c: F.floor(c * scale) + offset)
    good = F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & (F.abs(c) <= LIMIT / scale))
    return F.when((F.size(vector) > 0) & good, entries)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    lists = column_of(batch, name)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums, by halves of the numbers so that no sum leaves a long."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch)
        high, low = (x >> 32).sum(0), (x & _LOW).sum(0)
        at = pa.array(np.arange(x.shape[1]))
        n = pa.array(np.full(x.shape[1], len(x)))
        yield pa.RecordBatch.from_arrays([at, n, pa.array(high), pa.array(low)], ["at", "n", "high", "low"])


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n: the whole part as whole numbers, the rest as a double."""
    whole_part = np.array([t // n for t in total], np.int64)
    rest = np.array([t % n / n for t in total])
    return (x - whole_part).astype(float) - rest


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over entries of (n x - S)^2, exact; null beyond a long."""
    whole_part = np.array([t // n for t in total], np.int64)
    rest = np.array([t % n for t in total], object)
    y = x - whole_part
    if len(y) and (int(np.abs(y).max()) + 1) ** 2 * n**2 * len(total) < 1 << 63:
        return ((n * y - rest.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((n * y.astype(object) - rest) ** 2).sum(1).tolist()
    return [d if d < 1 << 63 else None for d in exact]


def _products(of_batch):
    """Sum of z'z over a partition, one row an entry; ``of_batch`` makes z."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = of_batch(batch)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None and total.size:
            i, j = np.indices(total.shape)
            arrays = [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "product"])

    return summed


def _gathered(rows: DataFrame, of_batch, width: int) -> np.ndarray:
    """Sum of z'z over all rows: width x width numbers."""
    parts = rows.mapInArrow(_products(of_batch), "i long, j long, product double")
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("product").alias("product")).collect():
        out[r["i"], r["j"]] = r["product"]
    return out


# --- operator ---------------------------------------------------------------


def fit(vectors: DataFrame) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the distinct vectors ``x`` (longs), and these; None without any.

    Of vectors of several widths those of the most frequent width count, the larger of equals.
    """
    distinct = staged(vectors.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "distinct-vectors")
    widths = distinct.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    most = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return None
    if most["width"] > MAX_WIDTH:
        raise ValueError(f"vectors of {most['width']} entries; {MAX_WIDTH} at most")
    fitted = distinct.where(F.size("x") == most["width"])
    halves = fitted.mapInArrow(_added, "at long, n long, high long, low long").groupBy("at")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    sums = {r["at"]: r for r in halves.agg(F.sum("n").alias("n"), *exact).collect()}
    n = sums[0]["n"]
    total = [(int(sums[i]["high"]) << 32) + int(sums[i]["low"]) for i in range(most["width"])]
    scatter = _gathered(fitted, lambda batch: _centred(_matrix(batch), n, total), most["width"])
    return factored(n, total, scatter), fitted


def _projected(x: np.ndarray, model: Whitening, upto: int) -> np.ndarray:
    return _centred(x, model.n, model.total) @ model.components[:, :upto] / np.sqrt(model.values[:upto])


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, output: str = "whitened") -> DataFrame:
    """``df`` with a struct ``output``: n, deviation, whitened, explained, identity_error.

    ``whitened`` and ``explained`` are arrays with an entry for each component, by falling
    eigenvalue; there are ``components`` of them, or as many as the covariance has rank.
    ``deviation`` is null where it is beyond a long.

    Vectors that are null or empty, or hold a null or non-finite entry or one beyond
    2^55, take no part; neither do those of another width than most distinct ones have.
    Their ``output`` is null. Copies count once in the fit and are whitened each. With no
    usable vector every ``output`` is null; where all are equal, no component exists and
    the arrays are empty. A column that has the name ``output`` already gives the new one
    underscores at its end.
    """
    x = free_name(df, "x")
    name = free_name(df, output)
    rows = df.withColumn(x, whole(F.col(vector_col)))
    found = fit(rows.where(F.col(x).isNotNull()).select(F.col(x).alias("x")))
    kind = "struct<n: long, deviation: long, whitened: array<double>, explained: array<double>, identity_error: double>"
    if found is None:
        return rows.drop(x).withColumn(name, F.lit(None).cast(kind))
    model, fitted = found
    upto = min(components, len(model.values))
    error = 0.0
    if upto:
        squares = _gathered(fitted, lambda batch: _projected(_matrix(batch), model, upto), upto)
        error = float(np.abs(squares / model.n - np.eye(upto)).max())
    explained = (model.values[:upto] / model.trace).tolist() if upto else []

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column_of(batch, x)
            use = np.asarray(lists.value_lengths().fill_null(0)) == model.width
            n, place = len(lists), np.cumsum(use) - 1
            part = lists.filter(pa.array(use))
            numbers = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, model.width)
            z = _projected(numbers, model, upto)
            deviation = _deviation(numbers, model.n, model.total)
            out = [
                {"n": model.n, "deviation": deviation[p], "whitened": z[p], "explained": explained, "identity_error": error} if u else None
                for u, p in zip(use.tolist(), place.tolist())
            ]
            fields = pa.struct([("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())])
            columns = [c for c, f in zip(batch.columns, batch.schema.names) if f != x]
            assert n == len(out)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, fields)], [*(f for f in batch.schema.names if f != x), name])

    schema = df.withColumn(name, F.lit(None).cast(kind)).schema
    return rows.mapInArrow(whitened, schema)


def whitening_report(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    found = F.col("found")
    rows = whiten(vectors.select("vec_id", "embedding"), output="found").where(found.isNotNull())
    entries = F.posexplode(F.arrays_zip(found["whitened"].alias("z"), found["explained"].alias("e"))).alias("at", "entry")
    flat = rows.select("vec_id", found["n"].alias("n"), found["deviation"].alias("deviation"), found["identity_error"].alias("identity_error"), entries)
    return flat.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("entry.z").alias("whitened"), F.col("entry.e").alias("explained"), "identity_error",
    )
