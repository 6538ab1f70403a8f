"""Exact nearest neighbours of question vectors in a chunk index.

Two ways, chosen by the measured size of the index; both give the same rows.

* A small index is shipped once to every worker and questions stream past it.
  Questions are not shuffled at all.
* A large index is cut, once when it is opened, into cells around pivot vectors (a k-nearest-neighbour
  join in the manner of Lu et al., PVLDB 2012). A question first searches the
  cell of its nearest pivot; the k-th distance found there rules out every cell
  that the triangle or bisector inequality puts farther away, and only the
  remaining cells are searched. Cells near each other are packed into bins of a
  bounded size, and a question is sent once to each bin that holds a cell it has
  to search, so it is not copied once per cell where the bounds rule out few; in
  the bin, questions of one cell and its neighbours meet the cells that any of
  them has to search. Bins and the questions that visit them are both
  split into blocks of bounded size, so a hot cell spreads over many tasks, and
  a block passes on k rows per question, never its pairs. Of copies of one
  vector only the k lowest ids can be an answer, so the others are left out
  before the search; equal questions are searched once.

Distances are squared L2, summed in component order in doubles; ties go to the
lower chunk id.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .. import lexicon
from ..session import MAX_BROADCAST_BYTES, stage

# Tasks get the functions of this module by value, so workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VECTOR = "embedding"
MAX_PIVOTS = 1024
PIVOT_BYTES = 8 << 20
# Equal vectors that an opened index keeps; a search for more hits cuts it anew.
COPIES = 16
BLOCK_BYTES = 16 << 20
SCRATCH_BYTES = 64 << 20
# Visits that a task hands on at a time, and questions that meet a bin's cells together.
VISIT_BYTES = 8 << 20
TOGETHER = 256
# Shuffle partitions of a search; it takes no more tasks than that.
MAX_TASKS = 2048
# An index row takes at least this much, so more rows than bytes allow are too many.
MIN_ROW_BYTES = 24


# --- per-task kernels -----------------------------------------------------


def _column(table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers with a usable vector, and the vectors as doubles."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    matrix = flat.astype(np.float64).reshape(-1, width)
    finite = np.isfinite(matrix).all(axis=1)
    return rows[finite], matrix[finite]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches short enough to carry k whole texts per row."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _rough(questions: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Squared distances by matrix product; close, but not exact to the bit."""
    q_norm = np.einsum("ij,ij->i", questions, questions)
    c_norm = np.einsum("ij,ij->i", chunks, chunks)
    return q_norm[:, None] + c_norm[None, :] - 2.0 * (questions @ chunks.T)


def _best(
    questions: np.ndarray, chunks: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest chunks of each question: question row, chunk row, distance.

    Chunks must be in id order. The matrix product only preselects, with a
    margin above its rounding error; survivors are measured component by
    component.
    """
    k = min(k, len(chunks))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if k == 0 or len(questions) == 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0)
    by_component = np.ascontiguousarray(chunks.T)
    scale = float(np.einsum("ij,ij->i", chunks, chunks).max())
    step = max(1, SCRATCH_BYTES // (8 * 3 * len(chunks)))
    for low in range(0, len(questions), step):
        part = questions[low : low + step]
        rough = _rough(part, chunks)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        margin = 1e-9 * (1.0 + scale + np.einsum("ij,ij->i", part, part))
        row, hit = np.nonzero(rough <= (kth + margin)[:, None])
        distance = np.zeros(len(row))
        for j, component in enumerate(by_component):
            gap = part[row, j] - component[hit]
            distance += gap * gap
        order = np.lexsort((hit, distance, row))
        row, hit, distance = row[order], hit[order], distance[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row]
        kept = place < k
        found.append((row[kept] + low, hit[kept], distance[kept]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


# --- index measurement ----------------------------------------------------


@dataclass(frozen=True)
class IndexSize:
    rows: int
    width: int
    small: bool


@dataclass(frozen=True)
class Cells:
    """A large index, cut into cells and stored once."""

    chunks: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    bins: np.ndarray
    copies: int


@dataclass(frozen=True)
class OpenIndex:
    """A measured index: shipped to the workers if it is small, cut into cells if not."""

    table: DataFrame
    id_col: str
    size: IndexSize
    shipped: Broadcast | None
    cells: Cells | None = None

    def close(self) -> None:
        """Release the copies that workers hold."""
        if self.shipped is not None:
            self.shipped.destroy()


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all finite: others are no index rows."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def measure(index: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> IndexSize:
    """Rows and vector width, and whether the whole index stays in ``max_bytes``.

    Counting rows of a stored table reads no column. Rows are only sized when
    there are few enough of them for the index to be small at all; then every
    column counts, nested and binary ones by their JSON.
    """
    low, high, rows = index.agg(
        F.min(F.size(VECTOR)), F.max(F.size(VECTOR)), F.count("*")
    ).first()
    if rows == 0:
        return IndexSize(0, 0, True)
    if low != high:
        raise ValueError(f"index vectors differ in width: {low} to {high}")
    if rows * MIN_ROW_BYTES > max_bytes:
        return IndexSize(rows, low, False)
    rest = F.octet_length(F.to_json(F.struct(*_payload(index))))
    total = index.agg(F.sum(rest + 8 * F.size(VECTOR))).first()[0]
    return IndexSize(rows, low, total <= max_bytes)


def open_index(
    index: DataFrame, id_col: str = "chunk_id", max_index_bytes: int = MAX_BROADCAST_BYTES
) -> OpenIndex:
    """Check and measure an index once, for any number of :func:`retrieve` calls.

    Whatever the size, rows without a usable vector are left out, vectors of
    different widths are refused, and so are ids that are NULL or repeated.
    """
    index = index.where(usable(F.col(VECTOR)))
    repeated = index.groupBy(id_col).agg(F.count("*").alias("n"))
    bad = repeated.where((F.col("n") > 1) | F.col(id_col).isNull()).head()
    if bad is not None:
        raise ValueError(f"index id {bad[id_col]!r} stands on {bad['n']} rows")
    size = measure(index, max_index_bytes)
    if size.rows == 0:
        return OpenIndex(index, id_col, size, None)
    if not size.small:
        return OpenIndex(index, id_col, size, None, _cut(index, size, id_col))
    table = index.orderBy(id_col).toArrow()
    shipped = index.sparkSession.sparkContext.broadcast(
        (
            _vectors(_column(table, VECTOR), size.width),
            {c: _column(table, c) for c in _payload(index)},
        )
    )
    return OpenIndex(index, id_col, size, shipped)


# --- small index ----------------------------------------------------------


def _payload(index: DataFrame) -> list[str]:
    return [c for c in index.columns if c != VECTOR]


def _hits_type(index: DataFrame) -> T.ArrayType:
    return T.ArrayType(
        T.StructType(
            [
                T.StructField("rank", T.LongType()),
                T.StructField("distance", T.DoubleType()),
                *(index.schema[c] for c in _payload(index)),
            ]
        )
    )


def _retrieve_small(questions: DataFrame, opened: OpenIndex, k: int) -> DataFrame:
    """Stream questions past the shipped copy of a size-checked index."""
    payload = _payload(opened.table)
    passed = [c for c in questions.columns if c != VECTOR]
    width = opened.size.width
    shipped = opened.shipped

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (chunk_rows, chunks), columns = shipped.value
        for batch in _pieces(batches):
            rows, vectors = _vectors(batch.column(VECTOR), width)
            row, hit, distance = _best(vectors, chunks, k)
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(counts, rows[row], 1)
            offsets = np.concatenate(([0], np.cumsum(counts)))
            rank = np.arange(len(row)) - offsets[rows[row]] + 1
            taken = pa.array(chunk_rows[hit])
            hits = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(rank, pa.int64()), pa.array(distance, pa.float64())]
                    + [columns[c].take(taken) for c in payload],
                    ["rank", "distance", *payload],
                ),
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), hits], [*passed, "hits"]
            )

    out = T.StructType(
        [*(questions.schema[c] for c in passed), T.StructField("hits", _hits_type(opened.table))]
    )
    return questions.mapInArrow(search, out)


# --- large index ----------------------------------------------------------


def _pivots(index: DataFrame, size: IndexSize, id_col: str) -> np.ndarray:
    """A bounded, repeatable spread of index vectors; any choice is exact."""
    n = max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * size.width), math.isqrt(size.rows)))
    chosen = index.orderBy(F.xxhash64(id_col), id_col).limit(n).select(VECTOR).toArrow()
    return _vectors(_column(chosen, VECTOR), size.width)[1]


def _nearest_pivot(
    vectors: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell and squared distance to all pivots of each vector, and a bound on its error.

    All are shifted by the mean pivot first, so a common offset costs no digits.
    The error of the matrix product grows with the squared norms that are left,
    and that of the shift with the norms there were.
    """
    centre = pivots.mean(axis=0)
    moved, fixed = vectors - centre, pivots - centre
    squared = np.maximum(_rough(moved, fixed), 0.0)
    error = _rounding(np.linalg.norm(moved, axis=1), fixed, centre)
    return squared.argmin(axis=1), squared, error


def _rounding(norms: np.ndarray, pivots: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Bound on the error of squared distances from vectors of these norms to pivots."""
    far = norms + np.linalg.norm(pivots, axis=1).max()
    shift = 1e-15 * (far + 2 * np.linalg.norm(centre))
    return 1e-13 * far**2 + 4 * shift * far + shift**2


def _in_cells(index: DataFrame, pivots: np.ndarray, width: int, id_col: str) -> DataFrame:
    """(id, embedding, cell, reach): the nearest pivot of each chunk."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows, vectors = _vectors(batch.column(VECTOR), width)
            if len(rows) < batch.num_rows:
                raise ValueError(f"index vectors must be {width} finite numbers wide")
            cell, squared, error = _nearest_pivot(vectors, pivots)
            reach = np.sqrt(squared[np.arange(len(cell)), cell] + error)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(cell, pa.int32()),
                    pa.array(reach, pa.float64()),
                ],
                [*batch.schema.names, "cell", "reach"],
            )

    wanted = index.select(id_col, VECTOR)
    out = T.StructType(
        [
            *wanted.schema.fields,
            T.StructField("cell", T.IntegerType()),
            T.StructField("reach", T.DoubleType()),
        ]
    )
    return wanted.mapInArrow(assign, out)


def _packed(pivots: np.ndarray, rows: np.ndarray, limit: int) -> np.ndarray:
    """The bin of each cell: cells are halved along the widest component of their pivots
    until ``limit`` rows hold a half. A larger cell is a bin by itself, an empty one in none (-1)."""
    bins = np.full(len(pivots), -1, dtype=np.int64)
    todo, n = [np.flatnonzero(rows > 0)], 0
    while todo:
        cells = todo.pop()
        if len(cells) > 1 and rows[cells].sum() > limit:
            cells = cells[np.argsort(pivots[cells, pivots[cells].var(axis=0).argmax()], kind="stable")]
            upto = np.cumsum(rows[cells])
            half = min(max(int(np.searchsorted(upto, upto[-1] / 2)), 1), len(cells) - 1)
            todo += [cells[half:], cells[:half]]
        elif len(cells):
            bins[cells] = n
            n += 1
    return bins


def _to_search(pivots: np.ndarray, radius: np.ndarray):
    """A function from vectors and their bounds to (own cell, which cells each has to search)."""
    _, between, apart_error = _nearest_pivot(pivots, pivots)
    between = np.sqrt(between + apart_error[:, None])
    # The largest error with which a chunk may have been put into its cell.
    centre = pivots.mean(axis=0)
    reach = np.linalg.norm(pivots - centre, axis=1) + np.maximum(radius, 0.0)
    placed = _rounding(reach.max(), pivots - centre, centre)
    occupied = radius >= 0.0

    def cells(vectors: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, squared, error = _nearest_pivot(vectors, pivots)
        limit = np.sqrt(bound)
        # Lower bounds, each lessened by what rounding may have added. A chunk
        # may also stand in a cell that is nearest only up to its own error.
        own_gap = squared[np.arange(len(own)), own]
        ball = np.sqrt(np.maximum(squared - error[:, None], 0.0)) - radius[None, :]
        least_gap = squared - own_gap[:, None] - 2 * (error + placed)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = least_gap / (2.0 * between[own])
        least = np.maximum(ball, np.where(np.isfinite(plane), plane, 0.0))
        open_ = (least <= limit[:, None] * (1 + 1e-9)) & occupied[None, :]
        open_[np.arange(len(own)), own] = occupied[own]
        return own, open_

    return cells


def _bound(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, math.inf).to_numpy(zero_copy_only=False)


def _visits(
    questions: DataFrame,
    pivots: np.ndarray,
    radius: np.ndarray,
    width: int,
    home: bool,
    bins: np.ndarray | None = None,
) -> DataFrame:
    """(qid, embedding, bound, own, bin): the bins a question has to search; ``own`` is its nearest cell.

    ``home`` gives the nearest cell only, as a bin. Otherwise all bins with a cell that
    may hold a vector within the question's ``bound`` (NULL: no bound yet); without
    ``bins`` each cell is one.
    """
    to_search = None if home else _to_search(pivots, radius)
    bins = np.where(radius >= 0.0, np.arange(len(pivots)), -1) if bins is None else bins
    n_bins = int(bins.max()) + 1
    # One column per bin: whether it holds the cell.
    holds = (bins[:, None] == np.arange(n_bins)[None, :]).astype(np.float32)
    step = max(1, VISIT_BYTES // (8 * width))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows, vectors = _vectors(batch.column(VECTOR), width)
            if home:
                own = _nearest_pivot(vectors, pivots)[0]
                row, bin_ = np.arange(len(own)), own
                bound = np.full(len(own), math.inf)
            else:
                bound = _bound(batch.column("bound"))[rows]
                own, open_ = to_search(vectors, bound)
                row, bin_ = np.nonzero(open_.astype(np.float32) @ holds)
            for low in range(0, len(row), step):
                part = row[low : low + step]
                taken = batch.select(["qid", VECTOR]).take(pa.array(rows[part]))
                more = [
                    pa.array(bound[part], pa.float64()),
                    pa.array(own[part], pa.int32()),
                    pa.array(bin_[low : low + step], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays([*taken.columns, *more], ["qid", VECTOR, "bound", "own", "bin"])

    schema = questions.select("qid", VECTOR).schema
    out = T.StructType(
        [
            *schema.fields,
            T.StructField("bound", T.DoubleType()),
            T.StructField("own", T.IntegerType()),
            T.StructField("bin", T.IntegerType()),
        ]
    )
    return questions.mapInArrow(visit, out)


def _blocks_per_bin(visits: DataFrame, block_rows: int) -> dict[int, int]:
    """Number of blocks the visits of each bin are cut into; at most one entry per pivot."""
    counted = visits.groupBy("bin").agg(F.count("*").alias("n")).collect()
    return {row["bin"]: math.ceil(row["n"] / block_rows) for row in counted}


def _per_bin(blocks: dict[int, int]) -> Column:
    """Blocks of ``bin`` as a column; bins without rows get none."""
    table = [blocks.get(b, 0) for b in range(max(blocks, default=0) + 1)]
    return F.coalesce(F.get(F.lit(table), F.col("bin")), F.lit(0))


def _search_bins(
    visits: DataFrame, cells: Cells, bins: np.ndarray, k: int, width: int, id_col: str, home: bool
) -> DataFrame:
    """(qid, id, distance): up to k rows within its bound per question and block it meets."""
    block_rows = max(1, BLOCK_BYTES // (8 * width))
    visit_blocks = _blocks_per_bin(visits, block_rows)
    held = np.zeros(len(bins) + 1, dtype=np.int64)  # what is in no bin is counted last
    np.add.at(held, bins, cells.rows)
    chunk_blocks = {b: math.ceil(n / block_rows) for b, n in enumerate(held[:-1].tolist()) if n}

    def spread(df: DataFrame, key: str, own: str, n_own, other: str, n_other) -> DataFrame:
        """Pin a row to one of its own blocks, and copy it to all of the other's."""
        return (
            df.where((n_own > 0) & (n_other > 0))
            .withColumn(own, F.pmod(F.xxhash64(key), n_own).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), n_other - 1)))
        )

    n_chunk, n_visit = _per_bin(chunk_blocks), _per_bin(visit_blocks)
    left = spread(visits, "qid", "visit_block", n_visit, "chunk_block", n_chunk)
    chunks = cells.chunks.select(id_col, VECTOR, "cell").withColumn("bin", F.get(F.lit(bins.tolist()), F.col("cell")).cast("int"))
    right = spread(chunks, id_col, "chunk_block", n_chunk, "visit_block", n_visit)
    qid_type = visits.schema["qid"].dataType
    id_type = chunks.schema[id_col].dataType
    names = ["qid", id_col, "distance"]
    to_search = None if home else _to_search(cells.pivots, cells.radius)

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        asked = asked.take(pc.sort_indices(asked, sort_keys=[("own", "ascending")]))
        stored = stored.take(pc.sort_indices(stored, sort_keys=[(id_col, "ascending")]))
        q_rows, questions = _vectors(_column(asked, VECTOR), width)
        c_rows, vectors = _vectors(_column(stored, VECTOR), width)
        bound = _bound(_column(asked, "bound"))[q_rows]
        cell = _column(stored, "cell").to_numpy()[c_rows]
        found = []
        for low in range(0, len(questions), len(questions) if home else TOGETHER):
            part = slice(low, low + (len(questions) if home else TOGETHER))
            # All cells of a home are the question's own.
            met = np.arange(len(cell)) if home else np.flatnonzero(to_search(questions[part], bound[part])[1].any(axis=0)[cell])
            row, hit, distance = _best(questions[part], vectors if len(met) == len(cell) else vectors[met], k)
            near = distance <= bound[part][row]
            found.append((row[near] + low, met[hit[near]], distance[near]))
        row, hit, distance = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        return pa.Table.from_arrays(
            [
                _column(asked, "qid").take(pa.array(q_rows[row])),
                _column(stored, id_col).take(pa.array(c_rows[hit])),
                pa.array(distance, pa.float64()),
            ],
            names=names,
        )

    out = T.StructType(
        [
            T.StructField("qid", qid_type),
            T.StructField(id_col, id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    keys = ["bin", "visit_block", "chunk_block"]
    if not home:  # few blocks with much work each, which sizes don't show: they aren't to be put together
        tasks = min(MAX_TASKS, 3 * sum(visit_blocks.get(b, 0) * n for b, n in chunk_blocks.items()) + 1)
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, out)


def _ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    order = W.partitionBy("qid").orderBy("distance", id_col)
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(
        F.col("rank") <= k
    )


def _fewer_copies(index: DataFrame, k: int, width: int, id_col: str) -> DataFrame:
    """``index`` less rows of whose vector the same task has k lower ids; some such rows stay."""
    enough = max(1, BLOCK_BYTES // (8 * width))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def lowest() -> pa.Table:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table, sort_keys=[(id_col, "ascending")]))
            rows, vectors = _vectors(_column(table, VECTOR), width)
            whole = np.ascontiguousarray(vectors).view(f"V{8 * width}").ravel()
            of = np.unique(whole, return_inverse=True)[1].ravel()
            order = np.argsort(of, kind="stable")
            place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
            return table.take(pa.array(rows[np.sort(order[place < k])]))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= enough:
                left = lowest().combine_chunks().to_batches()
                n = sum(b.num_rows for b in left)
                # Where most vectors differ nothing is gained by holding them.
                if n > enough // 2:
                    yield from left
                    left, n = [], 0
                held = left
        if n:
            yield from lowest().combine_chunks().to_batches()

    return index.mapInArrow(drop, index.schema)


def _without_spare_copies(index: DataFrame, k: int, width: int, id_col: str) -> DataFrame:
    """The k lowest ids of each distinct vector.

    Most copies are dropped before rows are sorted, so a vector that a third of
    all rows share sends k rows per task.
    """
    copies = W.partitionBy(VECTOR).orderBy(id_col)
    fewer = _fewer_copies(index.select(id_col, VECTOR), k, width, id_col)
    numbered = fewer.withColumn("_copy", F.row_number().over(copies))
    return numbered.where(F.col("_copy") <= k).drop("_copy")


def _cut(index: DataFrame, size: IndexSize, id_col: str, copies: int = COPIES) -> Cells:
    """Store the index in cells, with all that a search needs to know of them.

    Of equal vectors the ``copies`` lowest ids are kept, enough for as many hits.
    """
    width = size.width
    kept = stage(_without_spare_copies(index, copies, width, id_col), "vectors")
    pivots = _pivots(kept, size, id_col)
    chunks = stage(_in_cells(kept, pivots, width, id_col), "cells")
    radius, rows = np.full(len(pivots), -1.0), np.zeros(len(pivots), dtype=np.int64)
    cells = chunks.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach"))
    for row in cells.collect():  # at most MAX_PIVOTS rows
        radius[row["cell"]], rows[row["cell"]] = row["reach"], row["n"]
    bins = _packed(pivots, rows, max(1, BLOCK_BYTES // (8 * width)))
    return Cells(chunks, pivots, radius, rows, bins, copies)


def nearest_by_cells(questions: DataFrame, opened: OpenIndex, k: int) -> DataFrame:
    """(qid, id, distance, rank) by the cell join; ``qid`` must be unique."""
    id_col, width = opened.id_col, opened.size.width
    cells = opened.cells
    if cells is None or k > cells.copies:
        cells = _cut(opened.table, opened.size, id_col, max(k, COPIES))
    asked = stage(questions.select("qid", VECTOR), "asked")
    single = np.where(cells.rows > 0, np.arange(len(cells.rows)), -1)
    visits = stage(_visits(asked, cells.pivots, cells.radius, width, home=True), "homes")
    home = _ranked(_search_bins(visits, cells, single, k, width, id_col, home=True), k, id_col)
    bounds = home.where(F.col("rank") == k).select("qid", F.col("distance").alias("bound"))
    bounded = asked.join(bounds, "qid", "left")
    rest = stage(_visits(bounded, cells.pivots, cells.radius, width, home=False, bins=cells.bins), "visits")
    return _ranked(_search_bins(rest, cells, cells.bins, k, width, id_col, home=False), k, id_col)


def _retrieve_large(questions: DataFrame, opened: OpenIndex, k: int) -> DataFrame:
    """As the small way: every row has its own hits, whatever its ``qid``.

    Equal vectors are searched once; rows without a usable vector are not.
    """
    index, id_col, width = opened.table, opened.id_col, opened.size.width
    payload = _payload(index)
    kept = stage(questions, "questions")
    searchable = F.coalesce(usable(F.col(VECTOR)) & (F.size(VECTOR) == width), F.lit(False))
    row, taken = "_row", {c.lower() for c in kept.columns}
    while row in taken:
        row += "_"
    number = F.monotonically_increasing_id()
    vectors = stage(kept.where(searchable).select(VECTOR).distinct().withColumn("qid", number), "question-vectors")
    found = nearest_by_cells(vectors, opened, k)
    # A chunk near many questions is a hot key of this join; AQE splits it.
    hits = (
        found.withColumnRenamed("qid", row)
        .join(index.select(*payload), id_col)
        .groupBy(row)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "distance", *payload))).alias("hits"))
    )
    none = F.array().cast(_hits_type(index))
    numbered = kept.where(searchable).join(vectors.withColumnRenamed("qid", row), VECTOR).drop(VECTOR)
    answered = numbered.join(hits, row, "left").withColumn("hits", F.coalesce("hits", none)).drop(row)
    return answered.unionByName(kept.where(~searchable).drop(VECTOR).withColumn("hits", none))


# --- entry points ---------------------------------------------------------


def retrieve(
    questions: DataFrame,
    index: DataFrame | OpenIndex,
    k: int = lexicon.TOP_K,
    id_col: str = "chunk_id",
    max_index_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Questions, less their vector, with ``hits``: their k nearest index rows.

    ``questions`` has ``qid`` and ``embedding``; the index has ``id_col``,
    ``embedding`` and any columns to pass on. A question without a vector of
    the index's width, or an empty index, gives an empty array.
    """
    opened = (
        index if isinstance(index, OpenIndex) else open_index(index, id_col, max_index_bytes)
    )
    if opened.size.rows == 0 or k < 1:
        return questions.drop(VECTOR).withColumn("hits", F.array().cast(_hits_type(opened.table)))
    if opened.size.small:
        return _retrieve_small(questions, opened, k)
    return _retrieve_large(questions, opened, k)


def retrieve_by_cells(
    questions: DataFrame, index: DataFrame, k: int = lexicon.TOP_K, id_col: str = "chunk_id"
) -> DataFrame:
    """:func:`retrieve` for an index of any size, without shipping it."""
    return retrieve(questions, index, k, id_col, max_index_bytes=0)


def neighbours(retrieved: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(qid, id, rank, distance) rows of retrieved questions."""
    return retrieved.select("qid", F.explode("hits").alias("_hit")).select(
        "qid", f"_hit.{id_col}", "_hit.rank", "_hit.distance"
    )


def without_self(retrieved: DataFrame, k: int = lexicon.TOP_K, id_col: str = "chunk_id") -> DataFrame:
    """Drop the hit that is the question itself; retrieve k+1 beforehand."""
    others = F.filter("hits", lambda hit: hit[id_col] != F.col("qid"))
    return retrieved.withColumn(
        "hits",
        F.transform(
            F.slice(others, 1, k),
            lambda hit, i: hit.withField("rank", (i + 1).cast("bigint")),
        ),
    )
