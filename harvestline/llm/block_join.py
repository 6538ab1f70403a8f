"""Nearest neighbours by a block matrix join over int8 tiles, exact.

Queries are dealt to blocks and all vectors to stripes; each (block, stripe) is one
cogrouped task of bounded size. There both sides are quantised to int8 and multiplied
as a tile. A product of codes misses the true inner product by no more than a bound
from the norms of the vectors and of what quantisation left off. So a pair whose upper
bound is below the k-th largest lower bound of its query is out; the survivors are
recomputed in double precision from the original vectors and kept in a heap of k for
each query. A last group limit merges the heaps of the stripes.

Every query meets every vector in some tile, in blocks; only k rows of a query leave a
task. Results are exact, so recall is 1.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, column_of, staged

by_value(__name__)

NEAREST = 20
QUERY_BLOCK = 1_024
STRIPE = 8_192
TILE = 256
# A product of more codes than this might not be a whole number in float32.
EXACT_WIDTH = 1_024
SLACK = 1e-6
# Powers of two beyond which a double product or sum may lose more than its last digits.
LARGEST, LEAST = 1022, -960


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, norms, code norms, rest norms): vector = scale * code + rest."""
    scales = np.abs(vectors).max(axis=1) / 127
    scales = np.maximum(scales, np.finfo(np.float64).tiny)
    codes = np.rint(vectors / scales[:, None]).clip(-127, 127).astype(np.int8)
    back = codes * scales[:, None]
    rest = np.linalg.norm(vectors - back, axis=1)
    return codes, scales, np.linalg.norm(vectors, axis=1), np.linalg.norm(back, axis=1), rest


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector over a power of two, which is exact, so that its largest entry is about one; the powers."""
    powers = np.frexp(np.abs(vectors).max(axis=1))[1].astype(np.int64)
    return np.ldexp(vectors, -powers[:, None]), powers


def tile_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of int8 codes as whole numbers, through float32 pieces that hold them."""
    out = np.zeros((len(left), len(right)))
    for start in range(0, left.shape[1], EXACT_WIDTH):
        part = slice(start, start + EXACT_WIDTH)
        out += left[:, part].astype(np.float32) @ right[:, part].astype(np.float32).T
    return out


def inner(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.cumsum(query[None, :] * vectors, axis=1)[:, -1]


def _search(k: int):
    def search(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not queries.num_rows or not vectors.num_rows:
            return pa.table([pa.array([], kind) for kind in kinds], names)
        q_row, q_id = (column_of(queries, c).to_numpy() for c in ("row", "id"))
        v_row, v_id = (column_of(vectors, c).to_numpy() for c in ("of_row", "of_id"))
        asked, given = _matrix(column_of(queries, "vector")), _matrix(column_of(vectors, "of_vector"))
        # Bounds are of scaled vectors, so no norm leaves the range of a double; those of a
        # query are compared over the power of the largest vector.
        (near_one, q_power), (near_all, v_power) = scaled(asked), scaled(given)
        shift = v_power - v_power.max()
        power = q_power + v_power.max()
        q_code, q_scale, q_norm, q_back, q_rest = quantised(near_one)
        v_code, v_scale, v_norm, v_back, v_rest = quantised(near_all)
        longest, weight = v_norm.max(), np.ldexp(1.0, shift)
        v_scale, v_norm, v_rest = v_scale * weight, v_norm * weight, v_rest * weight
        found: list[tuple] = []
        for start in range(0, len(asked), TILE):
            part = slice(start, start + TILE)
            near = tile_product(q_code[part], v_code) * q_scale[part, None] * v_scale[None, :]
            off = q_rest[part, None] * v_norm[None, :] + q_back[part, None] * v_rest[None, :]
            off += SLACK * q_norm[part, None] * v_norm[None, :]
            off += asked.shape[1] * np.finfo(np.float64).tiny
            own = q_row[part, None] == v_row[None, :]
            low = np.where(own, -np.inf, near - off)
            least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
            left = (near + off >= least[:, None]) & ~own
            # Where doubles overflow or vanish, unequal products have equal scores, and all count.
            highest = np.log2(q_norm[part] * longest) + power[part]
            lowest = np.log2(np.maximum(np.abs(least), np.finfo(np.float64).tiny))
            extreme = (highest > LARGEST) | (np.minimum(lowest, lowest + power[part]) < LEAST)
            left[extreme] = ~own[extreme]
            for i in range(len(left)):
                at = np.flatnonzero(left[i])
                scores = inner(asked[start + i], given[at])
                # A sum of opposite infinities is no number, and comes last.
                ranked = np.where(np.isnan(scores), -np.inf, scores)
                best = heapq.nlargest(k, zip((~np.isnan(scores)).tolist(), ranked.tolist(), (-v_id[at]).tolist()))
                found += [(q_row[start + i], q_id[start + i], -vec, score if number else np.nan) for number, score, vec in best]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)] if found else [pa.array([], kind) for kind in kinds], names)

    return search


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = NEAREST,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    stripe: int = STRIPE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` rows of largest inner product.

    A query's own row isn't its candidate; a copy of it is. Ties go to the smaller id.
    Rows whose vector is null, empty, zero, or holds null or non-finite components, and
    rows without an id, are neither queries nor candidates. Only vectors of equal
    length meet. A score that a double can't hold is infinite, or NaN and last where
    opposite infinities are added; equal scores are ties. A repeated query row has its neighbours once for each. With fewer
    candidates all are returned. Other columns are not read. An empty table, or one
    without queries, gives no rows.
    """
    vector = F.col(vector_col).cast("array<double>")
    picked = table.select(
        F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    rows = picked.where(usable(F.col("vector")) & F.col("id").isNotNull())
    rows = rows.withColumn("width", F.size("vector")).withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows, "vectors")  # row numbers hold from here on
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).first()
    blocks, stripes = max(1, -(-counts["asked"] // query_block)), max(1, -(-counts["n"] // stripe))
    to = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("asks").withColumn("block", to(blocks)).withColumn("stripe", every(stripes))
    vectors = rows.withColumn("stripe", to(stripes)).withColumn("block", every(blocks))
    keys = ["width", "block", "stripe"]
    # Both sides come from one table; columns of their own keep them apart in the plan.
    given = [F.col(c).alias(f"of_{c}") for c in ("row", "id", "vector")]
    tiles = queries.select(*keys, "row", "id", "vector").groupBy(*keys).cogroup(vectors.select(*keys, *given).groupBy(*keys))
    heaps = tiles.applyInArrow(_search(k), "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    ranked = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_vectors(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    return nearest(embeddings, F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank
  FROM (
    SELECT q.r, q.vec_id AS query_id, c.vec_id,
      list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
    FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0
  )
) WHERE rank <= 20
"""
