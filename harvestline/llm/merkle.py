"""A Merkle manifest of a table: a tree of hashes for each source, and one above them.

Rows become leaves where they lie, so texts are hashed once and never travel. Leaves are
numbered in the order of (source, id) by a range sort whose partitions are counted, so
that no source is one task. ``BLOCK`` consecutive nodes of a tree make a superblock, which
has three levels of its own.

Upwards, superblocks are reduced to their top node, pass by pass, until each source has one
node, its subroot; subroots are the leaves of the last tree, which ends in the root.
Downwards, the nodes of a pass and the outer nodes that they need, the siblings on the way
from their superblock to the root, are cogrouped by superblock: there the local levels are
made again, joined with the outer siblings into whole proofs, and folded to a root from
any other leaf that is to be proven.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import broadcast_if_small
from .common import ascii_lower, by_value, staged

by_value(__name__)

ARITY = 16
LEVELS = 3
BLOCK = ARITY**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 5


# --- leaves -----------------------------------------------------------------


def encoded(value: Column) -> Column:
    """``-`` for null, else the count of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256)


def tampered(id_: Column, text: Column) -> Column:
    """``text`` in lower case (A-Z) where the crc32 of the id's digits is divisible by five."""
    return F.when(F.crc32(id_.cast("string").cast("binary")) % TAMPER_EVERY == 0, ascii_lower(text)).otherwise(text)


# --- order ------------------------------------------------------------------


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its place in the order of ``order`` (nulls first), from 0, as ``name``.

    Only the row counts of partitions meet in one task. Equal rows are dealt to several
    partitions by where they lie.
    """
    rows = df.withColumn("_lies", F.xxhash64(F.monotonically_increasing_id()))
    keys = [*order, "_lies"]
    lined = staged(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_lies").withColumn("_at", F.monotonically_increasing_id()),
        "lined",
    ).withColumn("_part", F.shiftright("_at", 33))
    counts = lined.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row a partition, so its size is that of the number of partitions.
    offsets = counts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return lined.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


# --- trees ------------------------------------------------------------------


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _height(n: int) -> int:
    """Levels above ``n`` nodes of a tree that lie within a superblock."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _levels(digests: list[str], height: int) -> list[list[str]]:
    out = [digests]
    for _ in range(height):
        below = out[-1]
        out.append([_hash("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def _sides(levels: list[list[str]]) -> list[tuple[list[str], list[str]]]:
    """For every node of the lowest level, what stands left and right of its way up, level by level."""
    above: list[tuple[list[str], list[str]]] = [([], [])]
    for level in reversed(levels[:-1]):
        here = []
        for i in range(len(level)):
            low = i - i % ARITY
            lefts, rights = above[i // ARITY]
            here.append((["".join(level[low:i]), *lefts], ["".join(level[i + 1 : low + ARITY]), *rights]))
        above = here
    return above


def _fold(node: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        node = _hash(left + node + right)
    return node


def _up(nodes: pd.DataFrame) -> pd.DataFrame:
    """The top node of a superblock, of the ``n`` nodes that its tree has in this pass."""
    n = int(nodes["n"].iloc[0])
    top = _levels(nodes.sort_values("idx")["digest"].tolist(), _height(n))[-1]
    return pd.DataFrame({"tree": nodes["tree"].iloc[:1], "idx": nodes["block"].iloc[:1], "n": [-(-n // BLOCK)], "digest": top})


def _passes(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (tree, idx, n, digest) and those of each further pass, up to one node a tree."""
    out = [nodes.withColumn("block", F.floor(F.col("idx") / BLOCK))]
    while True:
        tops = out[-1].groupBy("tree", "block").applyInPandas(_up, "tree long, idx long, n long, digest string")
        tops = staged(tops, "nodes").withColumn("block", F.floor(F.col("idx") / BLOCK))
        out.append(tops)
        if not tops.where("n > 1").limit(1).count():
            return out


_OUTER = "tree long, block long, lefts array<string>, rights array<string>, subroot string, root string"


def _joined(nodes: pd.DataFrame, outer: pd.DataFrame) -> list[tuple[list[str], list[str]]]:
    """Whole proofs of the nodes of a superblock, in their order."""
    local = _sides(_levels(nodes["digest"].tolist(), _height(int(nodes["n"].iloc[0]))))
    lefts, rights = list(outer["lefts"].iloc[0]), list(outer["rights"].iloc[0])
    return [(left + lefts, right + rights) for left, right in local]


def _down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Outer nodes for the superblocks whose tops these nodes are."""
    nodes = nodes.sort_values("idx")
    lefts, rights = zip(*_joined(nodes, outer))
    out = pd.DataFrame({"tree": nodes["tree"], "block": nodes["idx"], "lefts": lefts, "rights": rights})
    return out.assign(subroot=outer["subroot"].iloc[0], root=outer["root"].iloc[0])


def _descend(passes: list[DataFrame], outer: DataFrame) -> DataFrame:
    """From the outer nodes of whole trees to those of the superblocks of the first pass."""
    for nodes in reversed(passes[1:-1]):
        outer = nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_down, _OUTER)
    return outer


def _proven(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    leaves = leaves.sort_values("idx")
    root = outer["root"].iloc[0]
    proofs = _joined(leaves, outer)
    out = leaves[["row", "digest"]].rename(columns={"digest": "leaf"})
    out["subroot"], out["root"] = outer["subroot"].iloc[0], root
    out["lefts"], out["rights"] = zip(*proofs)
    out["proof_sha256"] = [_hash("".join(a + b for a, b in zip(*proof))) for proof in proofs]
    shown = leaves["shown"].where(leaves["shown"].notna(), leaves["digest"])
    out["folded_root"] = [_fold(leaf, *proof) for leaf, proof in zip(shown, proofs)]
    out["verified"] = out["folded_root"] == root
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs of all leaves: row, leaf, subroot, root, lefts, rights, proof_sha256, folded_root, verified.

    ``leaves`` are (row, source, id, leaf, shown): ``shown`` is the leaf to be proven in
    place of the true one, null for that itself. ``lefts`` and ``rights`` hold the siblings
    on the way up, level by level, each side of a level as one string.

    Leaves of a source are ordered by id, nulls first, then by leaf; equal leaves are as
    many leaves. A null source is a source, and the first. An empty table has no rows.
    """
    placed = _numbered(staged(leaves, "leaves"), ["source", "id", "leaf"], "place")
    placed = staged(placed, "placed")
    sources = placed.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    trees = staged(_numbered(sources, ["source"], "tree"), "trees")
    of_tree = broadcast_if_small(trees.withColumnRenamed("source", "its"))
    nodes = placed.join(of_tree, F.col("source").eqNullSafe(F.col("its"))).select(
        "tree", (F.col("place") - F.col("first")).alias("idx"), "n", F.col("leaf").alias("digest"), "row", "shown"
    )
    nodes = staged(nodes, "nodes")
    lower = _passes(nodes.select("tree", "idx", "n", "digest"))
    roots = lower[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest")
    count = roots.count()
    upper = _passes(roots.select("tree", "idx", F.lit(count).cast("long").alias("n"), "digest"))
    none = F.array().cast("array<string>")
    zero = F.lit(0).cast("long").alias("block")
    top = upper[-1].select("tree", zero, none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    # The last tree's leaves are the subroots, so its proofs are the outer nodes of the sources' trees.
    above = _descend([None, *upper], top).select(F.col("block").alias("tree"), zero, "lefts", "rights", "root")
    outer = above.join(lower[-1].select("tree", F.col("digest").alias("subroot")), "tree")
    outer = staged(_descend(lower, outer.select("tree", "block", "lefts", "rights", "subroot", "root")), "outer-nodes")
    leaves_by_block = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK)).groupBy("tree", "block")
    schema = "row {}, leaf string, subroot string, root string, lefts array<string>, rights array<string>, proof_sha256 string, folded_root string, verified boolean"
    kind = dict(nodes.dtypes)["row"]
    return leaves_by_block.cogroup(outer.groupBy("tree", "block")).applyInPandas(_proven, schema.format(kind))


def table_leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Leaves of a table's rows over ``columns``, shown with tampered texts; ``row`` is the id.

    A null value is ``-``, an empty one ``0:``, so they differ. Rows without an id aren't
    tampered with, and a null text stays null. Columns beyond ``columns`` are not read.
    """
    true = leaf_of([F.col(c) for c in columns])
    shown = leaf_of([tampered(F.col(id_col), F.col(c)) if c == text_col else F.col(c) for c in columns])
    return docs.select(F.col(id_col).alias("row"), F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), true.alias("leaf"), shown.alias("shown"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    proven = manifest(table_leaves(docs))
    return proven.select(F.col("row").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# DuckDB: levels by recursion, and siblings by a list of each run's digests.
SQL = r"""
WITH RECURSIVE enc AS (
  SELECT doc_id, source, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, doc_id,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN crc % 5 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS shown
  FROM enc
), tree(s, level, i, digest, n) AS (
  SELECT s, 0, i, leaf, count(*) OVER (PARTITION BY s) FROM leaves
  UNION ALL
  SELECT s, level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 15) // 16
  FROM tree WHERE n > 1 GROUP BY s, level, i // 16
), subroots AS (
  SELECT s, digest AS subroot, level AS height FROM tree WHERE n = 1
), top(level, i, digest, n) AS (
  SELECT 0, s, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 15) // 16
  FROM top WHERE n > 1 GROUP BY level, i // 16
), steps AS (
  SELECT s, i AS leaf_i, FALSE AS high, level, i // (CAST(16 AS BIGINT) ** level)::BIGINT AS i
  FROM leaves JOIN subroots USING (s) CROSS JOIN range(0, 16) l(level) WHERE level < height
  UNION ALL
  SELECT s, i, TRUE, level, s // (CAST(16 AS BIGINT) ** level)::BIGINT
  FROM leaves CROSS JOIN range(0, 16) l(level) WHERE level < (SELECT max(level) FROM top)
), nodes AS (
  SELECT s, FALSE AS high, level, i, digest FROM tree
  UNION ALL
  SELECT s.s, TRUE, level, i, digest FROM top, subroots s
), sides AS (
  SELECT st.s, st.leaf_i, st.high, st.level,
    coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i < st.i), '') AS l,
    coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i > st.i), '') AS r
  FROM steps st JOIN nodes t ON t.s = st.s AND t.high = st.high AND t.level = st.level AND t.i // 16 = st.i // 16
  GROUP BY st.s, st.leaf_i, st.high, st.level
), proofs AS (
  SELECT s, leaf_i AS i, string_agg(l || r, '' ORDER BY high, level) AS proof, list({'l': l, 'r': r} ORDER BY high, level) AS way
  FROM sides GROUP BY s, leaf_i
), folded AS (
  SELECT v.doc_id, v.leaf, t.subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_prepend({'l': v.shown, 'r': ''}, coalesce(p.way, [])), lambda a, b: {'l': sha256(b.l || a.l || b.r), 'r': ''}).l AS folded_root
  FROM leaves v JOIN subroots t USING (s) LEFT JOIN proofs p USING (s, i)
)
SELECT *, folded_root = root AS verified FROM folded
"""
