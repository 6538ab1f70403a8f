"""The Merkle manifest against a plain tree, over small and over several superblocks."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from llm.odd import ODD, none, odd
from pyspark.sql import functions as F

from harvestline.llm import merkle
from harvestline.llm.common import staged


def h(text):
    return sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    way = []
    for level in levels[:-1]:
        low = i // 16 * 16
        way.append(("".join(level[low:i]), "".join(level[i + 1 : low + 16])))
        i //= 16
    return way


def plain(rows):
    """(leaf, subroot, root, proof, folded) of (source, id, leaf, shown) rows, in their order by source and id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    trees = {}
    for row in rows:
        trees.setdefault(row[0], []).append(row)
    below = [grown([r[2] for r in tree]) for tree in trees.values()]
    above = grown([levels[-1][0] for levels in below])
    out = []
    for s, (tree, levels) in enumerate(zip(trees.values(), below)):
        for i, row in enumerate(tree):
            way = path(levels, i) + path(above, s)
            folded = row[3] or row[2]
            for left, right in way:
                folded = h(left + folded + right)
            out.append((row[1], row[2], levels[-1][0], above[-1][0], h("".join(a + b for a, b in way)), folded, folded == above[-1][0]))
    return out


def as_rows(frame):
    names = ("row", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [16, 1, 2], [17, 300, 1], [4096, 4097, 9000], [1] * 40])
def test_trees_by_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    rows = []
    for s, size in enumerate(sizes):
        source = None if s == 1 else "sé" * (s % 3) + str(s)
        for i in rng.permutation(size).tolist():
            leaf = h(f"{s}/{i}")
            rows.append((source, i - 3, leaf, h("x" + leaf) if i % 7 == 0 else None))
    frame = spark.createDataFrame([(r[1], *r) for r in rows], "row long, source string, id long, leaf string, shown string")
    assert as_rows(merkle.manifest(frame.repartition(6))) == sorted(plain(rows), key=repr)


def test_manifest_of_odd_documents(spark):
    columns = ("doc_id", "source", "found", "text")
    leaves = merkle.table_leaves(odd(spark), columns)
    rows = []
    for doc_id, text, source, found in ODD:
        changed = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        low = text.translate({c: c + 32 for c in range(65, 91)}) if changed else text
        leaf, shown = (h("".join(map(enc, (doc_id, source, found, t)))) for t in (text, low))
        rows.append((source, doc_id, leaf, shown))
    assert as_rows(merkle.manifest(leaves)) == sorted(plain(rows), key=repr)
    assert merkle.manifest(merkle.table_leaves(none(spark), columns)).count() == 0


def test_siblings_prove_each_leaf(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.col("id").cast("string").alias("text"))
    for r in merkle.manifest(merkle.table_leaves(docs, ("doc_id", "source", "text"))).collect():
        node = r["leaf"]
        for left, right in zip(r["lefts"], r["rights"]):
            node = h(left + node + right)
        assert node == r["root"]


def test_a_source_of_most_rows_is_many_tasks(spark, monkeypatch):
    """All rows are one source, and a third have one id; the range sort still deals them out."""
    rows = spark.range(4000).select(F.lit("a").alias("source"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.lit("x").alias("leaf"))
    written = []
    monkeypatch.setattr(merkle, "staged", lambda df, name: written.append(staged(df, name)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        placed = merkle._numbered(rows, ["source", "id", "leaf"], "place")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["place"] for r in placed.collect()) == list(range(4000))
    dealt = [r["count"] for r in written[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(dealt) == 4 and max(dealt) < 2500
