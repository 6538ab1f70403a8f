"""Chunking, the index, retrieval, context, prompts."""

import os
import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT, rows
from pyspark.sql import functions as F

from harvestline import lexicon
from harvestline.functions import render
from harvestline.operators import chunking as K
from harvestline.operators import context as C
from harvestline.operators import nearest as N
from harvestline.session import new_folder
from harvestline.sources import documents as D

TEXT = (
    "\n  Seed Aid (National) — Terms\r\n\r\nFirst paragraph,\r\nsecond line.\r\n \t\r\n  - point\n\n\n"
    "Last one.\n---\nRain Cover\n-----\n  \n\nOnly Title\n---\nÉté 2024!\n　\nbody \n--\nmore"
)


def chunk_ids(spark, text, **options):
    documents = spark.createDataFrame([(7, text)], "doc_id long, text string")
    chunks = K.chunk_documents(documents, **options).orderBy("chunk_id").collect()
    return [(row["chunk_id"], row["scheme"], row["text"]) for row in chunks]


def test_chunker_edges(spark):
    assert chunk_ids(spark, TEXT, prefix_id=False) == [
        ("seed_aid_0", "Seed Aid (National) — Terms", "First paragraph,\nsecond line."),
        ("seed_aid_1", "Seed Aid (National) — Terms", "- point"),
        ("seed_aid_2", "Seed Aid (National) — Terms", "Last one."),
        ("t_2024_0", "Été 2024!", "body \n--\nmore"),
    ]


def test_second_of_two_breaks_becomes_a_title(spark):
    """Breaks share no newline, so the second of two is the next section's title."""
    found = chunk_ids(spark, "A\n\nx\n---\n---\nB\n\ny", prefix_id=False)
    assert found == [("_0", "---", "B"), ("_1", "---", "y"), ("a_0", "A", "x")]


def test_chunk_fields(spark):
    documents = spark.createDataFrame([(7, "T\np"), (8, "T\np"), (9, " ")], "doc_id long, text string")
    found = rows(K.chunk_documents(documents))
    assert found == [
        (7, "7_t_0", "T", 0, "p", "T\n\np"), (8, "8_t_0", "T", 0, "p", "T\n\np"),
    ]


def test_read_documents(spark, tmp_path):
    for name in ("a", "b"):
        with open(os.path.join(tmp_path, name + ".txt"), "w", encoding="utf-8") as file:
            file.write(f"{name}\n\npara 1\n\npara 2")
    found = D.read_documents(spark, str(tmp_path))
    assert found.count() == 2
    assert K.chunk_documents(found, prefix_id=False).count() == 4


# --- index ----------------------------------------------------------------


def vectors(spark, pairs, id_type="string"):
    return spark.createDataFrame(pairs, f"chunk_id {id_type}, embedding array<float>")


def chunks(spark, ids):
    return spark.createDataFrame([(i, f"s{i}", f"text {i}") for i in ids],
                                 "chunk_id string, scheme string, text string")


def test_build_index(spark):
    path = new_folder(spark, "index")
    built = D.build_index(chunks(spark, "abc"), vectors(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]), path)
    assert rows(built, "chunk_id", "text") == [("a", "text a"), ("b", "text b")]
    built = D.build_index(chunks(spark, "c"), vectors(spark, [("c", [1.0])]), path)
    assert rows(built, "chunk_id") == [("c",)]
    assert rows(D.missing_vectors(chunks(spark, "abc"), vectors(spark, [("a", [1.0])])), "chunk_id") == [
        ("b",), ("c",),
    ]


def test_build_index_refuses_bad_input(spark):
    path = new_folder(spark, "index")
    with pytest.raises(ValueError, match="chunk ids repeat"):
        D.build_index(chunks(spark, "aab"), vectors(spark, [("a", [1.0])]), path)
    with pytest.raises(ValueError, match="vector ids repeat"):
        D.build_index(chunks(spark, "ab"), vectors(spark, [("a", [1.0]), ("a", [2.0])]), path)
    with pytest.raises(ValueError, match="widths differ"):
        D.build_index(chunks(spark, "ab"), vectors(spark, [("a", [1.0]), ("b", [1.0, 2.0])]), path)


# --- nearest --------------------------------------------------------------


def brute_force(questions, index, k):
    found = set()
    for qid, q in questions:
        if q is None or len(q) != len(index[0][1]) or not np.isfinite(q).all():
            continue
        scored = []
        for cid, c in index:
            distance = 0.0
            for a, b in zip(np.float32(q).astype(float), np.float32(c).astype(float)):
                distance += (a - b) * (a - b)
            scored.append((distance, cid))
        for rank, (distance, cid) in enumerate(sorted(scored)[:k], 1):
            found.add((qid, cid, rank, distance))
    return found


def fixture(kind, n_questions=60, n_chunks=300, width=5, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "spread":
        index, asked = rng.normal(size=(n_chunks, width)), rng.normal(size=(n_questions, width))
    elif kind == "clusters":
        centres = rng.normal(size=(6, width)) * 20
        index = centres[rng.integers(0, 6, n_chunks)] + rng.normal(size=(n_chunks, width))
        asked = centres[rng.integers(0, 6, n_questions)] + rng.normal(size=(n_questions, width))
    else:  # a third of chunks and questions are copies of one vector; others tie
        index = rng.integers(0, 3, size=(n_chunks, width)).astype(float)
        asked = rng.integers(0, 3, size=(n_questions, width)).astype(float)
        index[: n_chunks // 3] = 1.0
        asked[: n_questions // 3] = 1.0
    order = rng.permutation(n_chunks)
    return (
        [(i, list(map(float, v))) for i, v in enumerate(asked)],
        [(int(i), list(map(float, v))) for i, v in zip(order, index)],
    )


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
@pytest.mark.parametrize("way", ["small", "cells"])
def test_nearest_equals_brute_force(spark, monkeypatch, kind, way):
    # Blocks of a few rows, so that cells and visits are cut into many.
    monkeypatch.setattr(N, "BLOCK_BYTES", 8 * 5 * 7)
    monkeypatch.setattr(N, "SCRATCH_BYTES", 8 * 3 * 300 * 4)
    asked, index = fixture(kind)
    questions = spark.createDataFrame(asked, "qid int, embedding array<float>").repartition(3)
    table = vectors(spark, index, "long").repartition(4)
    search = N.retrieve if way == "small" else N.retrieve_by_cells
    found = N.neighbours(search(questions, table, 4))
    assert {tuple(row) for row in found.collect()} == brute_force(asked, index, 4)


def test_far_cells_are_not_visited(spark):
    """On clustered vectors the bounds leave out most of the cells."""
    asked, index = fixture("clusters", 200, 2000)
    pivots = np.array([v for _, v in index[:40]])
    stored = np.array([v for _, v in index])
    cell, squared, error = N._nearest_pivot(stored, pivots)
    radius = np.full(40, -1.0)
    np.maximum.at(radius, cell, np.sqrt(squared[np.arange(len(cell)), cell] + error))
    bounds = {}
    for qid, _, rank, distance in brute_force(asked, index, 3):
        if rank == 3:
            bounds[qid] = float(distance)
    questions = spark.createDataFrame(
        [(q, v, bounds[q]) for q, v in asked], "qid int, embedding array<float>, bound double"
    )
    visits = N._visits(questions, pivots, radius, 5, home=False).count()
    assert visits < 0.3 * len(asked) * 39


def test_visits_grow_with_bins_not_with_cells(spark):
    """Where bounds rule out nothing, a question is sent once to each bin, in small batches (F1)."""
    rng = np.random.default_rng(3)
    pivots = rng.normal(size=(60, 8))
    packed = N._packed(pivots, np.full(60, 100), 1500)
    assert sorted(np.bincount(packed).tolist(), reverse=True)[0] <= 15 and packed.max() < 8
    asked = [(i, rng.normal(size=8).tolist(), None) for i in range(500)]
    questions = spark.createDataFrame(asked, "qid int, embedding array<float>, bound double")
    visits = N._visits(questions, pivots, np.full(60, 9.0), 8, home=False, bins=packed)
    assert visits.count() == 500 * (int(packed.max()) + 1)


def test_equal_questions_are_searched_once(spark, monkeypatch):
    """Copies of a question's vector are not searched again, and each row has its hits (F4)."""
    asked = [(i, [float(i % 3), 0.0]) for i in range(90)] + [(90, None), (91, [1.0])]
    questions = spark.createDataFrame(asked, "qid int, embedding array<float>")
    table = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "chunk_id long, embedding array<double>")
    written = {}
    original = N.stage
    monkeypatch.setattr(N, "stage", lambda df, name: written.setdefault(name, original(df, name)))
    found = {row["qid"]: [h["chunk_id"] for h in row["hits"]] for row in N.retrieve_by_cells(questions, table, 1).collect()}
    assert found == {i: [i % 3] if i < 90 else [] for i in range(92)}
    assert written["asked"].count() == 3


def test_spare_copies_are_dropped_before_they_are_sorted(spark, monkeypatch):
    """Of many copies a task passes on a few; the k lowest ids of each vector stay (F8)."""
    monkeypatch.setattr(N, "BLOCK_BYTES", 8 * 2 * 40)
    table = spark.range(3000).selectExpr("3000 - id AS chunk_id", "array(float(id % 5), -0.0f) AS embedding").repartition(4)
    fewer = N._fewer_copies(table, 3, 2, "chunk_id")
    assert fewer.count() <= 5 * 3 * 4
    kept = rows(N._without_spare_copies(table, 3, 2, "chunk_id"), "chunk_id")
    assert sorted(kept) == [(i,) for i in range(1, 16)]


def test_build_index_computes_its_sides_once(spark):
    """Checks and join read what was stored (F8)."""
    counted = spark.sparkContext.accumulator(0)
    one = F.udf(lambda text: counted.add(1) or text)
    D.build_index(chunks(spark, "abc").withColumn("chunk_id", one("chunk_id")), vectors(spark, [("a", [1.0])]), new_folder(spark, "index")).count()
    assert counted.value == 3


@pytest.mark.parametrize("way", ["small", "cells"])
def test_unusable_vectors_and_short_index(spark, way):
    questions = spark.createDataFrame(
        [(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [None, 1.0])],
        "qid int, embedding array<float>",
    )
    table = chunks(spark, "ab").join(vectors(spark, [("a", [1.0, 0.0]), ("b", [1.0, 0.0])]), "chunk_id")
    search = N.retrieve if way == "small" else N.retrieve_by_cells
    found = {row["qid"]: row["hits"] for row in search(questions, table, 5).collect()}
    assert [(h["rank"], h["chunk_id"], h["text"], h["distance"]) for h in found[1]] == [
        (1, "a", "text a", 1.0), (2, "b", "text b", 1.0),
    ]
    assert all(found[qid] == [] for qid in (2, 3, 4, 5))
    empty = search(questions, table.where("false"), 3)
    assert {len(row["hits"]) for row in empty.collect()} == {0}


def test_index_of_mixed_width_is_refused(spark):
    table = vectors(spark, [("a", [1.0]), ("b", [1.0, 2.0])])
    with pytest.raises(ValueError, match="differ in width"):
        N.open_index(table)


@pytest.mark.parametrize("way", ["small", "cells"])
def test_one_rule_for_odd_rows(spark, way):
    """Unusable index rows are left out, repeated questions answered each, repeated ids refused."""
    table = spark.createDataFrame(
        [("a", [0.0, 0.0]), ("b", None), ("c", [float("nan"), 1.0]), ("d", [None, 1.0]), ("e", [3.0, 0.0])],
        "chunk_id string, embedding array<double>",
    )
    questions = spark.createDataFrame([(1, [0.0, 0.0]), (1, [3.0, 0.0]), (None, [0.0, 1.0])], "qid int, embedding array<double>")
    search = N.retrieve if way == "small" else N.retrieve_by_cells
    found = [(row["qid"], [h["chunk_id"] for h in row["hits"]]) for row in search(questions, table, 2).collect()]
    assert sorted(found, key=str) == sorted([(1, ["a", "e"]), (1, ["e", "a"]), (None, ["a", "e"])], key=str)
    with pytest.raises(ValueError, match="stands on 2 rows"):
        search(questions, table.where("chunk_id = 'a'").union(table.where("chunk_id = 'a'")), 2)


def test_far_offsets_lose_no_neighbour(spark):
    """Vectors far from the origin and close to each other: both ways agree."""
    rng = np.random.default_rng(5)
    index = [(i, (1e4 + 1e-3 * rng.normal(size=3)).tolist()) for i in range(600)]
    table = spark.createDataFrame(index, "chunk_id long, embedding array<double>")
    questions = spark.createDataFrame(index[:300], "qid long, embedding array<double>")
    small = N.neighbours(N.retrieve(questions, table, 4)).collect()
    large = N.neighbours(N.retrieve_by_cells(questions, table, 4)).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large))


def test_large_index_is_stored_once(spark, monkeypatch):
    table = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], "chunk_id long, embedding array<double>")
    questions = spark.createDataFrame([(1, [3.2, 0.0])], "qid int, embedding array<double>")
    written = []
    original = N.stage
    monkeypatch.setattr(N, "stage", lambda df, name: written.append(name) or original(df, name))
    opened = N.open_index(table, max_index_bytes=0)
    for _ in range(2):
        assert N.retrieve(questions, opened, 2).first()["hits"][0]["chunk_id"] == 3
    assert written.count("vectors") == written.count("cells") == 1


def test_size_check(spark):
    table = chunks(spark, "abc").join(vectors(spark, [(c, [1.0] * 4) for c in "abc"]), "chunk_id")
    assert N.measure(table).small
    assert not N.measure(table, 3 * 24 + 1).small  # few rows, too many bytes
    assert not N.measure(table, 71).small  # too many rows to be small


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The driver's path is not the workers'; run from elsewhere to tell."""
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from harvestline.session import local_session
from harvestline.operators import nearest as N
spark = local_session(1, shuffle_partitions=1)
table = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "chunk_id int, embedding array<float>")
asked = table.withColumnRenamed("chunk_id", "qid")
for search in (N.retrieve, N.retrieve_by_cells):
    assert N.neighbours(search(asked, table, 2)).count() == 4
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=env, timeout=180, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr[-2000:]


def test_self_is_left_out(spark):
    table = vectors(spark, [(1, [0.0]), (2, [0.0]), (3, [1.0])], "int")
    questions = table.withColumnRenamed("chunk_id", "qid")
    found = N.neighbours(N.without_self(N.retrieve(questions, table, 2), 1))
    assert rows(found) == [(1, 2, 1, 0.0), (2, 1, 1, 0.0), (3, 1, 1, 1.0)]


# --- context and prompts --------------------------------------------------


def test_context_and_prompt(spark):
    questions = spark.createDataFrame(
        [(1, "What is the premium?", "hi", [0.0]), (2, "Who?", "or", None)],
        "qid int, question string, language string, embedding array<float>",
    )
    texts = spark.createDataFrame(
        [("x", " 2% for Kharif crops\n", [0.1]), ("y", "second", [0.2]), ("z", "far", [9.0])],
        "chunk_id string, text string, embedding array<float>",
    )
    asked = C.with_prompt(C.with_context(N.retrieve(questions, texts, 2)))
    found = {row["qid"]: row for row in asked.collect()}
    assert found[1]["retrieved_chunks"] == [" 2% for Kharif crops\n", "second"]
    assert found[1]["context"] == " 2% for Kharif crops\n\n\n---\n\nsecond"
    assert "Context:\n 2% for Kharif crops" in found[1]["prompt"]
    assert "strictly in Hindi (Devanagari script)." in found[1]["prompt"]
    assert found[1]["prompt"].endswith("User Question: What is the premium?\n")
    assert found[2]["context"] == ""
    assert "No reference document context was available" in found[2]["prompt"]
    assert "strictly in English." in found[2]["prompt"]
    assert rows(C.sources(asked)) == [
        (1, 1, "Source 1", "2% for Kharif crops"), (1, 2, "Source 2", "second"),
    ]


def test_answer_fallback(spark):
    table = spark.createDataFrame(
        [("text", "hi"), ("", "hi"), (None, "pa"), (None, "kn"), (None, "ta")], "a string, l string"
    )
    found = [r[0] for r in table.select(render.scheme_answer(F.col("a"), F.col("l"))).collect()]
    assert found[0] == "text" and "क्षमा करें" in found[1]
    assert found[2:] == [lexicon.BUSY_TEXTS["pa"], lexicon.BUSY_TEXTS["kn"], lexicon.DEFAULT_BUSY_TEXT]
