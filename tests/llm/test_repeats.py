"""Repeated passages: the index by itself, and the operator against brute force."""

import hashlib
import re

import numpy as np
import pytest
from llm.odd import LONG, ODD, none, odd

from harvestline.llm import substring_dedup as sd


def text_of(rng, pieces):
    parts = [rng.integers(1, 6, int(rng.integers(5, 40))) for _ in range(pieces)]
    return parts, np.concatenate([np.concatenate((p, [0])) for p in parts])


def test_index_counts_and_locates_as_scanning_does():
    rng = np.random.default_rng(5)
    for _ in range(5):
        _, text = text_of(rng, 30)
        index = sd.FMIndex(text)
        assert sorted(index.locate(np.arange(len(text))).tolist()) == list(range(len(text)))
        for _ in range(40):
            at = int(rng.integers(0, len(text) - 6))
            pattern = text[at : at + int(rng.integers(1, 6))]
            if 0 in pattern:
                continue
            low, high = np.array([0]), np.array([len(text)])
            for symbol in pattern[::-1]:
                low, high = index.extend(np.array([symbol]), low, high)
            places = [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern.tolist()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == places


def test_matching_statistics_are_the_longest_repeats():
    rng = np.random.default_rng(6)
    _, text = text_of(rng, 12)
    joined = "".join(map(str, text))
    ends = np.array([i for i in range(8, len(text)) if 0 not in text[i - 8 : i]])
    length, low, high = sd.FMIndex(text).matching_statistics(text, ends, 8)
    for end, found in zip(ends, length):
        own = [k for k in range(1, 9) if len(re.findall(f"(?={joined[end - k : end]})", joined)) > 1]
        assert found == max(own, default=0)


def plain(rows, width):
    """(id, n_words, n_removed, hash) by comparing all windows; ids are distinct."""
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first, gone = {}, {i: set() for i in split}
    for i in sorted(split):
        for at in range(len(split[i]) - width + 1):
            if first.setdefault(tuple(split[i][at : at + width]), (i, at)) != (i, at):
                gone[i].update(range(at, at + width))
    kept = {i: " ".join(w for k, w in enumerate(split[i]) if k not in gone[i]) for i in split}
    return {i: (len(split[i]), len(gone[i]), hashlib.sha256(kept[i].encode()).hexdigest()) for i in split}


def found_by(frame, **options):
    out = {}
    for r in sd.find_repeats(frame, **options).collect():
        f = r["repeats"]
        assert f["n_removed"] == sum(e - s for s, e in zip(f["starts"], f["ends"]))
        out[r["doc_id"]] = (f["n_words"], f["n_removed"], hashlib.sha256(f["kept"].encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot_rows,shard_words", [(0, 50), (3, 200), (2000, 300_000)])
def test_repeats_by_brute_force(spark, hot_rows, shard_words):
    """Few words, so windows repeat in many contexts; small limits force hot anchors and many shards."""
    rng = np.random.default_rng(2)
    words = list("abcdefgh") + ["É", "x y"]
    passage = " ".join(rng.choice(words, 14))
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(words[: 3 + i % 7], int(rng.integers(0, 25)))) for _ in range(3)]
        rows.append((int(i * 37 % 101) - 50, f"\t{passage} ".join(parts) if i % 2 else "\n".join(parts)))
    rows += [(1000 + i, rows[3][1]) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = found_by(frame, width=6, gram=3, hot_rows=hot_rows, shard_words=shard_words)
    assert found == plain(rows, 6)
    assert sum(n for _, n, _ in found.values()) > 500


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(sd, "SLICE_WORDS", 50)
    rng = np.random.default_rng(8)
    base = list(rng.choice([f"w{i}" for i in range(400)], 900))
    rows = [(1, " ".join(base)), (2, " ".join(base[100:400] + base[300:700])), (3, " ".join(base[:19])), (4, None)]
    found = found_by(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == plain(rows, 20) and found[2][1] == 700


def test_repeats_of_odd_documents(spark):
    frame = sd.find_repeats(odd(spark), output="found")
    assert frame.columns == [*odd(spark).columns, "found_"]
    rows = frame.collect()
    assert len(rows) == len(ODD)
    found = {r["doc_id"]: r["found_"] for r in rows}
    assert found[1]["n_removed"] == found[2]["n_removed"] == 0  # 15 words
    assert all(found[i]["n_words"] == found[i]["n_removed"] == 0 and found[i]["kept"] == "" for i in (3, 4, 5))
    assert found[6]["kept"] == " ".join(LONG.split()[:22]) or found[6]["n_removed"] == 12_000 - 3
    assert sd.find_repeats(none(spark)).count() == 0
    assert sd.repeat_report(none(spark)).count() == 0


def test_rows_that_share_an_id(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"a{i}" for i in range(5, 40))
    rows = [(1, one), (1, one), (None, one), (None, two), (7, two)]
    found = sd.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    removed = sorted((r["doc_id"] is None, r["doc_id"], r["text"] == one, r["repeats"]["n_removed"]) for r in found if r["doc_id"])
    assert removed == [(False, 1, True, 0), (False, 1, True, 0), (False, 7, False, 25)]
    assert sorted(r["repeats"]["n_removed"] for r in found if r["doc_id"] is None) == [30, 35]
