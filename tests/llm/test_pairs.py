"""Operators on pairs of rows: near-duplicates, lines, neighbours, benchmark passages."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from llm.odd import LONG, ODD, none, odd
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from harvestline.llm import block_join, decontamination, fuzzy_lines, simhash
from harvestline.llm.components import connected_components


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame(path + star + [(7, 7), (5, 4), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert found == closure([*range(41), *range(100, 130)], path + star)
    assert connected_components(edges.where("false")).count() == 0


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for _, text, *_ in ODD:
        if text is not LONG:
            assert simhash.fingerprint_of(text) % (1 << 64) == plain_fingerprint(text)


@pytest.mark.parametrize("full_run", [2, 256])
def test_ball_links_connect_as_all_pairs_do(spark, full_run):
    """Random balls of several radii, compared pair by pair; short runs force whole balls."""
    rng = np.random.default_rng(3)
    fps = {0}
    for _ in range(25):
        base = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(12):
            flips = rng.choice(64, size=int(rng.integers(0, 6)), replace=False)
            fps.add(base ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    links = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    found = simhash.ball_links(frame, full_run).collect()
    ours = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in found]
    if full_run > 2:
        assert set(map(frozenset, ours)) <= set(map(frozenset, links))
    assert all((a ^ b).bit_count() <= 3 for a, b in ours)
    assert closure(fps, ours) == closure(fps, links)


def test_near_duplicates_of_odd_documents(spark):
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd(spark)).collect()]
    assert len(rows) == len(ODD)
    fingerprint = {d: f for d, f, _ in rows}
    group = {d: c for d, _, c in rows}
    assert fingerprint[3] == fingerprint[4] == fingerprint[5] == "0" * 16
    assert group[1] == group[2] == 1 and group[3] == group[4] == group[5] == 3
    assert group[None] is None
    assert simhash.near_duplicates(none(spark)).count() == 0
    kept = sorted((str(r["doc_id"]) for r in simhash.keep_representatives(odd(spark)).collect()))
    assert kept.count("2") == 0 and kept.count("1") == 1 and kept.count("None") == 1 and "4" not in kept


def test_near_duplicates_of_the_table_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    ids = sorted(texts)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (texts[a] ^ texts[b]).bit_count() <= 3]
    found = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    expected = closure(ids, links)
    assert found == {i: (texts[i], expected[i]) for i in ids}


# --- lines --------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("full_run", [2, 24])
def test_lines_by_brute_force(spark, full_run):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)]
    lines = []
    for _ in range(12):
        base = list(rng.choice(words, 24))
        for _ in range(6):
            line = list(base)
            for at in rng.choice(24, int(rng.integers(0, 3)), replace=False):
                line[at] = line[at][:-1] + "x"
            lines.append(" ".join(line))
    lines += ["Only once here.", "", "!!", lines[0].upper() + "!"]
    docs = [(d, "\n".join(lines[d::5])) for d in range(5)] + [(9, None), (10, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {(r["doc"], r["line"]): r["keep"] for r in fuzzy_lines.mark_lines(frame, full_run=full_run).collect()}
    every = {(d, n): line for d, text in docs for n, line in enumerate(fuzzy_lines.normal_lines(text)) if line}
    distinct = sorted(set(every.values()))
    marks = dict(zip(distinct, fuzzy_lines.fingerprints_of(distinct).tolist()))
    blocks = {line: {tuple(line.split()[i : i + 3]) for i in range(len(line.split()) - 2)} for line in distinct}
    held = Counter(block for line in distinct for block in blocks[line])

    def meet(a, b):
        """Lines of up to 24 words with a common block, on crowded blocks too."""
        return blocks[a] & blocks[b]

    near = [
        (a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if distance(a, b) <= 0.2 * max(len(a), len(b))
    ]
    links = [(a, b) for a, b in near if meet(a, b)]
    assert links == near
    crowded = [(a, b) for a, b in near if all(held[block] > full_run for block in blocks[a] & blocks[b])]
    assert full_run > 2 or any(((marks[a] ^ marks[b]) % (1 << 64)).bit_count() > 3 for a, b in crowded)
    roots = closure(distinct, links)
    firsts = {}
    for place in sorted(every):
        firsts.setdefault(roots[every[place]], place)
    assert found == {place: firsts[roots[line]] == place for place, line in every.items()}
    assert links and not all(found.values())


@pytest.mark.parametrize("fewest,most", [(1, 12), (13, 60), (61, 120)])
def test_recall_of_similar_lines(spark, fewest, most):
    """Lines edited anywhere, letters and whole words, against edit similarity alone."""
    rng = np.random.default_rng(fewest)
    pool = ["".join(rng.choice(list("abcdefghijklmnoprstu"), int(rng.integers(2, 9)))) for _ in range(3000)]
    lines, pairs = [], []
    while len(pairs) < 80:
        words = rng.choice(pool, int(rng.integers(fewest, most + 1))).tolist()
        other = list(words)
        for _ in range(1 + int(len(words) * rng.uniform(0, 0.12))):
            at = int(rng.integers(len(other)))
            change = rng.integers(4)
            if change == 0:
                letter = int(rng.integers(len(other[at])))
                other[at] = other[at][:letter] + "z" + other[at][letter + 1 :]
            elif change == 1:
                other[at] = str(rng.choice(pool))
            elif change == 2:
                other.insert(at, str(rng.choice(pool)))
            elif len(other) > 1:
                del other[at]
        a, b = " ".join(words), " ".join(other)
        if a != b and distance(a, b) <= 0.2 * max(len(a), len(b)):
            pairs.append((len(lines), len(lines) + 1))
            lines += [a, b]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    keep = {r["doc"]: r["keep"] for r in fuzzy_lines.mark_lines(docs).collect()}
    assert sum(not keep[b] for _, b in pairs) >= 0.95 * len(pairs)


def _edited(rng, pool, words, every):
    """A line, and the same with a letter of each ``every``-th word changed."""
    line = rng.choice(pool, words).tolist()
    other = [word[:-1] + "z" if n % every == every - 1 else word for n, word in enumerate(line)]
    return " ".join(line).encode(), " ".join(other).encode()


def test_all_windows_of_long_lines_are_blocks():
    rng = np.random.default_rng(21)
    pool = ["".join(rng.choice(list("abcdefghijklmnoprstu"), int(rng.integers(4, 9)))) for _ in range(3000)]
    for words in (3, 9, 24, 25, 40, 200):
        lines = [line for _ in range(20) for line in _edited(rng, pool, words, 4)]
        found = fuzzy_lines.blocks_of(lines, *fuzzy_lines._word_hashes(lines)).to_pylist()
        for line, blocks in zip(lines, found):
            held = line.split()
            windows = {tuple(held[i : i + 3]) for i in range(words - 2)}
            assert len(set(blocks)) == len(blocks) and len(blocks) >= len(windows)
            assert words <= 8 or len(blocks) == len(windows)
        assert all(set(found[i]) & set(found[i + 1]) for i in range(0, len(lines), 2))


def test_long_lines_with_few_words_alike_in_a_row_are_found(spark):
    """Lines of more than 24 words with a changed letter in every fourth word share a few blocks of three words."""
    rng = np.random.default_rng(22)
    pool = ["".join(rng.choice(list("abcdefghijklmnoprstu"), int(rng.integers(4, 9)))) for _ in range(3000)]
    pairs = [_edited(rng, pool, int(rng.integers(25, 34)), 4) for _ in range(150)]
    marks = fuzzy_lines.fingerprints_of([line for pair in pairs for line in pair]).view(np.uint64)
    pairs = [pair for pair, near in zip(pairs, np.bitwise_count(marks[::2] ^ marks[1::2]) <= fuzzy_lines.FAR) if near]
    assert len(pairs) > 60 and all(distance(a, b) <= 0.2 * len(a) for a, b in pairs)
    docs = spark.createDataFrame(
        [(2 * n + i, line.decode()) for n, pair in enumerate(pairs) for i, line in enumerate(pair)], "doc_id long, text string"
    )
    keep = {r["doc"]: r["keep"] for r in fuzzy_lines.mark_lines(docs).collect()}
    assert all(keep[2 * n] and not keep[2 * n + 1] for n in range(len(pairs)))


def test_edit_distance_within(spark):
    rng = np.random.default_rng(7)
    for n in range(400):
        a, b = ("".join(rng.choice(list("abc"[: 2 + n % 2]), int(rng.integers(0, 14)))) for _ in range(2))
        b = a[: len(a) // 2] + b if n % 3 else b
        apart = distance(a, b)
        assert [fuzzy_lines.within(a, b, most) for most in range(15)] == [apart <= most for most in range(15)]


def test_slices_of_a_crowded_block_meet_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "SLICE_LINES", 3)
    rows = [(n, n % 4, 10, [5]) for n in range(20)] + [(n, 0, 10, [6, 7]) for n in range(20, 24)]
    nodes = spark.createDataFrame(rows, "node long, fp long, size int, blocks array<long>")
    roots = spark.createDataFrame([(n, 0) for n in range(6)], "node long, root long")
    hot = fuzzy_lines.crowded_blocks(nodes, 3)
    assert {tuple(r) for r in hot.collect()} == {(5, 20), (6, 4), (7, 4)}
    found = [tuple(r) for r in fuzzy_lines.crowded_pairs(nodes, hot, roots).collect()]
    together = [(a, b) for low, high in ((0, 20), (20, 24)) for a in range(low, high) for b in range(a + 1, high) if b >= 6]
    assert sorted(found) == together


def test_short_lines_of_a_crowded_block_meet_once_and_only_with_about_the_same_letters(spark):
    lines = ["one two three red fox", "one two three red fix", "one two three rod foxes", "one two three blau kuh", "zzz yyy xxx www vvv uuu"]
    letters = [fuzzy_lines._letters(line.encode()) for line in lines]
    rows = [(key, 5, n, 0, len(line), 8, letters[n]) for n, line in enumerate(lines) for key in (5, 6, 7) if key != 5 + n]
    crowded = spark.createDataFrame(rows, "key long, held long, node long, fp long, size int, blocks int, letters binary")
    roots = spark.createDataFrame([], "node long, root long")
    found = [tuple(r) for r in fuzzy_lines.crowded_pairs(None, None, roots, crowded=crowded).collect()]
    pairs = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    similar = {(a, b) for a, b in pairs if distance(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b]))}
    assert len(found) == len(set(found)) and similar and similar <= set(found) and not {(0, 3), (0, 4), (3, 4)} & set(found)
    assert fuzzy_lines._letters(b"x" * 80) is None


def test_edit_distances_of_many_pairs_at_once():
    rng = np.random.default_rng(11)
    xs, ys = [], []
    for n in range(600):
        x = rng.choice(list("abcde é漢"), int(rng.integers(0, 260)))
        y = np.where(rng.random(len(x)) < rng.uniform(0, 0.3), "q", x)[int(rng.integers(0, 20)) :]
        xs.append("".join(x))
        ys.append("".join(y) + "ab"[: n % 3])
    most = [int(rng.integers(0, 1 + max(len(x), len(y)) // 3)) for x, y in zip(xs, ys)]
    expected = [fuzzy_lines.within(x, y, n) for x, y, n in zip(xs, ys, most)]
    assert fuzzy_lines.all_within(xs, ys, most).tolist() == expected and 100 < sum(expected) < 500
    assert fuzzy_lines.all_within([], [], []).tolist() == []


@pytest.mark.parametrize("full_run", [2, 128])
def test_pairs_share_enough_blocks_without_meeting_them_again(spark, full_run):
    """Only keys that lines share are dealt with the lines, and crowded blocks count for a pair's share."""
    rng = np.random.default_rng(4)
    rows = []
    for n in range(60):
        blocks = np.unique(np.concatenate((rng.integers(0, 15, int(rng.integers(1, 4))), 1000 * (n + 1) + np.arange(n % 14))))
        rows.append((n, int(rng.integers(0, 4)), 70 if n % 9 == 0 else 100 + n % 5, blocks.tolist()))
    nodes = spark.createDataFrame(rows, "node long, fp long, size int, blocks array<long>").repartition(3)
    held = Counter(key for *_, blocks in rows for key in blocks)
    shared = fuzzy_lines.shared_blocks(nodes, full_run)
    found = {(r["key"], r["node"]) for r in shared.where("node is not null").collect()}
    assert found == {(key, n) for n, _, _, blocks in rows for key in blocks if 1 < held[key] <= full_run}
    hot = fuzzy_lines.crowded_blocks(nodes, full_run, shared)
    assert {tuple(r) for r in hot.collect()} == {(key, n) for key, n in held.items() if n > full_run}
    crowded = fuzzy_lines.crowded_lines(nodes, hot)
    met = fuzzy_lines._sharing(fuzzy_lines.candidate_pairs(nodes, shared, crowded, full_run=full_run), crowded)
    roots = spark.createDataFrame([], "node long, root long")
    pairs = {(r["a"], r["b"]) for r in met.where("run is null").collect()}
    pairs |= {tuple(r) for r in fuzzy_lines.crowded_pairs(nodes, hot, roots, crowded=crowded).collect()}
    expected = set()
    for a, _, x, blocks in rows:
        for b, _, y, others in rows[a + 1 :]:
            common = len(set(blocks) & set(others))
            enough = max(x, y) < 80 or common >= 0.1 * max(len(blocks), len(others))
            if common and enough and abs(x - y) <= 0.2 * max(x, y):
                expected.add((a, b))
    assert pairs == expected and len(pairs) > 20


def test_lines_of_a_long_text_come_in_slices(monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "SLICE_BYTES", 1000)
    text = "\n".join(f"line number {n} of one text" for n in range(500)) + "\n\nline number 3 of one text"
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, None, "Last one."])], ["doc", "text"])
    slices = list(fuzzy_lines._slices([batch]))
    assert max(sum(len(line) for line, _, _ in part) for part in slices) < 1100
    assert sum(len(part) for part in slices) == 502
    parts = list(fuzzy_lines._scan(True)([batch]))
    assert len(parts) == len(slices) and sum(pa.Table.from_batches(parts).column("n").to_pylist()) == 502
    whole = fuzzy_lines.fingerprints_of([b"last one"]).tolist()
    assert parts[-1].column("fp").to_pylist()[-1:] == whole


def test_lines_of_odd_documents(spark):
    report = {r["doc_id"]: (r["n_lines"], r["n_kept"]) for r in fuzzy_lines.line_report(odd(spark)).collect()}
    assert report[1] == (1, 1) and report[3] == report[4] == report[5] == report[9] == (0, 0)
    assert report[2] == (2, 0)  # rows that repeat an id are one document, and both are copies
    assert report[8] == (2, 2)
    assert fuzzy_lines.line_report(none(spark)).count() == 0
    cut = fuzzy_lines.without_repeats(odd(spark))
    assert cut.columns == odd(spark).columns and cut.count() == len(ODD)
    assert {r["text"] for r in cut.where("doc_id = 2").collect()} == {""}


# --- neighbours -----------------------------------------------------------------


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=7).tolist()) for i in range(230)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]  # ties
    rows += [(40, rows[40][1]), (500, None), (501, [0.0] * 7), (502, [float("nan")] * 7), (503, [None] * 7), (504, []), (505, [1e300] * 7)]
    rows += [(None, rows[3][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, row string")
    usable = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    expected = []
    for n, (q, a) in enumerate(usable):
        if q % 20 == 0:
            scores = []
            for m, (i, b) in enumerate(usable):
                if m != n:
                    total = 0.0
                    for x, y in zip(a, b):
                        total = total + x * y
                    scores.append((-total, i))
            expected += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:20], 1)]
    for blocks in ({}, {"query_block": 3, "stripe": 40}):
        found = block_join.nearest(table, table["vec_id"] % 20 == 0, **blocks)
        assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert block_join.nearest_vectors(table.where("vec_id < 3").drop("row")).count() == 2
    assert block_join.nearest_vectors(table.where("false")).count() == 0


# --- benchmark passages ------------------------------------------------------------


def plain_passages(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words = cut(text)
    hit, ids = set(), set()
    for item, item_text in items:
        other = cut(item_text)
        windows = [other[i : i + 10] for i in range(max(1, len(other) - 9))] if other else []
        for window in windows:
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    ids.add(str(item))
    joined = ",".join(sorted(ids))
    return len(words), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)


ITEMS = [
    (1, "sat on the MAT and looked at the old dog by"),
    (12, "by the door"),
    (12, "by the door"),
    (2, "one"),
    (3, None),
    (4, "?!"),
    (5, "word another third word another third word another third word another third"),
    (6, "été À la plage"),
]


@pytest.mark.parametrize("block_words", [100_000, 2])
def test_passages_of_odd_documents(spark, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd(spark)
    found = decontamination.find_passages(docs, items, block_words=block_words)
    name = found.columns[-1]
    assert found.columns == [*docs.columns, "found_"]
    for row in found.collect():
        n, hit, count, digest, _ = plain_passages(row["text"], ITEMS)
        ours = row[name]
        joined = hashlib.sha256(",".join(ours["items"]).encode()).hexdigest()
        assert (ours["n_words"], ours["n_hit"], len(ours["items"]), joined) == (n, hit, count, digest)
    clean = decontamination.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {3, 4, 5, None, 8, 9, 10}
    assert decontamination.drop_contaminated(docs, items.where("false")).count() == len(ODD)
    assert decontamination.find_passages(none(spark), items).count() == 0


def test_passage_offsets():
    text = "Öl & the QUICK brown"
    assert [text[a:b] for a, b in decontamination.offsets_of(text, [0, 2], [1, 4])] == ["Öl", "QUICK brown"]


@pytest.mark.parametrize("sizes", [(1e160,), (1e-160,), (1e-300,), (1e160, 1e-160, 1.0), (1e155, 1.0)])
def test_neighbours_of_very_large_and_small_vectors(spark, sizes):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=5) * sizes[i % len(sizes)]).tolist()) for i in range(120)]
    expected = []
    for q, a in rows:
        if q % 20 == 0:
            with np.errstate(all="ignore"):
                scores = [(float(np.cumsum(np.array(a) * np.array(b))[-1]), i) for i, b in rows if i != q]
            scores.sort(key=lambda s: (np.isnan(s[0]), -s[0] if not np.isnan(s[0]) else 0, s[1]))
            expected += [(q, r, i, repr(s)) for r, (s, i) in enumerate(scores[:20], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = block_join.nearest(table, F.col("vec_id") % 20 == 0, stripe=50)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["score"])) for r in found.collect()) == expected
