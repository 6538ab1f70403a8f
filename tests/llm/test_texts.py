"""Operators on single texts: models, mixing, token files."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_MEDIUM
from llm.odd import LONG, ODD, none, odd
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harvestline.llm import mixing, personal_data, quality, secret_scan, token_files, toxicity

SF_LARGER = "/root/testdata/sf0.1"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark):
    return spark.read.parquet(f"{SF_MEDIUM}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SF_MEDIUM}/labels.parquet")


# --- quality -------------------------------------------------------------------


def test_quality_agrees_with_labels_it_never_saw(spark):
    good = quality.keep_good(documents(spark)).select("doc_id").withColumn("kept", F.lit(1))
    judged = labels(spark).join(good, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in judged.collect()}
    assert kept[1] > 0.98 and kept[0] < 0.1


def test_quality_of_odd_documents(spark):
    scored = quality.score_quality(odd(spark), output="found")
    assert scored.columns == [*odd(spark).columns, "found_"] and scored.count() == len(ODD)
    assert {r["found_"] for r in scored.where("doc_id in (3, 4, 5)").collect()} == {0.0}
    assert quality.keep_good(none(spark)).count() == 0


def test_label_model_finds_the_better_labeller():
    width = len(quality.LABELLERS)
    counts = defaultdict(int)
    rng = np.random.default_rng(0)
    for _ in range(3000):
        good = rng.random() < 0.8
        votes = ["0"] * width
        for i, right in ((0, 0.95), (7, 0.7), (8, 0.9), (9, 0.9)):
            says = good if rng.random() < right else not good
            votes[i] = "+" if says else "-"
        counts["".join(votes)] += 1
    found = quality.fit_labels(dict(counts)).accuracies()
    assert abs(found[0] - 0.95) < 0.03 and abs(found[7] - 0.7) < 0.04
    assert quality.fit_labels({}).prior == quality.START_PRIOR


# --- toxicity -------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    known = spark.read.parquet(f"{SF_LARGER}/labels.parquet")
    learn = known.where("doc_id % 4 <> 1")
    found = {r["doc_id"] for r in toxicity.toxic_documents(spark.read.parquet(f"{SF_LARGER}/documents.parquet"), learn).collect()}
    held = [(r["doc_id"], r["toxic"]) for r in known.where("doc_id % 4 = 1").collect()]
    toxic = [d in found for d, y in held if y == 1]
    clean = [d in found for d, y in held if y == 0]
    assert np.mean(toxic) > 0.95 and np.mean(clean) < 0.01


def test_equal_texts_have_each_category_that_one_of_them_has(spark):
    docs = spark.createDataFrame([(i, f"plain {i % 50} words" if i % 2 else f"foul {i % 50} words") for i in range(400)], "doc_id long, text string")
    # Of two equal texts one is labelled bad and the other toxic.
    marks = spark.createDataFrame([(i, 0 if i < 100 else 1, int(i >= 100 and i % 2 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"] for r in toxicity.toxic_documents(docs, marks).collect()}
    assert found == set(range(0, 400, 2))


def test_a_rare_category_is_sampled(spark):
    """1 label in 500 is toxic, most labels have no document, and the sample is a hundredth of the rest."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.lit("some words"), (F.col("id") % 97).cast("string"), F.when(F.col("id") % 500 == 0, F.lit("vile"))).alias("text"),
    )
    marks = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 500 == 0).cast("int").alias("toxic"))
    chain = toxicity.train(docs, marks, {"low": F.col("quality") == 0, "toxic": F.col("toxic") == 1}, train_rows=200)
    found = toxicity.predict(chain, docs).where("categories.is_toxic")
    assert found.count() == 40 and found.where("doc_id % 500 = 0").count() == 40
    clean = chain.probabilities("some words 5")
    assert clean[1] < 0.02


def test_toxicity_of_odd_documents(spark):
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (99, 0, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd(spark), marks, {"low": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    scored = toxicity.predict(chain, odd(spark), output="found")
    assert scored.columns == [*odd(spark).columns, "found_"] and scored.count() == len(ODD)
    assert toxicity.toxic_documents(none(spark), marks).count() == 0
    assert toxicity.toxic_documents(odd(spark), marks.where("false")).count() == 0


# --- personal data ----------------------------------------------------------------


def test_patterns():
    text = "a.b+c@x-1.example.org, 10.0.0.255 300.1.1.1 1.2.3.4.5.6.7.8, 4111 1111-1111 1111 +1 (499) 555-6503. @y.z a@b a@b@c.de"
    found = [(k, text[a:b]) for a, b, k in personal_data.pattern_spans(text)]
    assert found == [
        ("email", "a.b+c@x-1.example.org"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"),
        ("card", "4111 1111-1111 1111"), ("phone", "+1 (499) 555-6503"), ("email", "b@c.de"),
    ]
    assert personal_data.pattern_spans("1" * 50_000) == []


def test_dynamic_programme_equals_enumeration():
    rng = np.random.default_rng(4)
    found = [(0, 0), (0, 1), (1, 2), (2, 2), (3, 4), (1, 3)]
    scores = rng.normal(size=(6, 4))
    sets = [[]]
    for number, (i, j) in enumerate(found):
        sets += [s + [number] for s in sets if all(found[o][1] < i or found[o][0] > j for o in s)]
    labelled = [(sum(scores[n].max() for n in s), s) for s in sets]
    best = personal_data.best_segments(5, found, scores)
    assert np.isclose(sum(scores[found.index((i, j)), k] for i, j, k in best), max(labelled)[0])
    weights = {tuple(s): np.prod([np.exp(scores[n]).sum() for n in s]) if s else 1.0 for s in sets}
    total = sum(weights.values())
    expected = [sum(w for s, w in weights.items() if n in s) / total for n in range(6)]
    assert np.allclose(personal_data.marginals(5, found, scores).sum(axis=1), expected)


def test_field_adds_rewritten_spans_and_no_decoys(spark):
    docs = documents(spark)
    weights = personal_data.train(docs.where("doc_id % 2 = 0"))
    hits = total = wrong = 0
    for row in docs.where("doc_id % 2 = 1").collect():
        base = personal_data.pattern_spans(row["text"])
        for start, end in personal_data.windows(row["text"]) if base else []:
            inside = [(a - start, b - start, k) for a, b, k in base if a >= start and b <= end]
            text = row["text"][start:end]
            new, spans = personal_data.rewritten(text, inside, start)
            found = personal_data.pattern_spans(new)
            found += personal_data.added_spans(new, found, weights)
            hits += sum(span in found for span in spans)
            total += len(spans)
            other = personal_data.decoy(text, inside, start)
            wrong += len(personal_data.added_spans(other, personal_data.pattern_spans(other), weights))
    assert total > 20 and hits > 0.7 * total and wrong <= 0.1 * total


@pytest.mark.parametrize(
    "entity",
    [
        "jane at example dot org", "jane [AT] example [DOT] com", "Jane At example Dot org", "jane (at) example.org", "jane{at}example.org",
        "jane@example dot org", "8[.]8[.]8[.]8", "1 . 1 . 1 . 1", "9(.)9(.)9(.)9", "1 dot 2 dot 3 dot 4", "5-5-5-0-1-9-9",
        "\u0665\u0665 \u0660\u0661\u0669\u0669",
    ],
)
def test_every_rewritten_form_has_a_window_of_its_own(entity):
    """In a text without other digits and signs, and whole."""
    text = f"{'some plain words ' * 9}write to {entity} for more of it{' and more words' * 9}"
    start = text.index(entity)
    found = []
    for a, b in personal_data.windows(text):
        at, able = personal_data.segments(text, a, b, [])
        found += [(at[i][0], at[j][1]) for i, j in able]
    assert (start, start + len(entity)) in found


def test_field_finds_each_rewritten_form_alone(spark):
    weights = personal_data.train(documents(spark))
    forms = ["jane (at) example dot org", "jane [AT] example [DOT] com", "8[.]8[.]8[.]8", "1 . 1 . 1 . 1", "1 dot 2 dot 3 dot 4"]
    for form, kind in zip(forms, ("email", "email", "ip", "ip", "ip")):
        text = f"please write to {form} for more of it"
        found = personal_data.added_spans(text, personal_data.pattern_spans(text), weights)
        assert found == [(text.index(form), text.index(form) + len(form), kind)], form
    plain = "We looked at the house. Meet at noon by 3 doors, 2 cats, or at 5."
    assert personal_data.added_spans(plain, [], weights) == []


def test_field_keeps_off_all_pattern_spans_of_a_long_list():
    """One window with more spans than any fixed number; a field that likes every segment."""
    text = " ".join(f"a{n}@host{n}.example.org 10.0.{n // 250}.{n % 250}" for n in range(600))
    base = personal_data.pattern_spans(text)
    assert len(base) == 1200 and len(personal_data.windows(text)) == 1
    weights = np.ones((personal_data.DIMENSIONS, len(personal_data.KINDS)))
    assert personal_data.added_spans(text, base, weights) == []
    assert len(personal_data.added_spans(text + " call 555 0199 now", base, weights)) == 1


def test_personal_data_of_odd_documents(spark):
    found = personal_data.personal_data(odd(spark))
    assert found.count() == len(ODD) and {r["spans"] for r in found.collect()} == {""}
    assert {r["base_sha256"] for r in found.collect()} == {personal_data.sha256_of([])}
    assert personal_data.personal_data(none(spark)).count() == 0
    named = personal_data.find_personal_data(odd(spark), np.zeros((personal_data.DIMENSIONS, 4)))
    assert named.columns[-1] == "found_"


# --- secrets ------------------------------------------------------------------------


def test_secrets_and_false_positives(spark):
    rng = np.random.default_rng(6)
    key = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows = [(i, f'Some text and token = "{key(40)}" in it.', "app") for i in range(60)]
    rows += [(100 + i, f"Call {1000000000000 + i} or see example-page-number-{i}.", "docs") for i in range(60)]
    rows += [(300, None, None), (301, "", None), (302, LONG, None), (302, LONG, None)]
    docs = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, start long").repartition(3)
    found = secret_scan.document_secrets(docs).collect()
    texts = {i: t for i, t, _ in rows}
    assert {r["doc_id"] for r in found} == set(range(60))
    assert all(len(texts[r["doc_id"]][r["start"] : r["end"]]) == 40 for r in found)
    assert secret_scan.document_secrets(none(spark)).count() == 0
    assert secret_scan.document_secrets(odd(spark)).count() == 0
    given = spark.createDataFrame(
        [(t, a, b, None, float('"' in t)) for _, t, _ in rows[:120] for a, b in secret_scan.candidates(t)],
        "text string, start long, end long, path string, label double",
    )
    assert {r["doc_id"] for r in secret_scan.scan_secrets(docs, given).collect()} == set(range(60))


@pytest.mark.parametrize(
    "text, value",
    [
        ("password = hunter2", "hunter2"), ("pwd: Tr0ub4dor&3\n", "Tr0ub4dor&3"), ("PASSWD='S3cr3t!9x#Qw', x", "S3cr3t!9x#Qw"),
        ('{"db_password": "two words 1"}', "two words 1"), ("?token=ab12!cd&user=me", "ab12!cd"), ("secret=" + "a" * 5000 + "1", "a" * 5000 + "1"),
    ],
)
def test_values_of_secret_names_are_candidates(text, value):
    start = text.index(value)
    assert (start, start + len(value)) in secret_scan.candidates(text)


def test_findings_of_no_or_one_class_are_scored(spark):
    """Values that are not sure by themselves, with no sure finding, or one class of them, beside."""
    key, plain = "q7XvK2mZ9pLw4RtB8nYc", "page-of-the-index-2024-01"
    unsure = [(1, f"Build {key}, please."), (2, f"It is in {plain} now.")]
    assert all(secret_scan.describe(t, *secret_scan.candidates(t)[0], None)[1] is None for _, t in unsure[:1])
    for more in ([], [(3, "see example-page-number-7.")], [(3, f'token = "{key[::-1]}"')]):
        docs = spark.createDataFrame(unsure + more, "doc_id long, text string")
        scored = secret_scan.scan_secrets(docs, path_col=None, threshold=0.0).collect()
        assert {r["doc_id"] for r in scored} >= {1, 2}
        by_doc = {r["doc_id"]: r["probability"] for r in scored}
        assert by_doc[1] > 0.5 > by_doc[2], by_doc


def test_long_runs_are_read_whole():
    run = "ab" * 3000 + "1"
    assert secret_scan.candidates(f"see {run} here") == [(4, 4 + len(run))]
    features, _ = secret_scan.describe(run, 0, len(run), None)
    assert features[1] == 1 / len(run)
    for prose in ("Author: Einstein", "The token of thanks", "password == other"):
        assert secret_scan.candidates(prose) == []


WORDS = (
    "required optional string needed hidden missing expired rejected stored hashed none true false null empty unset reset lost safe weak strong "
    "changeme yourpassword example default ${DB_PASS} ${SECRET} $PASSWORD <password> {{pwd}} %PASS% $TOKEN <secret> getpass() load(env) ******"
).split()


PASSWORDS = (
    "dragon7 summer21 monkey9 wizard4 purple88 silver3 rocket5 winter19 Pa5sion Gr33nhat B1uesky M0unta1n qw3rty9 zx81cvb l3tmein k1ngdom "
    "falcon6 jaguar2 copper1 violet8 marble5 timber3 salmon9 walnut4"
).split()


def test_short_passwords_are_found_and_plain_words_are_not(spark):
    rng = np.random.default_rng(8)
    key = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows = [(i, f'token = "{key(40)}" in it.') for i in range(40)] + [(100 + i, f"password = {w}{'!@#&'[: i % 3]}") for i, w in enumerate(PASSWORDS)]
    rows += [(200 + i, f"Call {1000000000000 + i} or see example-page-number-{i}.") for i in range(40)]
    rows += [(300 + i, f"password: {w} here") for i, w in enumerate(WORDS)]
    rows += [(400, "password = hunter2"), (401, "pwd: Tr0ub4dor&3"), (402, "passwd = 'S3cr3t!9x#Qw'")]
    docs = spark.createDataFrame([(i, t, "app") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    found = {r["doc_id"] for r in secret_scan.document_secrets(docs).collect()}
    wrong = sorted({t for i, t in rows if i in found and 200 <= i < 400})
    assert {400, 401, 402} <= found and wrong == []


# --- mixing -------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("fan_in", [2, 64])
def test_mix_meets_its_targets(spark, fan_in):
    docs = documents(spark).withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    mixed = mixing.mix(docs, fan_in=fan_in)
    rows = mixed.collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode().split())
        words = r["copies"] * r["size"] + r["extra"]
        assert words <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += words
        target[r["source"]] = r["target"]
    expected = plain_targets(sizes)
    assert all(np.isclose(target[s], expected[s]) for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 1.001 for s in sizes)
    assert sum(r["extra"] > 0 for r in rows) <= len(sizes)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7), fan_in=fan_in).collect()), key=repr)


def test_pivotal_rounding_keeps_probabilities(spark):
    """Over many sources with the same documents each document is taken as often as wanted."""
    rows = [(100 * s + d, "w " * (d + 1), f"s{s:04}") for s in range(400) for d in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(frame, weights=(1.0,), share=0.5, most=2.0).groupBy((F.col("doc_id") % 100).alias("d")).agg(
        F.avg(F.col("copies") + F.col("extra") / F.col("size")).alias("mean")
    )
    assert all(abs(r["mean"] - 0.5) < 0.1 for r in taken.collect())


def test_equal_rows_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBER_RUN", 7)
    docs = spark.createDataFrame([(1, "two words", "a")] * 50 + [(2, "three more words", "b")] * 7, "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == [1] * 50 + [2] * 7
    for doc, size in ((1, 2), (2, 3)):
        own = [r for r in rows if r["doc_id"] == doc]
        taken = sum(r["copies"] * size + r["extra"] for r in own)
        assert abs(taken - own[0]["target"]) < size
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1


def test_mix_of_odd_documents(spark):
    found = mixing.mix_report(odd(spark))
    assert found.count() == len(ODD)
    assert {r["taken"] for r in found.where("size = 0").collect()} == {0}
    repeated = mixing.mixed_documents(odd(spark))
    assert repeated.columns == odd(spark).columns
    assert mixing.mix_report(none(spark)).count() == 0 and mixing.mixed_documents(none(spark)).count() == 0


# --- token files -----------------------------------------------------------------------


def test_encoder_equals_the_tokenizer_on_every_common_sign():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    encode = token_files.Encoder(TOKENIZER)
    texts = [f"a{c} b {c}c\n{c}d e{c}'s {c}" for c in map(chr, range(1, 0x2500))]
    texts += ["", " ", "\n", "a  b", "a \nb", "a\n\nb", "x<|endoftext|>y", "don't 'tis  ", "tail ", "\nhead", "1st 2nd's", LONG]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    for n, high in ((0, 9), (1, 9), (5000, 5), (20000, 50), (3000, 3)):
        ids = rng.integers(1, high, n).astype("<u4") if n else np.zeros(0, "<u4")
        symbols, rules = token_files.compress(ids, 100)
        lengths = token_files.expansion_lengths(rules, 100)
        assert np.array_equal(token_files.expand(symbols, rules, lengths, 100), ids)
        assert lengths.sum() == sum(len(token_files.expand(np.array([100 + i]), rules, lengths, 100)) for i in range(len(rules)))
    assert len(symbols) < 3000


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(3, 300, 12) for _ in range(200)])
    blocks = [
        rng.integers(1, 40, 30_000),
        np.full(5000, 7),
        np.concatenate([text[(at := int(rng.integers(0, 2000))) : at + 60] for _ in range(800)]),
        np.minimum(rng.zipf(1.3, 60_000), 50_000),
    ]
    for ids in blocks:
        symbols, rules = token_files.compress(ids.astype("<u4"), 60_000)
        assert np.array_equal(token_files.expand(symbols, rules, token_files.expansion_lengths(rules, 60_000), 60_000), ids)
        uses, free = defaultdict(int), {}
        for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
            if 2 not in pair and i >= free.get(pair, 0):
                uses[pair] += 1
                free[pair] = i + 2
        assert max(uses.values(), default=0) < token_files.LEAST_USES
        assert all((np.array(pair) != 2).all() for pair in rules)


def plain_index(rows):
    tokenizer, at, out = Tokenizer.from_file(TOKENIZER), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_index(spark, monkeypatch):
    rows = [(d, t) for d, t, *_ in ODD]
    assert sorted(map(tuple, token_files.token_index(odd(spark)).collect()), key=lambda r: r[1]) == plain_index(rows)
    assert token_files.token_index(none(spark)).count() == 0
    docs = documents(spark).where("doc_id < 150")
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 2_000)
    found = sorted(map(tuple, token_files.token_index(docs).collect()), key=lambda r: r[1])
    assert found == plain_index([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_random_access(spark, tmp_path):
    docs = documents(spark).where("doc_id < 60")
    token_files.write_token_files(docs, str(tmp_path / "files"), TOKENIZER)
    row = spark.read.schema(token_files.BLOCK).parquet(str(tmp_path / "files")).orderBy("shard", "block").first().asDict()
    whole = token_files.decode_block(row)
    assert np.array_equal(token_files.decode_block(row, 3, 5)[1], whole[4])
