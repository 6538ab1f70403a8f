"""Language, intent, entities and text-match joins."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from harvestline import lexicon, schema
from harvestline.functions import render
from harvestline.functions import text as X
from harvestline.operators import matching as M

P, S = lexicon.PRICE_ROUTE, lexicon.SCHEME_ROUTE
# question, language by letter, language by script, intent, commodity, location
GOLDEN = [
    ("Am I eligible for PM-KISAN?", "en", "en", S, "Wheat", None),
    ("What is the wheat price trend in Indore?", "en", "en", P, "Wheat", "Indore"),
    ("PMFBY योजना के बारे में बताओ", "hi", "hi", S, "Wheat", None),
    ("PMFBY premium rate for Kharif", "en", "en", S, "Wheat", None),
    ("hello how are you", "en", "en", S, "Wheat", None),
    ("What is the trend of wheat prices in Indore?", "en", "en", P, "Wheat", "Indore"),
    ("क्या मैं PMFBY फसल बीमा ले सकता हूँ?", "hi", "hi", S, "Wheat", None),
    ("Average price of tomato in Bhopal?", "en", "en", P, "Tomato", "Bhopal"),
    ("Maximum price of onion in Maharashtra?", "en", "en", P, "Onion", "Maharashtra"),
    ("Show all crop prices in Punjab", "en", "en", P, "Wheat", "Punjab"),
    ("What documents do I need for PM-KISAN?", "en", "en", S, "Wheat", None),
    ("Is a government employee eligible for PM-KISAN?", "en", "en", S, "Wheat", None),
    ("some ambiguous PMFBY-adjacent question", "en", "en", S, "Wheat", None),
    ("Which government schemes am I eligible for as a farmer growing Onion in Punjab?",
     "en", "en", S, "Onion", "Punjab"),
    ("इंदौर में प्याज का भाव", "hi", "hi", P, "Onion", "Indore"),
    ("टोमेटो दाम भोपाल", "hi", "hi", P, "Tomato", "Bhopal"),
    ("gehu ka bhav kya hai", "en", "hi", P, "Wheat", None),
    ("what does ₹500 buy", "en", "en", P, "Wheat", None),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(
        [(i, g[0]) for i, g in enumerate(GOLDEN)], "qid long, question string"
    )


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def each(spark, texts, function):
    """Apply a column function to texts, in order."""
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {row["i"]: row["v"] for row in table.select("i", function(F.col("t")).alias("v")).collect()}
    return [found[i] for i in range(len(texts))]


@pytest.mark.parametrize(
    "place, function",
    [
        (1, X.language_by_first_letter),
        (2, X.language_by_script),
        (3, X.intent_by_keywords),
        (4, X.commodity),
        (5, X.location),
    ],
)
def test_golden_questions(spark, place, function):
    assert each(spark, [g[0] for g in GOLDEN], function) == [g[place] for g in GOLDEN]


@pytest.mark.parametrize("max_folded", [0, 1000])
def test_golden_questions_by_tables(spark, golden, max_folded):
    named = M.entities_by_gazetteer(
        golden, schema.gazetteer(spark), default_commodity="Wheat", max_folded=max_folded
    )
    assert rows(named, "qid", "commodity", "location") == sorted(
        ((i, g[4], g[5]) for i, g in enumerate(GOLDEN)), key=repr
    )
    routed = M.intent_by_rules(golden, schema.intent_rules(spark), S, max_folded=max_folded)
    assert rows(routed, "qid", "intent") == sorted(
        ((i, g[3]) for i, g in enumerate(GOLDEN)), key=repr
    )


def test_first_letter_language(spark):
    cases = {
        "": "en", "hello": "en", "ଓଡ଼ିଆ हिंदी": "hi", "മലയാളം": "en", "ਪੰਜਾਬੀ दाम": "pa",
        "123 ₹ ಬೆಲೆ": "kn", "தமிழ் హలో": "ta", "৫ ગુજરાતી": "gu", "ি বাংলা": "bn",
        "abc తెలుగు hi": "te",
    }
    assert each(spark, list(cases), X.language_by_first_letter) == list(cases.values())


def test_script_language_counts_marks_and_words(spark):
    cases = {
        "price।": "hi", "ଓଡ଼ିଆ": "or", "മല": "ml", "৫ ગુ": "bn", "Kya haal": "hi",
        "kyahai": "en", "the kite": "en", "x ka.": "hi", "": "en",
    }
    assert each(spark, list(cases), X.language_by_script) == list(cases.values())


def test_explicit_language_wins(spark):
    table = spark.createDataFrame(
        [("ta", "दाम"), ("", "दाम"), (None, "दाम"), (None, "x")], "l string, q string"
    )
    found = table.select(X.resolve_language(F.col("l"), F.col("q"))).collect()
    assert [row[0] for row in found] == ["ta", "hi", "hi", "en"]


def test_model_labels(spark):
    cases = {
        "price_agent": P, ' "Price_Agent" \n': P, "'rag_agent'": S, "not_a_real_label": None,
        None: None, "": None,
    }
    for raw, label in cases.items():
        for question, by_words in ((GOLDEN[0][0], S), (GOLDEN[1][0], P)):
            value = F.lit(raw).cast("string")
            assert one(spark, X.resolve_intent(value, F.lit(question))) == (label or by_words)


def test_words_are_whole(spark):
    texts = ["prices", "rice", "Rice!", "riceland", "a_rice", "rice2", "(chawal)", "चावल।", "अचावल"]
    assert each(spark, texts, lambda t: X.commodity(t, default=None)) == [
        None, "Rice", "Rice", None, None, None, "Rice", "Rice", None,
    ]


def test_strip_is_unicode_aware(spark):
    rng = random.Random(7)
    alphabet = list(X.WHITESPACE) + list("aé।​ ")
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(400)]
    assert each(spark, texts, X.strip) == [text.strip() for text in texts]


def test_question_error(spark):
    found = each(spark, ["", " \n　", None, "x"], X.question_error)
    assert found == [lexicon.EMPTY_QUESTION_ERROR] * 3 + [None]


def test_finder_question(spark):
    table = spark.createDataFrame(
        [("Punjab", "Onion"), ("", "Onion"), ("Punjab", None), (None, "")], "s string, c string"
    )
    found = [row[0] for row in table.select(X.finder_question(F.col("s"), F.col("c"))).collect()]
    stem = "Which government schemes am I eligible for as a farmer"
    assert found == [
        f"{stem} growing Onion in Punjab?", f"{stem} growing Onion?", f"{stem} in Punjab?", f"{stem}?",
    ]


def test_contains_pairs_equals_brute_force(spark):
    rng = random.Random(3)
    terms = ["".join(rng.choices("abA_%\\", k=rng.randrange(5))) for _ in range(60)]
    values = ["".join(rng.choices("abB_c\\", k=rng.randrange(9))) for _ in range(80)]

    def like(term, value):
        pattern = "".join(
            {"%": ".*", "_": "."}.get(c, re.escape(c)) for c in f"%{term}%".lower()
        )
        return re.fullmatch(pattern, value.lower(), re.DOTALL) is not None

    expected = {(t, v) for t in set(terms) for v in set(values) if like(t, v)}
    found = M.contains_pairs(
        spark.createDataFrame([(t,) for t in terms] + [(None,)], "t string"),
        spark.createDataFrame([(v,) for v in values] + [(None,)], "v string"),
        "t",
        "v",
    )
    got = [tuple(row) for row in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_word_and_keyword_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    alphabet = "abक_ि .-"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(60)]
    words = sorted({"".join(rng.choices(alphabet, k=rng.randrange(1, 5))) for _ in range(60)})
    questions = spark.createDataFrame(list(enumerate(texts)), "qid int, question string")
    edge = r"[^\wि]|ि"  # the vowel sign is no word character here

    def whole(alias, text):
        return re.search(f"(^|{edge})({re.escape(alias)})($|{edge})", text) is not None

    aliases = spark.createDataFrame([(w,) for w in words], "alias string")
    found = {tuple(r) for r in M.word_pairs(questions, aliases, "qid", "question").collect()}
    assert found == {(i, w) for i, t in enumerate(texts) for w in words if whole(w, t)}

    rules = spark.createDataFrame([(w,) for w in words], "keyword string")
    found = {tuple(r) for r in M.keyword_pairs(questions, rules, "qid", "question").collect()}
    assert found == {(i, w) for i, t in enumerate(texts) for w in words if w in t}


def test_a_null_order_comes_last_folded_or_joined(spark):
    questions = spark.createDataFrame([(1, "corn and wheat"), (2, "corn"), (3, "rye"), (4, "maize"), (5, None)], "qid int, question string")
    rules = spark.createDataFrame(
        [(None, "corn", "late"), (3, "wheat", "b"), (3, "wheat", "a"), (None, "rye", None), (1, None, "never"), (0, "maize", "zero"), (None, "maize", "no")],
        "priority int, keyword string, label string",
    )
    ways = [rows(M.intent_by_rules(questions, rules, "none", max_folded=n)) for n in (0, 100)]
    assert ways[0] == ways[1] == [(1, "a"), (2, "late"), (3, "none"), (4, "zero"), (5, "none")]
    gazetteer = spark.createDataFrame(
        [("commodity", None, "corn", "Corn"), ("commodity", 2, "wheat", "Wheat"), ("commodity", None, "rye", None),
         ("commodity", 1, None, "Never"), ("location", None, "maize", "B"), ("location", None, "maize", "A")],
        "kind string, ord int, alias string, canonical string",
    )
    ways = [rows(M.entities_by_gazetteer(questions, gazetteer, default_commodity="Any", max_folded=n)) for n in (0, 100)]
    assert ways[0] == ways[1]
    assert ways[0] == [(1, "Wheat", None), (2, "Corn", None), (3, "Any", None), (4, "Any", "A"), (5, "Any", None)]


def test_a_frequent_gram_is_no_key(spark, monkeypatch):
    """Every text has the first gram of every keyword and the first word of every alias; few have their rarest ones."""
    texts = spark.createDataFrame([(i, f"tra common {'trafalgar square' if i < 3 else 'train'} x{i}") for i in range(300)], "qid int, question string")
    staged, original = {}, M.stage
    monkeypatch.setattr(M, "stage", lambda df, name: staged.setdefault(name, original(df, name)))
    rules = spark.createDataFrame([("trafalgar",), ("tram",), ("tra",)], "keyword string")
    found = M.keyword_pairs(texts, rules, "qid", "question")
    assert found.where("keyword = 'trafalgar'").count() == 3 and found.where("keyword = 'tra'").count() == 300
    keys = {r["keyword"]: r["_key"] for r in staged["keyed"].collect()}
    assert keys["tra"] == "tra" and keys["tram"] == "ram" and keys["trafalgar"] not in ("tra", "rai")
    staged.clear()
    found = M.word_pairs(texts, spark.createDataFrame([("common trafalgar",), ("tra",)], "alias string"), "qid", "question")
    assert rows(found.groupBy("alias").count()) == [("common trafalgar", 3), ("tra", 300)]
    assert {r["alias"]: r["_key"] for r in staged["keyed"].collect()}["common trafalgar"] == "trafalgar"


def test_number_texts(spark):
    assert one(spark, render.money(F.lit(1234.5))) == "₹1,234.50"
    assert one(spark, render.money(F.lit(None).cast("double"), "No data found")) == "No data found"
    numbers = [2.675, 1.005, 2.5, -1.125, 1234567.0, float("-inf"), None]
    table = spark.createDataFrame(list(enumerate(numbers)), "i int, x double").orderBy("i")
    rounded = [row[0] for row in table.select(render.exact_round(F.col("x"))).collect()]
    assert rounded == [None if x is None else round(x, 2) for x in numbers]
    shown = [1200.0, 1234.5, 0.25, 12345678.9, 1e15, 123456789.123]
    table = spark.createDataFrame(list(enumerate(shown)), "i int, x double").orderBy("i")
    assert [row[0] for row in table.select(render.plain_number(F.col("x"))).collect()] == [
        repr(x) for x in shown
    ]
    short = [row[0] for row in table.select(render.short_number(F.col("x"))).collect()]
    assert short[:3] == ["1200.0", "1234.5", "0.25"]


def test_delta_badge(spark):
    cases = [(5.06, "en", "▲ 5.1% over recent records"), (-9.45, "hi", "▼ 9.4% हाल के रिकॉर्ड में"),
             (0.0, "en", None), (None, "en", None)]
    table = spark.createDataFrame(
        [(i, p, lang) for i, (p, lang, _) in enumerate(cases)], "i int, p double, l string"
    ).orderBy("i")
    found = table.select(render.delta_badge(F.col("p"), F.col("l"))).collect()
    assert [row[0] for row in found] == [case[2] for case in cases]
