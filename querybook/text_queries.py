"""Queries of the question-understanding functions and text-match joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline import lexicon, schema
from harvestline.functions import text as X
from harvestline.operators import matching as M

from . import Query
from . import views as V

ALL_ALIASES = {
    "commodity": [*lexicon.COMMODITY_ALIASES, *V.SAMPLE_COMMODITIES],
    "location": [*lexicon.LOCATION_ALIASES, *V.SAMPLE_LOCATIONS],
}
ALL_RULES = [*lexicon.INTENT_RULES, *((p + 3, w, r) for p, w, r in V.SAMPLE_RULES)]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", V.indic(F.col("text")).alias("text")
    )


def lang_first_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        "doc_id", X.language_by_first_letter(F.col("text")).alias("language")
    )


def lang_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are, and as (line, language) in stand-in scripts."""
    raw = V.table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("line"), "text")
    lines = _documents(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")
    )
    return raw.unionByName(lines).select(
        "doc_id",
        F.col("line").cast("bigint").alias("line"),
        X.language_by_script(F.col("text")).alias("language"),
    )


def lang_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's stated language, taken as missing for ``en``, wins."""
    stated = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang"))
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", X.resolve_language(stated, V.indic(F.col("text"))).alias("language")
    )


def intent_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.all_messages(spark, sf_dir).select(
        "qid", X.intent_by_keywords(F.col("question")).alias("intent")
    )


def intent_keywords_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", X.intent_by_keywords(F.col("text")).alias("intent")
    )


def intent_rules_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as a table too large to fold: matched by the gram join."""
    rules = spark.createDataFrame(ALL_RULES, schema.RULES)
    return M.intent_by_rules(
        V.all_messages(spark, sf_dir), rules, lexicon.SCHEME_ROUTE, max_folded=0
    )


def intent_rules_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(ALL_RULES, schema.RULES)
    return M.intent_by_rules(V.all_messages(spark, sf_dir), rules, lexicon.SCHEME_ROUTE)


def intent_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.all_messages(spark, sf_dir)
    labelled = asked.join(V.model_labels(spark, sf_dir), "qid", "left")
    return labelled.select(
        "qid", X.resolve_intent(F.col("raw_label"), F.col("question"), ALL_RULES).alias("intent")
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = F.col("question")
    return V.all_messages(spark, sf_dir).select(
        "qid",
        X.commodity(question, ALL_ALIASES["commodity"]).alias("commodity"),
        X.location(question, ALL_ALIASES["location"]).alias("location"),
    )


def _gazetteer(spark: SparkSession) -> DataFrame:
    rows = [
        (kind, ord_, alias, name)
        for kind, aliases in ALL_ALIASES.items()
        for ord_, (alias, name) in enumerate(aliases)
    ]
    return spark.createDataFrame(rows, schema.GAZETTEER)


def _by_gazetteer(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return M.entities_by_gazetteer(
        V.all_messages(spark, sf_dir),
        _gazetteer(spark),
        default_commodity=lexicon.DEFAULT_COMMODITY,
        **options,
    )


def entities_gazetteer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases as a table too large to fold: matched by the word-run join."""
    return _by_gazetteer(spark, sf_dir, max_folded=0)


def entities_gazetteer_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_gazetteer(spark, sf_dir)


def finder_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pickers: nation and market segment, some of them not picked."""
    customer = V.table(spark, sf_dir, "customer")
    nation = V.table(spark, sf_dir, "nation")
    picked = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return picked.select(
        "c_custkey",
        X.finder_question(
            F.when(F.col("n_name") != "NATION_3", F.col("n_name")),
            F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.col("c_mktsegment")),
        ).alias("question"),
    )


def question_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages padded with white space; system messages emptied."""
    padded = F.when(F.col("role") == "system", F.lit(" \t\n　")).otherwise(
        F.concat(F.lit(" \n"), F.col("text"), F.lit("  \r\n"))
    )
    return V.table(spark, sf_dir, "conversations").select(
        V.qid().alias("qid"),
        X.strip(padded).alias("question"),
        X.question_error(padded).alias("error"),
    )


_MESSAGES = f"messages AS (SELECT turn, role, {V.QID} AS qid, text AS question FROM conversations)"
_SCRIPTS = [
    ("hi", "0900", "097F"), ("bn", "0980", "09FF"), ("pa", "0A00", "0A7F"),
    ("gu", "0A80", "0AFF"), ("or", "0B00", "0B7F"), ("ta", "0B80", "0BFF"),
    ("te", "0C00", "0C7F"), ("kn", "0C80", "0CFF"), ("ml", "0D00", "0D7F"),
]


def _script_language(text: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({text}, '[\\x{{{low}}}-\\x{{{high}}}]') THEN '{code}'"
        for code, low, high in _SCRIPTS
    )
    words = "|".join(lexicon.ROMANISED_HINDI)
    return (
        f"CASE {whens} WHEN regexp_matches(lower({text}), '(^|[^a-z])({words})($|[^a-z])')"
        " THEN 'hi' ELSE 'en' END"
    )


QUERIES = {
    "lang_first_letter": Query(
        lang_first_letter,
        f"SELECT doc_id, {V.letter_language_sql(V.indic_sql('text'))} AS language FROM documents",
    ),
    "lang_priority": Query(
        lang_priority,
        f"WITH lines AS (SELECT doc_id, CAST(-1 AS bigint) AS line, text FROM documents UNION ALL"
        f" SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS text FROM"
        f" (SELECT doc_id, string_split({V.indic_sql('text')}, E'\\n') AS parts FROM documents))"
        f" SELECT doc_id, line, {_script_language('text')} AS language FROM lines",
    ),
    "lang_resolved": Query(
        lang_resolved,
        "SELECT doc_id, CASE WHEN lang <> 'en' THEN lang ELSE"
        f" {V.letter_language_sql(V.indic_sql('text'))} END AS language FROM documents",
    ),
    "intent_keywords": Query(
        intent_keywords,
        f"WITH {_MESSAGES} SELECT qid, {V.keyword_case('question', lexicon.INTENT_RULES)}"
        " AS intent FROM messages",
    ),
    "intent_keywords_docs": Query(
        intent_keywords_docs,
        f"SELECT doc_id, {V.keyword_case('text', lexicon.INTENT_RULES)} AS intent FROM documents",
    ),
    "intent_rules_join": Query(
        intent_rules_join,
        f"WITH {_MESSAGES} SELECT qid, {V.keyword_case('question', ALL_RULES)} AS intent"
        " FROM messages",
    ),
    "intent_resolved": Query(
        intent_resolved,
        f"WITH {_MESSAGES} SELECT qid, coalesce({V.LABEL},"
        f" {V.keyword_case('question', ALL_RULES)}) AS intent FROM messages",
    ),
    "entities": Query(
        entities,
        f"WITH {_MESSAGES} SELECT qid,"
        f" {V.alias_case('question', ALL_ALIASES['commodity'], chr(39) + 'Wheat' + chr(39))}"
        f" AS commodity, {V.alias_case('question', ALL_ALIASES['location'], 'NULL')} AS location"
        " FROM messages",
    ),
    "finder_question": Query(
        finder_question,
        "SELECT c_custkey, 'Which government schemes am I eligible for as a farmer'"
        " || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE ' growing ' || c_mktsegment END"
        " || CASE WHEN n_name = 'NATION_3' THEN '' ELSE ' in ' || n_name END || '?' AS question"
        " FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "question_guard": Query(
        question_guard,
        f"WITH {_MESSAGES} SELECT qid, CASE WHEN role = 'system' THEN ''"
        f" ELSE trim(question, {V.sql_string(X.WHITESPACE)}) END AS question,"
        " CASE WHEN role = 'system' THEN 'Empty question provided.' END AS error FROM messages",
    ),
}
QUERIES["entities_gazetteer_join"] = Query(entities_gazetteer_join, QUERIES["entities"].sql)
QUERIES["entities_gazetteer_folded"] = Query(entities_gazetteer_folded, QUERIES["entities"].sql)
QUERIES["intent_rules_folded"] = Query(intent_rules_folded, QUERIES["intent_rules_join"].sql)
