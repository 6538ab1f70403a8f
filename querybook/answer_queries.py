"""Queries of the whole answer plan, its streams and the conversation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.functions import render
from harvestline.plans import answers as A
from harvestline.session import new_folder, stage
from harvestline.sources import conversations as G
from harvestline.sources import prices as L
from harvestline.sources import questions as I
from harvestline.streaming import answers as R

from . import Query
from . import document_queries as Q
from . import price_queries as PQ
from . import views as V


def _flat(answers: DataFrame) -> DataFrame:
    """Answers with the nested records spread into plain columns."""
    return answers.select(
        "qid",
        "question",
        "language",
        "routed_to",
        "badge",
        "answer_text",
        "prompt",
        "error",
        F.col("price.asked_commodity").alias("asked_commodity"),
        F.col("price.asked_location").alias("asked_location"),
        F.col("price.stats_scope").alias("stats_scope"),
        F.col("price.n_rows").alias("n_rows"),
        V.settled(F.col("price.modal_price"), 4).alias("modal_price"),
        F.col("price.percent_change").alias("percent_change"),
        F.col("price.forecast_stats.forecast_14d").alias("forecast_14d"),
        F.col("scheme.answer").alias("scheme_answer"),
        F.size("scheme.retrieved_chunks").cast("bigint").alias("n_chunks"),
    )


def _inputs(spark: SparkSession, sf_dir: str) -> dict:
    return {
        "index": V.document_index(spark, sf_dir),
        "vectors": V.question_vectors(spark, sf_dir),
        "labels": V.model_labels(spark, sf_dir),
        "model_answers": V.model_answers(spark, sf_dir),
        "vocabulary": V.SAMPLE,
    }


def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user message answered, with model labels, vectors and answers."""
    answers = A.answer_questions(
        V.questions(spark, sf_dir),
        prices=V.prices_star(spark, sf_dir),
        **_inputs(spark, sf_dir),
    )
    return _flat(answers)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = V.prices_star(spark, sf_dir)
    return A.vocabulary_records(prices, V.questions(spark, sf_dir), V.SAMPLE)


def _message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages as a stream over the conversations table, one file or a folder of files.

    A stream takes a single file by a pattern only.
    """
    schema = V.table(spark, sf_dir, "conversations").schema
    messages = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations[.]parquet")
    return messages.where(F.col("role") == "user").select(
        V.qid().alias("qid"), V.indic(F.col("text")).alias("question")
    )


def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing and price answers as a stateless stream."""
    answers = R.price_answers(
        _message_stream(spark, sf_dir), _records(spark, sf_dir), V.SAMPLE
    ).select("qid", "language", "routed_to", "badge", "answer_text")
    out = new_folder(spark, "stream-answers")
    writer = answers.writeStream.format("parquet").option("path", out)
    R.drain(writer, new_folder(spark, "stream-state"))
    return spark.read.schema(answers.schema).parquet(out)


def answer_stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole answer plan, retrieval included, on each micro-batch."""
    out = new_folder(spark, "batch-answers")
    answerer = R.batch_answerer(
        out, records=_records(spark, sf_dir), **_inputs(spark, sf_dir)
    )
    writer = _message_stream(spark, sf_dir).writeStream.foreachBatch(answerer)
    R.drain(writer, new_folder(spark, "batch-state"))
    return _flat(spark.read.parquet(out))


def answer_stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two micro-batches around a load: each answers from the price table as it was when it began."""
    # Joined once for both loads.
    prices = stage(V.prices_star(spark, sf_dir), "star")
    out, table = new_folder(spark, "batch-answers"), new_folder(spark, "prices")
    batches = V.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    asked = batches.select("conv_id", V.qid().alias("qid"), V.indic(F.col("text")).alias("question"))
    answerer = R.batch_answerer(out, prices=table, vocabulary=V.SAMPLE)
    for batch_id, load in enumerate((prices.where(~F.col("market").endswith("7")), prices)):
        L.write_prices(load, table)
        answerer(asked.where(F.col("conv_id") % 2 == batch_id).drop("conv_id"), batch_id)
    stored = spark.read.parquet(out)
    return stored.select("qid", F.col("batch_id").cast("bigint").alias("batch_id"), "routed_to", "answer_text")


def answer_missing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price questions get an error text where no price table is, and others their answer."""
    answers = A.answer_questions(V.questions(spark, sf_dir), new_folder(spark, "never-written"), vocabulary=V.SAMPLE)
    return answers.select("qid", "routed_to", F.split("answer_text", " at /")[0].alias("answer_text"))


def answer_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = V.questions(spark, sf_dir).join(V.model_labels(spark, sf_dir), "qid", "left")
    routed = A.understand(labelled, V.SAMPLE)
    return routed.select(
        "qid",
        "routed_to",
        render.route_badge(F.col("routed_to")).alias("badge"),
        render.chat_badge(F.col("routed_to")).alias("chat_badge"),
    )


def question_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages written as JSON requests, read back and understood."""
    requests = new_folder(spark, "requests")
    messages = V.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    messages.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("qid"),
        F.col("text").alias("question"),
        F.when(F.col("turn") == 2, F.lit("de")).alias("language"),
    ).write.json(requests)
    return A.understand(I.read_questions(spark, requests), V.SAMPLE).select(
        "qid", "question", "language", "routed_to", "term", "loc"
    )


def conversation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.replay(V.table(spark, sf_dir, "conversations"))


def conversation_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log without conversations that hold a system message."""
    messages = V.table(spark, sf_dir, "conversations")
    cleared = messages.where(F.col("role") == "system").select("conv_id").distinct()
    return G.clear_conversations(messages, cleared)


def conversation_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages, with what is known of them, appended after the others; the log replayed."""
    messages = V.table(spark, sf_dir, "conversations")
    path = G.rewrite_log(messages.where(F.col("role") != "user"))
    meta = F.struct(F.lit("scheme_rag").alias("routed_to"), F.when(F.col("turn") > 0, "en").alias("language"))
    G.append_messages(messages.where(F.col("role") == "user").withColumn("meta", meta), path)
    replayed = G.replay(G.open_log(spark, path))
    return replayed.select(
        "conv_id", "turn", "role", "text", "position", "meta.routed_to", "meta.language"
    )


_REPLAY = (
    "SELECT conv_id, turn, role, text,"
    " row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations"
)

# Records for every pair of the sample vocabulary, as the plan prepares them.
_terms = "', '".join(V.SAMPLE.terms())
_places = "', '".join(V.SAMPLE.places())
_PAIRS = f"""
asked AS (
  SELECT term, loc FROM (SELECT unnest(['{_terms}']) AS term),
    (SELECT unnest([NULL, '{_places}']) AS loc)
)"""
_RECORDS = (
    V.ASKED[V.ASKED.index("dims AS"):]
    + f", {V.fit_sql('term, loc, stats_scope')}, {PQ.SUMMARY}"
)
_ROUTED = f"""
routed AS (
  SELECT *, coalesce({V.LABEL}, {V.keyword_case('question', V.SAMPLE_RULES)}) AS routed_to
  FROM messages
)"""
_PLAIN = f"""
messages AS (
  SELECT conv_id, turn, {V.QID} AS qid, trim({V.indic_sql('text')}, {V.sql_string(Q.X.WHITESPACE)})
    AS question
  FROM conversations WHERE role = 'user'
)"""
_TEXTS = f"""
routed_language AS (
  SELECT *, {V.letter_language_sql('question')} AS language,
         CASE WHEN routed_to = 'price_agent' THEN
           {V.alias_case('question', V.SAMPLE_COMMODITIES, "'ECONOMY'")} END AS asked_commodity,
         CASE WHEN routed_to = 'price_agent' THEN
           {V.alias_case('question', V.SAMPLE_LOCATIONS, 'NULL')} END AS asked_location
  FROM routed
)"""
_PRICE_TEXT = """CASE WHEN n_rows = 1 THEN 'Average modal price: **₹'
  || format('{:,.2f}', modal_price) || '** per quintal.' || CASE WHEN
  coalesce(forecast_14d, 0) <> 0 THEN E'\\n\\n🔮 **14-Day Trend Forecast:** ₹'
  || regexp_replace(printf('%.2f', forecast_14d), '0$', '') || '/quintal ('
  || trend_direction || ' trajectory).' ELSE '' END
  ELSE 'No data found for this query.' END"""
_BADGE = (
    "CASE WHEN routed_to = 'price_agent' THEN 'Mandi Prices & Analytics'"
    " ELSE 'Scheme Intelligence' END"
)
_ANSWERED = f"""
WITH {V.RETRIEVED.replace("asked AS (", "context_of AS (")}, {V.STAR}, {_PAIRS}, {_RECORDS},
{_PLAIN}, {_ROUTED}, {_TEXTS}, {Q.MODEL},
joined AS (
  SELECT r.*, c.context, c.n_chunks AS found_chunks, m.raw_answer, p.stats_scope,
         p.n_rows, p.modal_price, p.percent_change, p.forecast_14d, p.trend_direction
  FROM routed_language r JOIN context_of c ON r.qid = c.qid
  LEFT JOIN model m ON r.qid = m.qid
  LEFT JOIN records p ON r.asked_commodity = p.term
    AND r.asked_location IS NOT DISTINCT FROM p.loc
),
answered AS (
  SELECT *, CASE WHEN routed_to = 'rag_agent' THEN coalesce(nullif(raw_answer, ''), {Q.BUSY}) END
    AS scheme_answer
  FROM joined
)
SELECT qid, question, language, routed_to, {_BADGE} AS badge,
       CASE WHEN routed_to = 'price_agent' THEN {_PRICE_TEXT} ELSE scheme_answer END AS answer_text,
       CASE WHEN routed_to = 'rag_agent' THEN {Q.PROMPT} END AS prompt,
       CAST(NULL AS varchar) AS error, asked_commodity, asked_location, stats_scope,
       CASE WHEN routed_to = 'price_agent' THEN coalesce(n_rows, 0) END AS n_rows,
       round(modal_price + 3.183e-8, 4) AS modal_price, percent_change, forecast_14d, scheme_answer,
       CASE WHEN routed_to = 'rag_agent' THEN found_chunks END AS n_chunks
FROM answered"""
_STREAMED = f"""
WITH {V.STAR}, {_PAIRS}, {_RECORDS},
{_PLAIN}, {_ROUTED.replace(f"coalesce({V.LABEL}, ", "(")}, {_TEXTS}
SELECT r.qid, language, routed_to, {_BADGE} AS badge,
       CASE WHEN routed_to = 'price_agent' THEN {_PRICE_TEXT} ELSE {Q.BUSY} END AS answer_text
FROM routed_language r LEFT JOIN records p ON r.asked_commodity = p.term
  AND r.asked_location IS NOT DISTINCT FROM p.loc"""


def _one_batch(batch_id: int, star: str) -> str:
    """Answers without labels, models or documents, of every other conversation."""
    return f"""(WITH {star}, {_PAIRS}, {_RECORDS},
{_PLAIN}, {_ROUTED.replace(f"coalesce({V.LABEL}, ", "(")}, {_TEXTS}
SELECT r.qid, CAST({batch_id} AS bigint) AS batch_id, routed_to,
       CASE WHEN routed_to = 'price_agent' THEN {_PRICE_TEXT} ELSE {Q.BUSY} END AS answer_text
FROM routed_language r LEFT JOIN records p ON r.asked_commodity = p.term
  AND r.asked_location IS NOT DISTINCT FROM p.loc WHERE conv_id % 2 = {batch_id})"""


_NOT_YET = V.STAR.replace("JOIN nation ON s_nationkey = n_nationkey", "JOIN nation ON s_nationkey = n_nationkey WHERE s_name NOT LIKE '%7'")
_UNPRICED = f"""
WITH {_PLAIN}, {_ROUTED.replace(f"coalesce({V.LABEL}, ", "(")}, {_TEXTS}
SELECT qid, routed_to, CASE WHEN routed_to = 'price_agent' THEN '⚠️ Query error: no table' ELSE {Q.BUSY} END AS answer_text
FROM routed_language"""

QUERIES = {
    "answer_stream_refresh": Query(answer_stream_refresh, f"{_one_batch(0, _NOT_YET)} UNION ALL {_one_batch(1, V.STAR)}"),
    "answer_missing_prices": Query(answer_missing_prices, _UNPRICED),
    "answer_batch": Query(answer_batch, _ANSWERED),
    "answer_stream": Query(answer_stream, _STREAMED),
    "answer_stream_batches": Query(answer_stream_batches, _ANSWERED),
    "question_intake": Query(
        question_intake,
        f"WITH messages AS (SELECT conv_id * 1000000 + turn AS qid, turn, trim(text,"
        f" {V.sql_string(Q.X.WHITESPACE)}) AS question FROM conversations WHERE role = 'user'),"
        " routed AS (SELECT *, CASE WHEN turn = 2 THEN 'de' ELSE"
        f" {V.letter_language_sql('question')} END AS language,"
        f" {V.keyword_case('question', V.SAMPLE_RULES)} AS routed_to FROM messages)"
        " SELECT qid, question, language, routed_to, CASE WHEN routed_to = 'price_agent' THEN"
        f" {V.alias_case('question', V.SAMPLE_COMMODITIES, chr(39) + 'ECONOMY' + chr(39))} END"
        " AS term, CASE WHEN routed_to = 'price_agent' THEN"
        f" {V.alias_case('question', V.SAMPLE_LOCATIONS, 'NULL')} END AS loc FROM routed",
    ),
    "answer_badge": Query(
        answer_badge,
        f"WITH {_PLAIN}, {_ROUTED} SELECT qid, routed_to, {_BADGE} AS badge,"
        " CASE WHEN routed_to = 'price_agent' THEN '📈 Mandi Prices' ELSE '📋 Scheme Info' END"
        " AS chat_badge FROM routed",
    ),
    "conversation_replay": Query(conversation_replay, _REPLAY),
    "conversation_append": Query(
        conversation_append,
        "SELECT conv_id, turn, role, text,"
        " row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,"
        " CASE WHEN role = 'user' THEN 'scheme_rag' END AS routed_to,"
        " CASE WHEN role = 'user' AND turn > 0 THEN 'en' END AS language FROM conversations",
    ),
    "conversation_clear": Query(
        conversation_clear,
        "SELECT * FROM conversations WHERE conv_id NOT IN"
        " (SELECT conv_id FROM conversations WHERE role = 'system')",
    ),
}
