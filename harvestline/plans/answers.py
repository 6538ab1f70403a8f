"""A table of questions to a table of answers.

Language, route and entities are projections. The price branch is a broadcast
join with one record per (commodity, location) pair the gazetteer can produce,
so it is computed before and independently of the questions. The document
branch searches the index only for rows routed to it. The only joins that
shuffle questions are those with per-question tables from outside models, all
on ``qid``, so they share one partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import render, text
from ..operators import context as C
from ..operators import nearest as N
from ..operators.matching import join_same
from ..session import is_small
from ..sources import prices as L
from ..sources import versions
from . import prices as P


@dataclass(frozen=True)
class Vocabulary:
    """The word lists a deployment answers with."""

    commodities: list = field(default_factory=lambda: list(lexicon.COMMODITY_ALIASES))
    locations: list = field(default_factory=lambda: list(lexicon.LOCATION_ALIASES))
    default_commodity: str | None = lexicon.DEFAULT_COMMODITY
    rules: list = field(default_factory=lambda: list(lexicon.INTENT_RULES))

    def terms(self) -> list[str]:
        names = [canonical for _, canonical in self.commodities]
        if self.default_commodity:
            names.append(self.default_commodity)
        return list(dict.fromkeys(names))

    def places(self) -> list[str]:
        return list(dict.fromkeys(canonical for _, canonical in self.locations))


DEFAULT = Vocabulary()
MAX_LISTED_PAIRS = 20_000

# Price records of no pair, for prices that can't be read.
NO_RECORDS = (
    "term string, loc string, stats_scope string, query string, explanation string, n_rows long, commodity string,"
    " market string, state string, modal_price double, result string, columns array<string>, latest_price double,"
    " percent_change double, trend_direction string, forecast_14d double"
)


# Conditions of missing tables, of files and cells that can't be read, and of sources that say so.
UNREADABLE = (
    "PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE",
    "MALFORMED_RECORD_IN_PARSING", "CAST_INVALID_INPUT", "CANNOT_PARSE_TIMESTAMP", "USER_RAISED_EXCEPTION",
)


def unreadable(error: Exception) -> bool:
    """Whether prices failed to be read, and not the plan over them."""
    if isinstance(error, FileNotFoundError):
        return True
    condition = error.getCondition() or ""
    return condition.startswith(UNREADABLE) or any(f"[{c}" in str(error) for c in UNREADABLE)


def understand(questions: DataFrame, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Add language, route and entities; narrow, for batches and streams alike.

    ``questions``: qid, question, and optionally language, raw_label, error.
    """
    for name in ("language", "raw_label", "error"):
        if name not in questions.columns:
            questions = questions.withColumn(name, F.lit(None).cast("string"))
    asked = questions.withColumn("question", text.strip(F.col("question"))).withColumn(
        "rejected", F.when(F.col("error").isNull(), text.question_error(F.col("question")))
    )
    question = F.col("question")
    usable = F.col("error").isNull() & F.col("rejected").isNull()
    route = text.resolve_intent(F.col("raw_label"), question, vocabulary.rules)
    priced = F.col("routed_to") == lexicon.PRICE_ROUTE
    return (
        asked.withColumn("language", text.resolve_language(F.col("language"), question))
        .withColumn(
            "routed_to",
            F.when(F.col("error").isNotNull(), F.lit(lexicon.ERROR_ROUTE)).when(usable, route),
        )
        .withColumn(
            "term",
            F.when(priced, text.commodity(question, vocabulary.commodities, vocabulary.default_commodity)),
        )
        .withColumn("loc", F.when(priced, text.location(question, vocabulary.locations)))
    )


def crossable(vocabulary: Vocabulary) -> bool:
    """Whether all pairs of the gazetteer are few enough to list."""
    return len(vocabulary.terms()) * (len(vocabulary.places()) + 1) <= MAX_LISTED_PAIRS


def vocabulary_records(
    prices: DataFrame | None,
    questions: DataFrame | None,
    vocabulary: Vocabulary = DEFAULT,
    cube: DataFrame | None = None,
    dims: DataFrame | None = None,
) -> DataFrame:
    """Price records for every pair the questions can ask.

    A gazetteer small enough is crossed as plain lists, which spares a pass over
    the questions; otherwise the pairs are read off the questions.
    """
    if crossable(vocabulary):
        spark = (prices if cube is None else cube).sparkSession
        asked = P.asked_pairs(spark, vocabulary.terms(), vocabulary.places())
    elif questions is None:
        raise ValueError("this vocabulary has too many pairs; pass the questions")
    else:
        asked = understand(questions, vocabulary).select("term", "loc")
    return P.price_records(prices, asked, cube, dims)


def join_records(understood: DataFrame, records: DataFrame) -> DataFrame:
    """Attach the price record of each priced question (questions are kept)."""
    return join_same(understood, records, P.PAIR, "left", is_small(records))


def finish(answered: DataFrame) -> DataFrame:
    """Texts, badge and nested records of questions with both branches joined."""
    route = F.col("routed_to")
    priced = route == lexicon.PRICE_ROUTE
    schemed = route == lexicon.SCHEME_ROUTE
    price_text = render.price_answer_text(
        F.coalesce("n_rows", F.lit(0)), F.col("modal_price"), F.col("forecast_14d"),
        F.col("trend_direction"),
        F.col("price_error"),
    )
    scheme_text = render.scheme_answer(F.col("raw_answer"), F.col("language"))
    found = F.col("stats_scope").isNotNull()
    if "price_error" not in answered.columns:
        answered = answered.withColumn("price_error", F.lit(None).cast("string"))
    price = F.struct(
        "query",
        "explanation",
        F.col("term").alias("asked_commodity"),
        F.col("loc").alias("asked_location"),
        "stats_scope",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "commodity",
        "market",
        "state",
        "modal_price",
        "result",
        "columns",
        "percent_change",
        F.when(
            found,
            F.struct(
                "latest_price", "percent_change", "trend_direction", "forecast_14d"
            ),
        ).alias("forecast_stats"),
        F.col("price_error").alias("error"),
    )
    scheme = F.struct("question", "retrieved_chunks", F.col("_scheme_text").alias("answer"))
    return answered.withColumn("_scheme_text", F.when(schemed, scheme_text)).select(
        "qid",
        "question",
        "language",
        "routed_to",
        F.when(route.isNotNull(), render.route_badge(route)).alias("badge"),
        F.when(priced, price_text)
        .when(schemed, F.col("_scheme_text"))
        .when(route == lexicon.ERROR_ROUTE, F.lit(lexicon.SYSTEM_ERROR_TEXT))
        .alias("answer_text"),
        F.when(schemed, F.col("prompt")).alias("prompt"),
        F.when(priced, price).alias("price"),
        F.when(schemed, scheme).alias("scheme"),
        F.coalesce("error", "rejected").alias("error"),
    )


def _joined(questions: DataFrame, table: DataFrame | None, column: str, type_: str) -> DataFrame:
    """Left-join one column of a per-question table, or add it as NULL."""
    if column in questions.columns:
        return questions
    if table is None:
        return questions.withColumn(column, F.lit(None).cast(type_))
    # One row a question: of several, the smallest value.
    single = table.where(F.col("qid").isNotNull()).groupBy("qid").agg(F.min(column).alias(column))
    return questions.join(single, "qid", "left")


def answer_questions(
    questions: DataFrame,
    prices: DataFrame | str | None = None,
    index: DataFrame | N.OpenIndex | None = None,
    vectors: DataFrame | None = None,
    labels: DataFrame | None = None,
    model_answers: DataFrame | None = None,
    vocabulary: Vocabulary = DEFAULT,
    k: int = lexicon.TOP_K,
    records: DataFrame | None = None,
    cube: DataFrame | None = None,
    dims: DataFrame | None = None,
) -> DataFrame:
    """Route every question and answer it from prices or documents.

    ``vectors`` (qid, embedding), ``labels`` (qid, raw_label) and
    ``model_answers`` (qid, raw_answer) come from outside models; each may be
    missing as a whole or for single questions; of several rows for a question
    the smallest value counts. ``prices`` is a table or the path of a stored one.
    Prices that can't be read give every price question an error text; any other
    failure is raised. ``records`` are the staged
    output of an earlier :func:`vocabulary_records`, and ``cube`` a stored daily
    cube, instead of ``prices``; ``dims`` is the stored catalogue of the prices.
    """
    questions = _joined(questions, labels, "raw_label", "string")
    questions = _joined(questions, model_answers, "raw_answer", "string")
    questions = _joined(questions, vectors, N.VECTOR, "array<float>")
    price_error = None
    if records is None:
        if prices is None and cube is None:
            raise ValueError("prices, their cube, or records are needed")
        try:
            if isinstance(prices, str):
                version = versions.pinned(questions.sparkSession, prices)
                dims = L.open_catalogue(questions.sparkSession, prices, version)
                prices = L.open_prices(questions.sparkSession, prices, version=version)
            records = vocabulary_records(prices, questions, vocabulary, cube, dims)
        except (PySparkException, FileNotFoundError) as error:
            if not unreadable(error):
                raise
            # Unreadable prices fail the price answers, each with its error, and no others.
            price_error = str(error).strip().split("\n")[0] or type(error).__name__
            records = questions.sparkSession.createDataFrame([], NO_RECORDS)

    asked = understand(questions, vocabulary)
    # Priced rows carry no vector from here on, so the search passes them by.
    asked = asked.withColumn(
        N.VECTOR, F.when(F.col("routed_to") == lexicon.SCHEME_ROUTE, F.col(N.VECTOR))
    )
    if index is None:
        none = F.array().cast("array<struct<text:string>>")
        retrieved = asked.withColumn("hits", none)
    else:
        retrieved = N.retrieve(asked, index, k)
    with_prompts = C.with_prompt(C.with_context(retrieved)).drop("hits", N.VECTOR)
    joined = join_records(with_prompts, records)
    return finish(joined.withColumn("price_error", F.lit(price_error).cast("string")))
