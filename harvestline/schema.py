"""Table schemas, and the DataFrame form of the fixed word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import lexicon

PRICE_TEXT_COLUMNS = ["commodity", "market", "state"]
PRICE_NUMBER_COLUMNS = ["min_price", "max_price", "modal_price"]
PRICE_COLUMNS = ["date", *PRICE_TEXT_COLUMNS, *PRICE_NUMBER_COLUMNS]

PRICES = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in PRICE_TEXT_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_NUMBER_COLUMNS]
)

QUESTIONS = T.StructType(
    [
        T.StructField("qid", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField(
            "meta",
            T.StructType(
                [
                    T.StructField("routed_to", T.StringType()),
                    T.StructField("language", T.StringType()),
                ]
            ),
        ),
    ]
)

GAZETTEER = "kind string, ord int, alias string, canonical string"
RULES = "priority int, keyword string, label string"


def gazetteer(spark: SparkSession) -> DataFrame:
    """The default commodity and location aliases as a table."""
    rows = [
        (kind, ord_, alias, canonical)
        for kind, aliases in (
            ("commodity", lexicon.COMMODITY_ALIASES),
            ("location", lexicon.LOCATION_ALIASES),
        )
        for ord_, (alias, canonical) in enumerate(aliases)
    ]
    return spark.createDataFrame(rows, GAZETTEER)


def intent_rules(spark: SparkSession) -> DataFrame:
    """The default intent keywords as a table."""
    return spark.createDataFrame(lexicon.INTENT_RULES, RULES)
