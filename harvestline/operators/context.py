"""Retrieved chunks to context, sources, prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import render
from ..functions.text import strip


def with_context(retrieved: DataFrame) -> DataFrame:
    """Add the chunk texts in rank order, and their joined form ("" if none)."""
    texts = F.transform("hits", lambda hit: hit["text"])
    return retrieved.withColumn("retrieved_chunks", texts).withColumn(
        "context", F.array_join("retrieved_chunks", lexicon.CONTEXT_SEPARATOR)
    )


def with_prompt(
    questions: DataFrame, question: str = "question", language: str = "language"
) -> DataFrame:
    """Add the prompt an outside model would be given."""
    return questions.withColumn(
        "prompt", render.prompt(F.col(question), F.col("context"), F.col(language))
    )


def sources(retrieved: DataFrame, key: str = "qid") -> DataFrame:
    """(key, source_no, label, text): retrieved chunks numbered from 1."""
    listed = retrieved.select(key, F.posexplode("hits").alias("_i", "_hit"))
    number = (F.col("_i") + 1).cast("bigint")
    return listed.select(
        key,
        number.alias("source_no"),
        F.concat(F.lit("Source "), number.cast("string")).alias("label"),
        strip(F.col("_hit.text")).alias("text"),
    )
