"""The conversation log: append, replay in order, clear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.ranking import positions
from ..session import new_folder


def append_messages(messages: DataFrame, path: str) -> None:
    """Add messages to the log; a message without ``meta`` is stored without it."""
    _with_meta(messages).write.mode("append").parquet(path)


def open_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.MESSAGES).parquet(path)


def _with_meta(messages: DataFrame) -> DataFrame:
    kind = schema.MESSAGES["meta"].dataType
    if "meta" not in messages.columns:
        messages = messages.withColumn("meta", F.lit(None).cast(kind))
    return messages.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.MESSAGES.fields))


def replay(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages with their 0-based ``position`` in the conversation.

    Messages without a turn come first; messages of equal turn are ordered by
    their other columns, so the position is the same each time. Those without
    a conversation form one of their own. A conversation may hold a large share
    of all rows, with any turns: the log is sorted by ranges, which cut it into
    many tasks.
    """
    others = [c for c in messages.columns if c not in (conv, turn)]
    return positions(messages, conv, [turn, *others], "position")


def clear_conversations(messages: DataFrame, cleared: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The log without the conversations listed in ``cleared``."""
    return messages.join(cleared.select(conv), conv, "left_anti")


def rewrite_log(messages: DataFrame, name: str = "log") -> str:
    """Write a log version to a fresh folder, and return the folder.

    The old version stays readable until the caller switches over.
    """
    path = new_folder(messages.sparkSession, name)
    _with_meta(messages).write.parquet(path)
    return path
