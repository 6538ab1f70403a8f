"""Question intake and answer output, as batch tables or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema

CORRUPT = "_corrupt"
_INTAKE = T.StructType([*schema.QUESTIONS.fields, T.StructField(CORRUPT, T.StringType())])


def _with_error(df: DataFrame) -> DataFrame:
    """Unreadable records stay in the table, with the reason in ``error``."""
    broken = F.col(CORRUPT).isNotNull()
    return df.withColumn(
        "error", F.when(broken, F.concat(F.lit("Unreadable request: "), F.col(CORRUPT)))
    ).drop(CORRUPT)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of {qid, question, language?}."""
    reader = spark.read.schema(_INTAKE).option("columnNameOfCorruptRecord", CORRUPT)
    return _with_error(reader.json(path))


def stream_questions(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same, as files arrive in a folder."""
    reader = (
        spark.readStream.schema(_INTAKE)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", files_per_trigger)
    )
    return _with_error(reader.json(path))


def write_answers(answers: DataFrame, path: str, mode: str = "overwrite") -> None:
    answers.write.mode(mode).parquet(path)
