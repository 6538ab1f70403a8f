"""Tables that are replaced while others read them.

A table is a folder of data folders and a list of versions. A version names the data
folders it is made of, one for each part of the table. New data is written to a folder of
its own first; the version is one row group in one new file, which appears as a whole or
not at all. So a job that dies half-way leaves the last version as it was, and a reader
that has pinned a version is not disturbed by the next.

Data folders of earlier versions stay until the owner of the table clears them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "version long, token string, part string, folder string"
WHOLE = "all"


@dataclass(frozen=True)
class Version:
    """What a table is made of: the data folder of each part."""

    path: str
    number: int
    parts: dict[str, str]

    def folders(self, data: str, parts: list[str] | None = None) -> list[str]:
        """The paths of one kind of data, of all parts or of those named."""
        named = self.parts if parts is None else {p: self.parts[p] for p in parts if p in self.parts}
        return [f"{self.path}/{folder}/{data}" for folder in dict.fromkeys(named.values())]


def new_data(path: str) -> tuple[str, str]:
    """(name, whole path) of a data folder that nobody has written to."""
    name = f"data/{uuid.uuid4().hex}"
    return name, f"{path}/{name}"


def newest(spark: SparkSession, path: str) -> Version | None:
    """The last version, or None if the table was never written."""
    try:
        listed = spark.read.schema(_LIST).parquet(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # Two writers may take one number; the larger token wins, and no version is mixed.
    last = listed.agg(F.max(F.struct("version", "token")).alias("last"))
    rows = listed.join(F.broadcast(last), F.struct("version", "token") == F.col("last")).collect()
    if not rows:
        return None
    return Version(path, rows[0]["version"], {row["part"]: row["folder"] for row in rows})


def pinned(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version of a table, the newest if none is named; raises if there is none."""
    if number is None:
        found = newest(spark, path)
    else:
        rows = spark.read.schema(_LIST).parquet(f"{path}/versions").where(F.col("version") == number).collect()
        token = max((row["token"] for row in rows), default=None)
        parts = {row["part"]: row["folder"] for row in rows if row["token"] == token}
        found = Version(path, number, parts) if parts else None
    if found is None:
        raise FileNotFoundError(f"no table at {path}" if number is None else f"no version {number} at {path}")
    return found


def publish(spark: SparkSession, path: str, parts: dict[str, str], keep: Version | None = None) -> Version:
    """Make ``parts`` (part to data folder), beside those of ``keep``, the newest version."""
    last = newest(spark, path)
    whole = {**(keep.parts if keep else {}), **parts}
    number = last.number + 1 if last else 0
    token = uuid.uuid4().hex
    rows = pa.table(
        {
            "version": pa.array([number] * len(whole), pa.int64()),
            "token": pa.array([token] * len(whole), pa.string()),
            "part": pa.array(list(whole), pa.string()),
            "folder": pa.array(list(whole.values()), pa.string()),
        }
    )
    # One row a part, and one task, so one file.
    spark.createDataFrame(rows).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return Version(path, number, whole)


def replace(df: DataFrame, path: str, data: str) -> Version:
    """Replace a table that has one kind of data and one part."""
    name, folder = new_data(path)
    df.write.parquet(f"{folder}/{data}")
    return publish(df.sparkSession, path, {WHOLE: name})
