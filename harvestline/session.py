"""Session defaults, durable intermediate tables and size checks."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bounds for anything that is broadcast or folded into an expression.
# Beyond them every operator has a shuffle-based way that gives the same rows.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
MAX_FOLDED_ROWS = 1_000

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("harvestline")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the session names it.

    Only a local-mode session, where driver and executors are one process, gets
    a temporary folder when none is configured.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return _local_folder(context.applicationId)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/harvestline/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor. The files also
    give Catalyst the true size, so its own broadcast threshold is exact.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Whether ``df`` is within both bounds; pass a staged table.

    Bytes are those of the rows as JSON, so every column of every row counts,
    nested and binary ones too.
    """
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))) if df.columns else F.lit(0)
    rows, octets = df.agg(F.count("*"), F.sum(size)).first()
    return rows <= max_rows and (octets or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after measuring ``df``; pass a staged table."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def small_rows(df: DataFrame, max_rows: int = MAX_FOLDED_ROWS) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows``, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
