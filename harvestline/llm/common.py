"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder


def by_value(name: str) -> None:
    """Let tasks get the functions of a module by value; workers need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal ``df`` by key to all shuffle partitions, however few bytes it has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it, so that it clashes with no column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def column_of(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def keyed_runs(batches, key: str, order: list[str]):
    """Runs of equal ``key`` of a sorted partition, as (key, arrays by column).

    Runs of one row are left out. Only the current run is held across batches,
    so a caller must have a bound on the run length.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [column_of(batch, c).to_numpy(zero_copy_only=False) for c in [key, *order]]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        if not len(columns[0]):
            continue
        cuts = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        starts = np.concatenate(([0], cuts))
        ends = np.concatenate((cuts, [len(columns[0])]))
        whole = np.flatnonzero(ends[:-1] - starts[:-1] > 1)
        for i in whole:
            yield columns[0][starts[i]], [c[starts[i] : ends[i]] for c in columns[1:]]
        held = [c[starts[-1] :].copy() for c in columns]
    if held is not None and len(held[0]) > 1:
        yield held[0][0], held[1:]


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks.

    A worker serves one operator after the other, so it keeps what one of them needs:
    asking for a dict empties those of other names.
    """
    module = sys.modules.setdefault("_harvestline_worker_cache", types.ModuleType("_harvestline_worker_cache"))
    kept = module.__dict__.setdefault("kept", {})
    for other in kept.keys() - {name}:
        del kept[other]
    return kept.setdefault(name, {})
