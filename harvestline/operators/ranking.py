"""Positions within groups of any size, without a window task per group."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import stage
from .matching import join_same

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _counted(key: int):
    """Each row's place in its run of equal keys, over a sorted partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0  # key of the row before, and rows of its run so far
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1))
            places = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            first, end = batch.column(key)[0].as_py(), batch.column(key)[-1].as_py()
            if last is not None and last[0] == first:
                places[: starts[1] if len(starts) > 1 else batch.num_rows] += before
            last, before = (end,), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], [*batch.schema.names, "place"])

    return count


def positions(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the 0-based place of each row in its group, ordered by ``order``, NULL first.

    Rows are sorted by ranges of (group, order), so a group may span many tasks, which
    count their own part. A partition starts inside at most one group, and the rows
    of it that lie in earlier partitions are all that has to be added: one number
    a partition. Rows that are equal in all columns are dealt apart.
    """
    part, spread = _free(df, "_part"), _free(df, "_spread")
    keys = [group, *order, spread]
    dealt = df.withColumn(spread, F.xxhash64(F.monotonically_increasing_id()))
    lined = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(spread)
    lined = lined.withColumn(part, F.spark_partition_id())
    fields = [*lined.schema.fields, T.StructField(name, T.LongType())]
    counted = lined.mapInArrow(_counted(df.columns.index(group)), T.StructType(fields))
    placed = stage(counted, "positions")
    earlier = W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(part, group).agg((F.max(name) + 1).alias("_rows"))
    before = counts.select(part, group, F.sum("_rows").over(earlier).alias("_before")).where("_before > 0")
    # At most one row a partition.
    joined = join_same(placed, before, [part, group], "left", small=True)
    return joined.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop(part, "_before")
