"""Daily sums and series moments that grow by addition.

The state of a price table for one choice of series keys. It is cut into months, and
each month holds its daily sums per key and, per key, the moments of its daily averages:
counts, sums about the month's first day, and the first and last price. Both merge by
addition, so new facts rewrite the months they fall into and read nothing else, and the
statistics of a whole series are those of its months added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as S
from ..session import stage
from . import versions
from .versions import Version

DAILY, MOMENTS = "daily", "moments"
NO_DATE = "none"
_PART = "_part"


def _month(date: str) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(NO_DATE))


def daily_sums(prices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, date, price_sum, price_n); combined before the shuffle, so a hot key costs its dates."""
    S.require_columns(prices, *keys, "date", "modal_price")
    return prices.groupBy(*keys, "date").agg(
        F.sum("modal_price").alias("price_sum"), F.count("modal_price").alias("price_n")
    )


def month_moments(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the daily averages per key and month, about the month's first day."""
    price = F.col("price_sum") / F.nullif("price_n", F.lit(0))
    base = F.unix_date(F.trunc("date", "MM"))
    dated = daily.select(
        *keys, "date", _month("date").alias("month"), base.alias("base"), price.alias("price"),
        F.when(price.isNotNull(), F.unix_date("date") - base).cast("double").alias("x"),
    )
    fits = F.when(F.col("x").isNotNull(), F.col("price"))
    return dated.groupBy(*keys, "month").agg(
        F.count("*").alias("n"),
        F.min("base").alias("base"),
        F.count("x").alias("n_fit"),
        F.sum("x").alias("x"),
        F.sum(fits).alias("y"),
        F.sum(F.col("x") * F.col("x")).alias("xx"),
        F.sum(F.col("x") * F.col("price")).alias("xy"),
        F.min("date").alias("first_date"),
        F.min_by("price", "date").alias("first_price"),
        F.max("date").alias("last_date"),
        F.max_by("price", "date").alias("last_price"),
    )


def series_stats(moments: DataFrame, keys: list[str], **options) -> DataFrame:
    """Statistics of each series, equal to those over its daily averages.

    Months are first moved to the middle of the series, so no difference of
    large sums is taken.
    """
    total = F.sum("n_fit")
    spans = moments.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min_by("first_price", "first_date").alias("earliest_price"),
        F.max_by("last_price", "last_date").alias("latest_price"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        (F.sum(F.col("x") + F.col("n_fit") * F.col("base")) / F.nullif(total, F.lit(0))).alias("_mid_day"),
        (F.sum("y") / F.nullif(total, F.lit(0))).alias("_mid_price"),
        # One entry a month.
        F.collect_list(F.struct("n_fit", "base", "x", "y", "xx", "xy")).alias("_months"),
    )
    used = F.filter("_months", lambda m: m["n_fit"] > 0)

    def added(of) -> Column:
        return F.aggregate(F.transform(used, of), F.lit(0.0), lambda a, b: a + b)

    def shift(m: Column) -> Column:
        return m["base"] - F.col("_mid_day")

    spread = added(lambda m: m["xx"] + 2 * shift(m) * m["x"] + m["n_fit"] * shift(m) * shift(m))
    joint = added(
        lambda m: m["xy"] + shift(m) * m["y"] - F.col("_mid_price") * (m["x"] + m["n_fit"] * shift(m))
    )
    fitted = spans.withColumn("_slope", joint / F.nullif(spread, F.lit(0.0))).drop("_months")
    return S.described(fitted, **options)


def add_prices(prices: DataFrame, path: str, keys: list[str]) -> Version:
    """Add facts to the state at ``path``, which the first load makes.

    Only months that the new facts fall into are read and rewritten. Every load is
    added, so a load that is repeated counts twice; one without rows changes nothing.
    """
    spark = prices.sparkSession
    fresh = stage(daily_sums(prices, keys).withColumn(_PART, _month("date")), "daily")
    touched = [row[_PART] for row in fresh.select(_PART).distinct().collect()]  # months
    last = versions.newest(spark, path)
    if not touched:
        return last or Version(path, -1, {})
    known = [part for part in touched if last and part in last.parts]
    if known:
        fresh = fresh.unionByName(_read(spark, last, DAILY, known).withColumn(_PART, _month("date")))
    merged = fresh.groupBy(_PART, *keys, "date").agg(
        F.sum("price_sum").alias("price_sum"), F.sum("price_n").alias("price_n")
    )
    name, folder = versions.new_data(path)
    merged.hint("rebalance", F.col(_PART)).write.partitionBy(_PART).parquet(f"{folder}/{DAILY}")
    written = spark.read.schema(merged.schema).parquet(f"{folder}/{DAILY}")
    moments = month_moments(written, keys).withColumn(_PART, F.col("month"))
    moments.hint("rebalance", F.col(_PART)).write.partitionBy(_PART).parquet(f"{folder}/{MOMENTS}")
    return versions.publish(spark, path, {part: name for part in touched}, keep=last)


def _read(spark: SparkSession, version: Version, data: str, parts: list[str] | None = None) -> DataFrame:
    """Rows of the named months, each from the folder its version names."""
    named = version.parts if parts is None else {part: version.parts[part] for part in parts}
    paths = [f"{version.path}/{folder}/{data}/{_PART}={part}" for part, folder in named.items()]
    return spark.read.parquet(*paths)


def open_daily(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """(keys, date, price_sum, price_n) of all months."""
    return _read(spark, version or versions.pinned(spark, path), DAILY)


def open_moments(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """(keys, month, moments) of all months."""
    return _read(spark, version or versions.pinned(spark, path), MOMENTS)
