"""Daily price series, moving averages and per-series statistics.

Facts are reduced to one row per key and date by a partial aggregate before
anything is shuffled, so a hot key costs no more than its dates. After that a
series has at most one row per calendar day, which bounds every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import lexicon
from ..functions.render import exact_round
from ..session import small_rows

# Dimension values up to which a term becomes a list of them.
MAX_LISTED_VALUES = 1_000


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")


def matches(column: str, term: str) -> Column:
    """``LIKE '%term%'`` without case; ``%`` and ``_`` stay wildcards."""
    escaped = term.replace("\\", "\\\\")
    return F.col(column).ilike(f"%{escaped}%")


def _listed(values: DataFrame, column: str, hit: Column) -> Column | None:
    """The stored values of ``column`` that hit, as an ``IN`` list; None if they are many."""
    rows = small_rows(values.where(hit).select(column).distinct(), MAX_LISTED_VALUES)
    if rows is None:
        return None
    named = sorted(row[0] for row in rows if row[0] is not None)
    listed = F.col(column).isin(named)
    return listed | F.col(column).isNull() if len(named) < len(rows) else listed


def filter_prices(
    prices: DataFrame,
    commodity: str | None = None,
    location: str | None = None,
    goods: DataFrame | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """Rows of a commodity term, at a location (market or state) if one is given.

    ``goods`` (commodity) and ``places`` (market, state) hold at least the values
    that occur, as a table's catalogue does. With them a term is matched to these
    few values first, and the facts are read by lists of values, which partitions
    and row groups can be pruned by.
    """
    if commodity:
        hit = matches("commodity", commodity)
        listed = None if goods is None else _listed(goods, "commodity", hit)
        prices = prices.where(hit if listed is None else listed)
    if location:
        hit = matches("market", location) | matches("state", location)
        for column in ("market", "state") if places is not None else ():
            listed = _listed(places, column, hit)
            prices = prices if listed is None else prices.where(listed)
        prices = prices.where(hit)
    return prices


def daily_average(
    prices: DataFrame,
    keys: list[str],
    price_col: str = "modal_price",
    date_col: str = "date",
) -> DataFrame:
    """Mean price per key and date."""
    require_columns(prices, *keys, price_col, date_col)
    return prices.groupBy(*keys, date_col).agg(F.avg(price_col).alias(price_col))


def in_date_order(series: DataFrame, keys: list[str], date_col: str = "date") -> DataFrame:
    """Series sorted for output; windows and statistics do not need it."""
    return series.orderBy(*keys, date_col)


def moving_average(
    series: DataFrame,
    keys: list[str],
    price_col: str = "modal_price",
    date_col: str = "date",
    rows: int = lexicon.MOVING_AVERAGE_ROWS,
    name: str = "ma_7",
) -> DataFrame:
    """Mean of the last ``rows`` rows (not days), from the first row on."""
    require_columns(series, *keys, price_col, date_col)
    trailing = W.partitionBy(*keys).orderBy(date_col).rowsBetween(1 - rows, 0)
    return series.withColumn(name, F.avg(price_col).over(trailing))


def day_index(
    series: DataFrame, keys: list[str], date_col: str = "date", name: str = "day_index"
) -> DataFrame:
    """Days since the first date of the series."""
    first = F.min(date_col).over(W.partitionBy(*keys))
    return series.withColumn(name, F.datediff(date_col, first))


def price_stats(
    series: DataFrame,
    keys: list[str],
    price_col: str = "modal_price",
    date_col: str = "date",
    horizon: int = lexicon.FORECAST_DAYS,
    trend_slope: float = lexicon.TREND_SLOPE,
    min_rows: int = lexicon.MIN_FIT_ROWS,
) -> DataFrame:
    """Latest price, change, line fit, projection and trend of each series.

    One aggregate: the line is fitted over absolute day numbers, whose slope is
    that of days since the series start, so no window has to find that start.
    NULL prices take no part in the fit, but count as rows.
    """
    require_columns(series, *keys, price_col, date_col)
    price = F.col(price_col)
    day = F.unix_date(F.col(date_col)).cast("double")
    fitted = series.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by(price_col, date_col).alias("earliest_price"),
        F.max_by(price_col, date_col).alias("latest_price"),
        F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
        F.regr_slope(price, day).alias("_slope"),
        F.regr_avgx(price, day).alias("_mid_day"),
        F.regr_avgy(price, day).alias("_mid_price"),
    )
    return described(fitted, horizon, trend_slope, min_rows)


def described(
    fitted: DataFrame,
    horizon: int = lexicon.FORECAST_DAYS,
    trend_slope: float = lexicon.TREND_SLOPE,
    min_rows: int = lexicon.MIN_FIT_ROWS,
) -> DataFrame:
    """Statistics of series whose ends, row counts and lines are known.

    ``fitted`` has n, earliest_price, latest_price, first_date, last_date, and of
    the line _slope, _mid_day and _mid_price. The projection goes through that
    mean point, which keeps it exact far from day zero.
    """

    def at(day_number: Column) -> Column:
        return F.col("_mid_price") + F.col("slope") * (day_number - F.col("_mid_day"))

    earliest, latest = F.col("earliest_price"), F.col("latest_price")
    return (
        fitted.withColumn("slope", F.when(F.col("n") >= min_rows, F.col("_slope")))
        .withColumn("intercept", at(F.unix_date("first_date").cast("double")))
        .withColumn("forecast_14d", at((F.unix_date("last_date") + F.lit(horizon)).cast("double")))
        .withColumn(
            "percent_change",
            F.when(earliest == 0, F.lit(0.0)).otherwise((latest - earliest) / earliest * 100),
        )
        .withColumn(
            "trend_direction",
            F.when(F.col("slope") > trend_slope, F.lit("upward"))
            .when(F.col("slope") < -trend_slope, F.lit("downward"))
            .otherwise(F.lit("stable")),
        )
        .drop("_slope", "_mid_day", "_mid_price")
    )


def stats_record(stats: DataFrame, keys: list[str], *kept: str) -> DataFrame:
    """The shown statistics, rounded to two places."""
    return stats.select(
        *keys,
        *kept,
        exact_round(F.col("latest_price")).alias("latest_price"),
        exact_round(F.col("percent_change")).alias("percent_change"),
        "trend_direction",
        exact_round(F.col("forecast_14d")).alias("forecast_14d"),
    )


def chart_points(
    series: DataFrame, keys: list[str], price_col: str = "modal_price", date_col: str = "date",
    average_col: str = "ma_7",
) -> DataFrame:
    """Price and moving average as (variable, value) rows."""
    return series.unpivot([*keys, date_col], [price_col, average_col], "variable", "value")


def average_by_commodity(
    prices: DataFrame,
    location: str | None = None,
    commodity: str | None = None,
    goods: DataFrame | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """Mean price per commodity, with one (market, state) pair it occurs at.

    Sums are taken per (commodity, market, state) first: that aggregate hashes
    fixed-width values, while picking the smallest text pair would sort every
    fact row. Without a location there is no market column.
    """
    places = (
        filter_prices(prices, commodity, location, goods, places)
        .groupBy("commodity", "market", "state")
        .agg(F.sum("modal_price").alias("_sum"), F.count("modal_price").alias("_n"))
    )
    averaged = places.groupBy("commodity").agg(
        F.min(F.struct("market", "state")).alias("_place"),
        F.min("state").alias("_state"),
        (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("modal_price"),
    )
    if location:
        return averaged.select(
            "commodity",
            F.col("_place.market").alias("market"),
            F.col("_place.state").alias("state"),
            "modal_price",
        )
    return averaged.select("commodity", F.col("_state").alias("state"), "modal_price")
