"""Queries of the price operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.functions import render
from harvestline.operators import series as S
from harvestline.plans import prices as P
from harvestline.session import new_folder
from harvestline.sources import daily_state as M
from harvestline.sources import prices as L

from . import Query
from . import views as V

PLACE = ["commodity", "state"]
STATS_SELECT = """
  round(latest_price + 3.183e-8, 4) AS latest_price, round(percent_change + 3.183e-8, 4) AS percent_change,
  round(forecast_14d + 3.183e-8, 4) AS forecast_14d, trend_direction"""


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({name: V.settled(F.col(name), n) for name, n in places.items()})


def _stats(prices: DataFrame, keys: list[str]) -> DataFrame:
    return S.price_stats(S.daily_average(prices, keys), keys)


def _star_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per (commodity, state) of the star prices."""
    return _stats(V.prices_star(spark, sf_dir), PLACE)


def _shown(stats: DataFrame, keys: list[str]) -> DataFrame:
    picked = stats.select(
        *keys, "n", "latest_price", "percent_change", "forecast_14d", "trend_direction"
    )
    return _rounded(picked, latest_price=4, percent_change=4, forecast_14d=4)


def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_stats(V.prices_star(spark, sf_dir), ["commodity"]), ["commodity"])


def price_stats_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_stats(V.prices_events(spark, sf_dir), PLACE), PLACE)


def _series_cte(keys: str) -> str:
    return (
        f"series AS (SELECT {keys}, date, avg(modal_price) AS modal_price"
        f" FROM prices GROUP BY {keys}, date)"
    )


def _stats_sql(view: str, keys: str, select: str) -> str:
    return (
        f"WITH {view}, {_series_cte(keys)}, {V.fit_sql(keys)}\n"
        f"SELECT {keys}, {select} FROM stats"
    )


def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = S.daily_average(V.prices_star(spark, sf_dir), ["commodity"])
    return _rounded(S.in_date_order(series, ["commodity"]), modal_price=4)


def price_series_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, places = V.prices_star(spark, sf_dir), V.places_star(spark, sf_dir)
    located = S.filter_prices(prices, location="nation_1", places=places)
    return _rounded(S.daily_average(located, ["commodity"]), modal_price=4)


def price_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.average_by_commodity(V.prices_star(spark, sf_dir)), modal_price=4)


def price_avg_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = S.average_by_commodity(
        V.prices_star(spark, sf_dir), "nation_1", "s", V.goods_star(spark, sf_dir), V.places_star(spark, sf_dir)
    )
    return _rounded(averages, modal_price=4)


def price_ma7(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = S.daily_average(V.prices_star(spark, sf_dir), ["commodity"])
    averaged = S.moving_average(S.day_index(series, ["commodity"]), ["commodity"])
    return _rounded(averaged, modal_price=4, ma_7=4).withColumn(
        "day_index", F.col("day_index").cast("bigint")
    )


def price_pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = _star_stats(spark, sf_dir).select(
        *PLACE, "earliest_price", "latest_price", "percent_change"
    )
    return _rounded(picked, earliest_price=4, latest_price=4, percent_change=4)


def price_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = _star_stats(spark, sf_dir).select(*PLACE, "n", "slope", "intercept")
    return _rounded(picked, slope=6, intercept=4)


def price_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_star_stats(spark, sf_dir).select(*PLACE, "forecast_14d"), forecast_14d=4)


def price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(V.prices_events(spark, sf_dir), ["commodity", "market"]).select(
        "commodity", "market", "trend_direction"
    )


def price_chart_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = S.daily_average(V.prices_star(spark, sf_dir), ["commodity"])
    points = S.chart_points(S.moving_average(series, ["commodity"]), ["commodity"])
    return _rounded(points, value=4)


# --- asked pairs ----------------------------------------------------------


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prices = V.prices_star(spark, sf_dir)
    asked = V.asked_star(
        prices, V.table(spark, sf_dir, "region"), V.table(spark, sf_dir, "nation")
    )
    return prices, asked


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, P.PairMap]:
    prices, asked = _asked(spark, sf_dir)
    return prices, P.resolve_pairs(asked, prices)


def price_asked_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, pair_map = _resolved(spark, sf_dir)
    series = P.asked_series(P.daily_sums(facts, pair_map), pair_map)
    return _rounded(P.pair_series(series, pair_map), modal_price=4)


def price_location_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, pair_map = _resolved(spark, sf_dir)
    series = P.asked_series(P.daily_sums(facts, pair_map), pair_map)
    stats = P.pair_stats(series, pair_map).select(
        *P.PAIR, "stats_scope", "n", "latest_price", "percent_change", "forecast_14d",
        "trend_direction",
    )
    return _rounded(stats, latest_price=4, percent_change=4, forecast_14d=4)


def price_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, pair_map = _resolved(spark, sf_dir)
    rows = P.pair_headlines(P.daily_sums(facts, pair_map), pair_map)
    return _rounded(rows, modal_price=4)


HEADLINES = """
headlines AS (
  SELECT term, loc, commodity,
         CASE WHEN loc IS NOT NULL THEN min(row(market, state))[1] END AS market,
         CASE WHEN loc IS NOT NULL THEN min(row(market, state))[2] ELSE min(state) END AS state,
         avg(modal_price) AS modal_price
  FROM facts WHERE loc IS NULL OR stats_scope = 'located'
  GROUP BY term, loc, commodity
)"""


def price_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, asked = _asked(spark, sf_dir)
    records = P.price_records(prices, asked).drop("result", "columns")
    return _rounded(records, modal_price=4)


def price_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pair_map = _resolved(spark, sf_dir)
    explained = render.explanation(F.col("term"), F.col("loc")).alias("explanation")
    return P.pair_titles(pair_map).select("term", "loc", explained, "title")


def price_asked_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart rows of every asked pair: series and 7-row mean, with scope and title."""
    facts, pair_map = _resolved(spark, sf_dir)
    series = P.asked_series(P.daily_sums(facts, pair_map), pair_map)
    return _rounded(P.asked_charts(series, pair_map), value=4)


# --- results --------------------------------------------------------------


def _market_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average price per state and commodity: the rows of one question per state."""
    return (
        V.prices_star(spark, sf_dir)
        .groupBy("state", "market", "commodity")
        .agg(V.settled(F.avg("modal_price"), 4).alias("modal_price"))
    )


def answer_display_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.display_rows(
        _market_headlines(spark, sf_dir), ["state"], ["market", "commodity"]
    )


def answer_records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, pair_map = _resolved(spark, sf_dir)
    rows = P.pair_headlines(P.daily_sums(facts, pair_map), pair_map)
    summary = P.headline_summary(_rounded(rows, modal_price=4))
    return summary.select(*P.PAIR, "result", F.array_join("columns", ",").alias("columns"))


def delta_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _star_stats(spark, sf_dir)
    percent = render.exact_round(F.col("percent_change"))
    language = F.when(F.col("commodity").contains("A"), F.lit("hi")).otherwise(F.lit("en"))
    return stats.select(*PLACE, render.delta_badge(percent, language).alias("delta"))


def answer_text_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, asked = _asked(spark, sf_dir)
    records = P.price_records(prices, asked)
    return records.select(
        *P.PAIR,
        render.price_answer_text(
            F.col("n_rows"), F.col("modal_price"), F.col("forecast_14d"), F.col("trend_direction")
        ).alias("answer_text"),
        render.money(F.col("latest_price")).alias("latest_shown"),
    )


def answer_text_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices, asked = _asked(spark, sf_dir)
    records = _rounded(P.price_records(prices, asked), modal_price=4)
    columns = {
        "commodity": F.col("commodity"),
        "market": F.col("market"),
        "state": F.col("state"),
        "modal_price": render.plain_number(F.col("modal_price")),
    }
    hindi = F.when(F.col("term").contains("A"), F.lit("hi")).otherwise(F.lit("en"))
    return records.select(
        *P.PAIR, render.chat_answer_text(F.col("n_rows"), columns, hindi).alias("answer_text")
    )


SUMMARY = f"""
{HEADLINES.strip()},
summary AS (
  SELECT term, loc, count(*) AS n_rows,
         CASE WHEN count(*) = 1 THEN min(commodity) END AS commodity,
         CASE WHEN count(*) = 1 THEN min(market) END AS market,
         CASE WHEN count(*) = 1 THEN min(state) END AS state,
         CASE WHEN count(*) = 1 THEN min(modal_price) END AS modal_price
  FROM headlines GROUP BY term, loc
),
records AS (
  SELECT s.term, s.loc, s.stats_scope, n AS series_rows,
         {V.two_places('latest_price')} AS latest_price,
         {V.two_places('percent_change')} AS percent_change, trend_direction,
         {V.two_places('forecast_14d')} AS forecast_14d, coalesce(n_rows, 0) AS n_rows,
         commodity, market, state, modal_price,
         'Query executed for commodity=''' || s.term || CASE WHEN s.loc IS NULL
           THEN ''' across available regions.' ELSE ''', location=''' || s.loc || '''.' END
           AS explanation,
         'average price by commodity' || CASE WHEN s.loc IS NULL THEN '' ELSE ' at a location' END
           AS query
  FROM stats s LEFT JOIN summary h ON s.term = h.term AND s.loc IS NOT DISTINCT FROM h.loc
)"""
PAIR_STATS = f"WITH {V.STAR}, {V.ASKED}, {V.fit_sql('term, loc, stats_scope')}"
RECORDS = f"{PAIR_STATS}, {SUMMARY}"


# --- loading --------------------------------------------------------------


def price_stored_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of asked pairs from a stored table: terms meet its catalogue, and one pruned scan its facts."""
    prices, asked = _asked(spark, sf_dir)
    path = new_folder(spark, "prices")
    version = L.write_prices(prices, path)
    stored = L.open_prices(spark, path, prices.schema, version)
    pair_map = P.resolve_pairs(asked.where("term <> 'STANDARD'"), stored, L.open_catalogue(spark, path, version))
    return _rounded(P.pair_headlines(P.daily_sums(stored, pair_map), pair_map), modal_price=4)


def price_replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a price table in its two versions; the first stays readable after the second is written."""
    prices = V.prices_events(spark, sf_dir)
    path = new_folder(spark, "prices")
    first = L.write_prices(prices.where("commodity <> 'view'"), path)
    L.write_prices(prices, path)
    tables = {"first": L.open_prices(spark, path, prices.schema, first), "newest": L.open_prices(spark, path, prices.schema)}
    counts = [t.groupBy("commodity").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("version"), "*") for n, t in tables.items()]
    return counts[0].unionByName(counts[1])


def price_stats_by_addition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics from monthly moments after three loads: old facts, new ones, and late ones of all days."""
    prices = V.prices_star(spark, sf_dir)
    late = F.col("market").endswith("7")
    old = F.col("date") < F.lit("1999-06-15").cast("date")
    path = new_folder(spark, "state")
    for load in (old & ~late, ~old & ~late, late):
        M.add_prices(prices.where(load), path, PLACE)
    return _shown(M.series_stats(M.open_moments(spark, path), PLACE), PLACE)


def load_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.to_prices(V.raw_events(spark, sf_dir))


def load_csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text table to CSV, CSV to price table, price table back."""
    csv = new_folder(spark, "csv")
    V.raw_events(spark, sf_dir).drop("record").write.option("header", True).csv(csv)
    return L.load_prices(spark, csv, new_folder(spark, "prices"))


def load_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stored table, counted after the load."""
    table = new_folder(spark, "prices")
    L.write_prices(L.to_prices(V.raw_events(spark, sf_dir)), table)
    return L.row_count(L.open_prices(spark, table))


def load_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two column orders, with line feeds in quotes, united by name."""
    raw = V.raw_events(spark, sf_dir)
    even = F.col("record").cast("long") % 2 == 0
    market = F.concat("market", F.lit("\n\"east\""))
    folders = [new_folder(spark, "csv"), new_folder(spark, "csv")]
    for folder, part, columns in (
        (folders[0], raw.where(even), raw.columns),
        (folders[1], raw.where(~even), raw.columns[::-1]),
    ):
        written = part.withColumn("market", market).select(*columns)
        written.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    return L.to_prices(L.read_price_files(spark, folders, multi_line=True))


def load_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded rows, and those left out by error, of files with broken lines and bad dates."""
    event, user = F.col("event_id"), F.col("user_id")
    csv = new_folder(spark, "csv")
    cells = (
        F.when(event % 7 == 0, F.lit("2024-99-01")).otherwise(F.col("ts").cast("date").cast("string")),
        F.col("event_type"), F.concat(F.lit("m"), user.cast("string")), F.when(event % 10 == 0, F.lit("extra")), F.lit("s"),
        *((user % n).cast("string") for n in (10, 20, 30)),
    )
    header = "date,commodity,market,state,min_price,max_price,modal_price"
    lines = V.table(spark, sf_dir, "events").select(F.concat_ws(",", *cells).alias(header))
    lines.write.option("header", True).option("sep", "\u0001").csv(csv)  # whole lines, as they are
    path = new_folder(spark, "prices")
    version = L.load_checked(spark, csv, path)
    good = L.open_prices(spark, path, version=version).groupBy("commodity").agg(
        F.lit(None).cast("string").alias("error"), F.count("*").alias("n_rows"), F.max("modal_price").alias("top"),
        F.lit(None).cast("string").alias("record"),
    )
    bad = L.open_errors(spark, path, version).groupBy("error").agg(F.count("*").alias("n_rows"), F.min("record").alias("record"))
    none = F.lit(None)
    return good.unionByName(bad.select(none.cast("string").alias("commodity"), "error", "n_rows", none.cast("double").alias("top"), "record"))


def load_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.column_report(L.to_prices(V.raw_events(spark, sf_dir)))


def load_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sample(L.to_prices(V.raw_events(spark, sf_dir)))


_LOADED = "SELECT date, commodity, market, state, min_price, max_price, modal_price"
_REPORT = " UNION ALL ".join(
    f"SELECT CAST({i} AS bigint) AS ord, '{name}' AS name, '{kind}' AS type,"
    f" count(*) AS n_rows, count({name}) AS n_values FROM loaded"
    for i, (name, kind) in enumerate(
        [("date", "date"), ("commodity", "string"), ("market", "string"), ("state", "string"),
         ("min_price", "double"), ("max_price", "double"), ("modal_price", "double"),
         ("record", "string")]
    )
)

QUERIES = {
    "price_stats": Query(price_stats, _stats_sql(V.STAR, "commodity", f"n, {STATS_SELECT}")),
    "price_stats_events": Query(
        price_stats_events, _stats_sql(V.EVENTS, "commodity, state", f"n, {STATS_SELECT}")
    ),
    "price_series": Query(
        price_series,
        f"WITH {V.STAR}, {_series_cte('commodity')}"
        " SELECT commodity, date, round(modal_price + 3.183e-8, 4) AS modal_price FROM series",
    ),
    "price_series_location": Query(
        price_series_location,
        f"WITH {V.STAR} SELECT commodity, date, round(avg(modal_price) + 3.183e-8, 4) AS modal_price"
        " FROM prices WHERE market ILIKE '%nation_1%' OR state ILIKE '%nation_1%'"
        " GROUP BY commodity, date",
    ),
    "price_avg": Query(
        price_avg,
        f"WITH {V.STAR} SELECT commodity, min(state) AS state,"
        " round(avg(modal_price) + 3.183e-8, 4) AS modal_price FROM prices GROUP BY commodity",
    ),
    "price_avg_location": Query(
        price_avg_location,
        f"WITH {V.STAR} SELECT commodity, min(row(market, state))[1] AS market,"
        " min(row(market, state))[2] AS state, round(avg(modal_price) + 3.183e-8, 4) AS modal_price"
        " FROM prices WHERE commodity ILIKE '%s%'"
        " AND (market ILIKE '%nation_1%' OR state ILIKE '%nation_1%') GROUP BY commodity",
    ),
    "price_ma7": Query(
        price_ma7,
        f"WITH {V.STAR}, {_series_cte('commodity')} SELECT commodity, date,"
        " round(modal_price + 3.183e-8, 4) AS modal_price,"
        " date_diff('day', min(date) OVER (PARTITION BY commodity), date) AS day_index,"
        " round(avg(modal_price) OVER (PARTITION BY commodity ORDER BY date"
        " ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 3.183e-8, 4) AS ma_7 FROM series",
    ),
    "price_pct_change": Query(
        price_pct_change,
        _stats_sql(
            V.STAR, "commodity, state",
            "round(earliest_price + 3.183e-8, 4) AS earliest_price, round(latest_price + 3.183e-8, 4) AS latest_price,"
            " round(percent_change + 3.183e-8, 4) AS percent_change",
        ),
    ),
    "price_ols": Query(
        price_ols,
        _stats_sql(
            V.STAR, "commodity, state",
            "n, round(slope + 3.183e-10, 6) AS slope, round(intercept + 3.183e-8, 4) AS intercept",
        ),
    ),
    "price_forecast": Query(
        price_forecast,
        _stats_sql(V.STAR, "commodity, state", "round(forecast_14d + 3.183e-8, 4) AS forecast_14d"),
    ),
    "price_trend": Query(
        price_trend, _stats_sql(V.EVENTS, "commodity, market", "trend_direction")
    ),
    "price_chart_long": Query(
        price_chart_long,
        f"WITH {V.STAR}, {_series_cte('commodity')}, averaged AS (SELECT commodity, date,"
        " modal_price, avg(modal_price) OVER (PARTITION BY commodity ORDER BY date"
        " ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma_7 FROM series)"
        " SELECT commodity, date, 'modal_price' AS variable, round(modal_price + 3.183e-8, 4) AS value"
        " FROM averaged UNION ALL"
        " SELECT commodity, date, 'ma_7' AS variable, round(ma_7 + 3.183e-8, 4) AS value FROM averaged",
    ),
    "price_asked_series": Query(
        price_asked_series,
        f"WITH {V.STAR}, {V.ASKED} SELECT term, loc, stats_scope, date,"
        " round(modal_price + 3.183e-8, 4) AS modal_price FROM series",
    ),
    "price_location_fallback": Query(
        price_location_fallback,
        f"{PAIR_STATS} SELECT term, loc, stats_scope, n, round(latest_price + 3.183e-8, 4) AS latest_price,"
        " round(percent_change + 3.183e-8, 4) AS percent_change, round(forecast_14d + 3.183e-8, 4) AS forecast_14d,"
        " trend_direction FROM stats",
    ),
    "price_headlines": Query(
        price_headlines,
        f"WITH {V.STAR}, {V.ASKED}, {HEADLINES} SELECT term, loc, commodity, market, state,"
        " round(modal_price + 3.183e-8, 4) AS modal_price FROM headlines",
    ),
    "price_records": Query(
        price_records,
        f"{RECORDS} SELECT * REPLACE (round(modal_price + 3.183e-8, 4) AS modal_price) FROM records",
    ),
    "price_explain": Query(
        price_explain,
        f"WITH {V.STAR}, {V.ASKED} SELECT term, loc,"
        " 'Query executed for commodity=''' || term || CASE WHEN loc IS NULL"
        " THEN ''' across available regions.' ELSE ''', location=''' || loc || '''.' END"
        " AS explanation, 'Price Trend & Moving Average (' || term || ' - '"
        " || CASE WHEN stats_scope = 'located' THEN loc ELSE 'All Regions' END || ')' AS title FROM scopes",
    ),
    "price_asked_chart": Query(
        price_asked_chart,
        f"WITH {V.STAR}, {V.ASKED}, charted AS (SELECT *, avg(modal_price) OVER (PARTITION BY term, loc"
        " ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma_7,"
        " 'Price Trend & Moving Average (' || term || ' - '"
        " || CASE WHEN stats_scope = 'located' THEN loc ELSE 'All Regions' END || ')' AS title FROM series)"
        " SELECT term, loc, stats_scope, title, date, 'modal_price' AS variable,"
        " round(modal_price + 3.183e-8, 4) AS value FROM charted UNION ALL"
        " SELECT term, loc, stats_scope, title, date, 'ma_7', round(ma_7 + 3.183e-8, 4) FROM charted",
    ),
    "answer_display_limit": Query(
        answer_display_limit,
        f"WITH {V.STAR}, ranked AS (SELECT state, market, commodity,"
        " round(avg(modal_price) + 3.183e-8, 4) AS modal_price,"
        " row_number() OVER (PARTITION BY state ORDER BY market, commodity) AS row_no"
        " FROM prices GROUP BY state, market, commodity)"
        " SELECT * FROM ranked WHERE row_no <= 15",
    ),
    "answer_records_json": Query(
        answer_records_json,
        f"WITH {V.STAR}, {V.ASKED}, {HEADLINES} SELECT term, loc, '[' || string_agg("
        "CASE WHEN loc IS NULL THEN CAST(to_json({'commodity': commodity, 'state': state,"
        " 'modal_price': round(modal_price + 3.183e-8, 4)}) AS varchar)"
        " ELSE CAST(to_json({'commodity': commodity, 'market': market, 'state': state,"
        " 'modal_price': round(modal_price + 3.183e-8, 4)}) AS varchar) END,"
        " ',' ORDER BY commodity) || ']' AS result, CASE WHEN loc IS NULL"
        " THEN 'commodity,state,modal_price' ELSE 'commodity,market,state,modal_price' END"
        " AS columns FROM headlines GROUP BY term, loc",
    ),
    "delta_badge": Query(
        delta_badge,
        _stats_sql(
            V.STAR, "commodity, state",
            f"CASE WHEN {V.two_places('percent_change')} > 0 THEN '▲ '"
            f" WHEN {V.two_places('percent_change')} < 0 THEN '▼ ' END"
            f" || printf('%.1f', abs({V.two_places('percent_change')})) || '% '"
            " || CASE WHEN contains(commodity, 'A') THEN 'हाल के रिकॉर्ड में'"
            " ELSE 'over recent records' END AS delta",
        ),
    ),
    "answer_text_price": Query(
        answer_text_price,
        f"{RECORDS} SELECT term, loc, CASE WHEN n_rows = 1 THEN 'Average modal price: **₹'"
        " || format('{:,.2f}', modal_price) || '** per quintal.' || CASE WHEN"
        " coalesce(forecast_14d, 0) <> 0 THEN E'\\n\\n🔮 **14-Day Trend Forecast:** ₹'"
        " || regexp_replace(printf('%.2f', forecast_14d), '0$', '') || '/quintal ('"
        " || trend_direction || ' trajectory).' ELSE '' END"
        " ELSE 'No data found for this query.' END AS answer_text,"
        " '₹' || format('{:,.2f}', latest_price) AS latest_shown FROM records",
    ),
    "answer_text_chat": Query(
        answer_text_chat,
        f"{RECORDS} SELECT term, loc, CASE WHEN n_rows = 1 THEN"
        " '**commodity**: ' || commodity || coalesce(' | **market**: ' || market, '')"
        " || ' | **state**: ' || state || ' | **modal_price**: '"
        " || CAST(round(modal_price + 3.183e-8, 4) AS varchar)"
        " WHEN n_rows > 1 THEN CASE WHEN contains(term, 'A') THEN '**' || n_rows ||"
        " ' डेटा पॉइंट** मिले। नीचे चार्ट और डेटा देखें।' ELSE 'Found **' || n_rows ||"
        " ' data points**. See the chart and data below.' END"
        " WHEN contains(term, 'A') THEN 'इस सवाल के लिए कोई डेटा नहीं मिला।'"
        " ELSE 'No data found for this query.' END AS answer_text FROM records",
    ),
    "price_stored_catalogue": Query(
        price_stored_catalogue,
        f"WITH {V.STAR}, {V.ASKED}, {HEADLINES} SELECT term, loc, commodity, market, state,"
        " round(modal_price + 3.183e-8, 4) AS modal_price FROM headlines WHERE term <> 'STANDARD'",
    ),
    "price_replaced_table": Query(
        price_replaced_table,
        f"WITH {V.EVENTS} SELECT version, commodity, count(*) AS n_rows FROM prices"
        " CROSS JOIN (VALUES ('first'), ('newest')) v(version)"
        " WHERE version = 'newest' OR commodity <> 'view' GROUP BY version, commodity",
    ),
    "price_stats_by_addition": Query(
        price_stats_by_addition, _stats_sql(V.STAR, "commodity, state", f"n, {STATS_SELECT}")
    ),
    "load_coerce": Query(load_coerce, f"WITH {V.RAW} {_LOADED}, record FROM loaded"),
    "load_csv_table": Query(load_csv_table, f"WITH {V.RAW} {_LOADED} FROM loaded"),
    "load_count": Query(load_count, f"WITH {V.RAW} SELECT count(*) AS n_rows FROM loaded"),
    "load_checked": Query(
        load_checked,
        "WITH cells AS (SELECT event_id, event_type AS commodity, user_id % 30 AS modal_price,"
        " CASE WHEN event_id % 7 = 0 THEN '2024-99-01' ELSE CAST(CAST(ts AS date) AS varchar) END AS day,"
        " 'm' || CAST(user_id AS varchar) AS market, CAST(user_id % 10 AS varchar) AS low,"
        " CAST(user_id % 20 AS varchar) AS high FROM events),"
        " told AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 'broken line' WHEN event_id % 7 = 0 THEN 'bad date' END AS error,"
        " CASE WHEN event_id % 10 = 0 THEN concat_ws(',', day, commodity, market, 'extra', 's', low, high, CAST(modal_price AS varchar))"
        " ELSE '{\"date\":\"' || day || '\",\"commodity\":\"' || commodity || '\",\"market\":\"' || market || '\",\"state\":\"s\","
        "\"min_price\":\"' || low || '\",\"max_price\":\"' || high || '\",\"modal_price\":\"' || CAST(modal_price AS varchar) || '\"}' END AS whole"
        " FROM cells) SELECT CASE WHEN error IS NULL THEN commodity END AS commodity, error, count(*) AS n_rows,"
        " CASE WHEN error IS NULL THEN CAST(max(modal_price) AS double) END AS top,"
        " CASE WHEN error IS NOT NULL THEN min(whole) END AS record FROM told"
        " GROUP BY CASE WHEN error IS NULL THEN commodity END, error",
    ),
    "load_by_name": Query(
        load_by_name,
        f"WITH {V.RAW} SELECT date, commodity, market || chr(10) || '\"east\"' AS market, state,"
        " min_price, max_price, modal_price, record FROM loaded",
    ),
    "load_schema": Query(load_schema, f"WITH {V.RAW} {_REPORT}"),
    "load_sample": Query(
        load_sample,
        f"WITH {V.RAW} {_LOADED}, record FROM loaded ORDER BY date, commodity, market,"
        " state NULLS FIRST, min_price NULLS FIRST, max_price, modal_price, record LIMIT 5",
    ),
}
