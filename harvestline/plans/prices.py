"""Price answers for many (commodity term, location) pairs in one pass.

Terms and locations are matched against the catalogue of dimension values only,
which is stored beside the facts when they are loaded. The result is a small map
from (commodity, market, state) to the result lines a fact row belongs to; where few
places are asked for, from the commodity and the asked places that a row matches, as
lines times markets may be more than the facts. One scan
of the facts, without commodities that nobody asks for, then adds them up per line
and date: each task sends a line's dates, so no fact row is shuffled. Series,
statistics and headline averages are all read from these daily sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import lexicon, session
from ..functions import render
from ..operators import series as S
from ..operators.matching import contains_pairs, join_same
from ..session import is_small, small_rows, stage
from ..sources.prices import catalogue

DIMS = ["commodity", "market", "state"]
PAIR = ["term", "loc"]
SERIES = ["term", "series_loc"]
# The asked places that a row's market or state matches.
PLACES = "_places"
LOCATED, ALL = "located", "all"
MAX_LINES = 10_000
# Asked pairs and distinct names up to which the match is one projection.
MAX_FOLDED_PAIRS, MAX_FOLDED_NAMES = 2_000, 200


def asked_pairs(spark: SparkSession, commodities: list[str], locations: list[str]) -> DataFrame:
    """Every pair a gazetteer can produce, the missing location included."""
    rows = [(term, loc) for term in commodities for loc in [*locations, None]]
    terms, places = zip(*rows) if rows else ((), ())
    return spark.createDataFrame(
        pa.table({"term": pa.array(terms, pa.string()), "loc": pa.array(places, pa.string())})
    )


@dataclass(frozen=True)
class PairMap:
    """What each asked pair resolves to.

    ``scopes``: (term, loc, stats_scope, series_loc) per pair; a located pair
    that no fact matches reads the all-region series of its term.
    ``lines``: (line, term, series_loc, commodity, shown market and state) per
    stored commodity of a series; ``line`` is a number.
    ``members``: (commodity, market, state, line): the lines a fact adds to. With
    ``places``, the asked locations if they are few, (commodity, _places, cell, line)
    instead; all facts of a ``cell`` add to the same lines.
    ``commodities``: the stored commodities in question, if they are few; facts of
    others are not read.
    """

    scopes: DataFrame
    lines: DataFrame
    members: DataFrame
    members_small: bool
    commodities: list[str] | None
    places: list[str] | None = None
    sum_cells: bool = False


def _match_dims(pairs: DataFrame, dims: DataFrame) -> DataFrame:
    """(term, series_loc, commodity, market, state) of every asked term as a
    whole (``series_loc`` NULL) and of every asked pair with a location."""
    goods = contains_pairs(pairs, dims, "term", "commodity")
    place_names = dims.select(F.explode(F.array_distinct(F.array("market", "state"))).alias("value"))
    places = contains_pairs(pairs, place_names, "loc", "value")
    at_market = places.withColumnRenamed("value", "market")
    at_state = places.withColumnRenamed("value", "state")
    spots = dims.select("market", "state").distinct()
    placed = (
        spots.join(at_market, "market")
        .select("loc", "market", "state")
        .union(spots.join(at_state, "state").select("loc", "market", "state"))
        .distinct()
    )
    everywhere = dims.join(goods, "commodity")
    located = join_same(everywhere, placed, ["market", "state"]).join(pairs, PAIR, "left_semi")
    nowhere = F.lit(None).cast("string")
    return everywhere.select("term", nowhere.alias("series_loc"), *DIMS).unionByName(
        located.select("term", F.col("loc").alias("series_loc"), *DIMS)
    )


def _hits(values: list[str], hit) -> Column:
    """Those of ``values`` that hit, in order."""
    return F.array_compact(F.array(*(F.when(hit(v), F.lit(v)) for v in values)).cast("array<string>"))


def _at_places(places: list[str]) -> Column:
    return _hits(places, lambda loc: S.matches("market", loc) | S.matches("state", loc))


def _match_folded(pairs: list, dims: DataFrame) -> tuple[DataFrame, list[str]]:
    """The series and commodities of :func:`_match_dims` for few pairs, by a projection of the dimensions.

    (term, series_loc, commodity, _places, _place, _state), with the smallest place of
    the dimensions that match the same asked places, and the list of all asked places.
    """
    asked: dict[str, list[str]] = {}
    for row in pairs:
        asked.setdefault(row["term"], []).extend([] if row["loc"] is None else [row["loc"]])
    places = list(dict.fromkeys(loc for locs in asked.values() for loc in locs))
    terms = _hits(list(asked), lambda t: S.matches("commodity", t))
    sets = dims.where(F.size(terms) > 0).groupBy("commodity", _at_places(places).alias(PLACES)).agg(
        F.min(F.struct("market", "state")).alias("_place"), F.min("state").alias("_state")
    )
    texts = "array<string>"
    wanted = F.coalesce(*(F.when(F.col("term") == t, F.lit(locs).cast(texts)) for t, locs in asked.items()))
    termed = stage(sets, "places").withColumn("term", F.explode(terms))
    nowhere = F.array(F.lit(None).cast("string"))
    located = F.explode(F.concat(nowhere, F.array_intersect(PLACES, wanted))).alias("series_loc")
    return termed.select("term", located, "commodity", PLACES, "_place", "_state"), places


def _foldable(pairs: list | None) -> bool:
    return bool(pairs) and len({r["term"] for r in pairs} | {r["loc"] for r in pairs}) <= MAX_FOLDED_NAMES


def _numbered(lines: DataFrame) -> tuple[DataFrame, list | None]:
    """Lines with a fixed ``line`` number, and their rows if they are few.

    Few lines become a literal table, so later joins need no job for them.
    """
    found = lines.limit(MAX_LINES + 1).toArrow()
    if found.num_rows > MAX_LINES:
        return stage(lines.withColumn("line", F.monotonically_increasing_id()), "lines"), None
    numbered = found.append_column("line", pa.array(range(found.num_rows), pa.int64()))
    return lines.sparkSession.createDataFrame(numbered), numbered.to_pylist()


def _scopes(pairs: DataFrame, listed: list | None, lines: DataFrame, known: list | None) -> DataFrame:
    """(term, loc, stats_scope, series_loc) of every pair, as a literal table if all is known."""
    if listed is not None and known is not None:
        hit = {(line["term"], line["series_loc"]) for line in known if line["series_loc"] is not None}
        found = [(row["term"], row["loc"]) in hit for row in listed]
        return pairs.sparkSession.createDataFrame(
            pa.table(
                {
                    "term": pa.array([row["term"] for row in listed], pa.string()),
                    "loc": pa.array([row["loc"] for row in listed], pa.string()),
                    "stats_scope": pa.array([LOCATED if h else ALL for h in found], pa.string()),
                    "series_loc": pa.array([row["loc"] if h else None for row, h in zip(listed, found)], pa.string()),
                }
            )
        )
    hit = lines.where(F.col("series_loc").isNotNull()).select("term", F.col("series_loc").alias("loc")).distinct()
    return join_same(pairs, hit.withColumn("_hit", F.lit(True)), PAIR, "left").select(
        *PAIR,
        F.when(F.col("_hit"), F.lit(LOCATED)).otherwise(F.lit(ALL)).alias("stats_scope"),
        F.when(F.col("_hit"), F.col("loc")).alias("series_loc"),
    )


def resolve_pairs(asked: DataFrame, facts: DataFrame, dims: DataFrame | None = None) -> PairMap:
    """Match asked (term, loc) pairs to the dimension values of the facts.

    ``dims`` is their stored catalogue; without it the values are read off the facts.
    Few pairs are folded into a projection of the dimensions; more are joined by keys.
    """
    pairs = asked.select("term", F.nullif("loc", F.lit("")).alias("loc")).distinct()
    pairs = pairs.where(F.col("term").isNotNull())
    listed = small_rows(pairs, MAX_FOLDED_PAIRS)
    dims = stage(catalogue(facts), "dims") if dims is None else dims
    places = None
    if _foldable(listed):
        matched, places = _match_folded(listed, dims)
        shown = [F.octet_length(F.array_join(PLACES, ",")), *map(F.octet_length, ("commodity", *SERIES))]
    else:
        pairs = stage(pairs, "pairs")
        matched = stage(_match_dims(pairs, dims), "matched")
        shown = [F.octet_length(c) for c in (*DIMS, *SERIES)]
        matched = matched.withColumns({"_place": F.struct("market", "state"), "_state": F.col("state")})

    # The shown place is the smallest pair (or state), as no row is preferred.
    is_located = F.col("series_loc").isNotNull()
    octets = sum(F.coalesce(size, F.lit(0)) for size in shown)
    smallest = matched.groupBy(*SERIES, "commodity").agg(
        F.min("_place").alias("_place"), F.min("_state").alias("_state"),
        F.count("*").alias("_rows"), F.sum(octets).alias("_octets"),
    )
    lines, known = _numbered(
        smallest.select(
            *SERIES,
            "commodity",
            F.when(is_located, F.col("_place.market")).alias("market"),
            F.when(is_located, F.col("_place.state")).otherwise(F.col("_state")).alias("state"),
            "_rows",
            "_octets",
        )
    )
    if known is None:
        small = is_small(stage(matched.drop("_place", "_state"), "matched"))
        commodities = small_rows(lines.select("commodity").distinct(), MAX_LINES)
    else:
        rows, size = (sum(line[c] for line in known) for c in ("_rows", "_octets"))
        small = rows <= session.MAX_BROADCAST_ROWS and size <= session.MAX_BROADCAST_BYTES
        commodities = known
    named = None if commodities is None else sorted({row["commodity"] for row in commodities})
    lines = lines.drop("_rows", "_octets")
    scopes = _scopes(pairs, listed, lines, known)
    members = join_same(matched, lines.select("line", *SERIES, "commodity"), [*SERIES, "commodity"])
    if places is None:
        return PairMap(scopes, lines, members.select(*DIMS, "line"), small, named)
    cells = members.groupBy("commodity", PLACES).agg(F.collect_list("line").alias("line"))
    cells = stage(cells.withColumn("cell", F.monotonically_increasing_id()), "price-cells")
    held, copies = cells.agg(F.count("*"), F.sum(F.size("line"))).first()
    members = cells.select("commodity", PLACES, "cell", F.explode("line").alias("line"))
    # Facts that would be copied to several lines each are summed before that.
    return PairMap(scopes, lines, members, small, named, places, bool(held) and copies > 2 * held)


def daily_cube(prices: DataFrame) -> DataFrame:
    """(commodity, market, state, date) with the sum and count of prices, stored.

    It stands in for the facts where many of them share a place and a day; where
    few do, it is no smaller than they are.
    """
    cube = prices.groupBy(*DIMS, "date").agg(
        F.sum("modal_price").alias("_sum"), F.count("modal_price").alias("_n")
    )
    return stage(cube, "cube")


def daily_sums(facts: DataFrame, pair_map: PairMap) -> DataFrame:
    """(line, date) with the sum and count of prices, from raw facts or their daily cube.

    Raw rows are summed, so later averages weigh every row alike.
    """
    if "_sum" not in facts.columns:
        facts = facts.select(
            *DIMS, "date", F.col("modal_price").alias("_sum"), F.col("modal_price").isNotNull().cast("long").alias("_n")
        )
    if pair_map.commodities is not None:
        facts = facts.where(F.col("commodity").isin(pair_map.commodities))
    if pair_map.places is not None:
        facts = facts.select("commodity", _at_places(pair_map.places).alias(PLACES), "date", "_sum", "_n")
        keys, members = ["commodity", PLACES], pair_map.members
        if pair_map.sum_cells:
            cells = members.select(*keys, "cell").distinct()
            facts = join_same(facts, cells, keys, small=pair_map.members_small).groupBy("cell", "date").agg(
                F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n")
            )
            keys = ["cell"]
        joined = join_same(facts, members.select(*keys, "line"), keys, small=pair_map.members_small)
        return joined.groupBy("line", "date").agg(F.sum("_sum").alias("price_sum"), F.sum("_n").alias("price_n"))
    if not pair_map.members_small:  # the facts are shuffled then, so they are summed first
        facts = facts.groupBy(*DIMS, "date").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    joined = join_same(facts, pair_map.members, DIMS, small=pair_map.members_small)
    return joined.groupBy("line", "date").agg(
        F.sum("_sum").alias("price_sum"), F.sum("_n").alias("price_n")
    )


def _mean() -> Column:
    return F.sum("price_sum") / F.nullif(F.sum("price_n"), F.lit(0))


def asked_series(daily: DataFrame, pair_map: PairMap) -> DataFrame:
    """(term, series_loc, date, modal_price): all commodities of a term together."""
    named = daily.join(pair_map.lines.select("line", *SERIES), "line")
    return named.groupBy(*SERIES, "date").agg(_mean().alias("modal_price"))


def pair_stats(series: DataFrame, pair_map: PairMap) -> DataFrame:
    """Statistics of each asked pair's series, unrounded."""
    stats = S.price_stats(series, SERIES)
    return join_same(pair_map.scopes, stats, SERIES).select(
        *PAIR, "stats_scope", *(c for c in stats.columns if c not in SERIES)
    )


def pair_series(series: DataFrame, pair_map: PairMap) -> DataFrame:
    """Series rows of each asked pair, with the scope they come from."""
    return join_same(pair_map.scopes, series, SERIES).select(
        *PAIR, "stats_scope", "date", "modal_price"
    )


def pair_titles(pair_map: PairMap) -> DataFrame:
    """(term, loc, stats_scope, title): what a pair's chart shows.

    The title names the place of the series that is drawn, so all regions after
    a fallback.
    """
    title = render.chart_title(F.col("term"), F.col("series_loc"))
    return pair_map.scopes.select(*PAIR, "stats_scope", title.alias("title"))


def asked_charts(series: DataFrame, pair_map: PairMap) -> DataFrame:
    """Long-form chart rows of each asked pair: its series with the 7-row mean, scope and title."""
    points = S.chart_points(S.moving_average(series, SERIES), SERIES)
    title = render.chart_title(F.col("term"), F.col("series_loc"))
    return join_same(pair_map.scopes, points, SERIES).select(
        *PAIR, "stats_scope", title.alias("title"), "date", "variable", "value"
    )


def pair_headlines(daily: DataFrame, pair_map: PairMap) -> DataFrame:
    """(term, loc, commodity, market, state, modal_price) per stored commodity.

    A located pair without facts has no headline; only its series falls back.
    """
    averages = daily.groupBy("line").agg(_mean().alias("modal_price"))
    rows = averages.join(pair_map.lines, "line").select(
        "term", F.col("series_loc").alias("loc"), "commodity", "market", "state", "modal_price"
    )
    answered = pair_map.scopes.where(
        F.col("loc").isNull() | (F.col("stats_scope") == LOCATED)
    ).select(*PAIR)
    return join_same(rows, answered, PAIR, "left_semi")


def headline_summary(headlines: DataFrame) -> DataFrame:
    """(term, loc): row count, the row's values where there is just one, the
    rows as a JSON array, and their column names.

    A pair has one row per stored commodity it matches. Without a location
    there is no market column.
    """
    one = F.count("*") == 1
    shown = ["commodity", "market", "state", "modal_price"]
    plain = [c for c in shown if c != "market"]
    located = F.col("loc").isNotNull()

    def json(columns: list[str]) -> Column:
        picked = F.transform("_rows", lambda row: F.struct(*(row[c].alias(c) for c in columns)))
        return F.to_json(picked, {"ignoreNullFields": "false"})

    return (
        headlines.groupBy(*PAIR)
        .agg(
            F.count("*").alias("n_rows"),
            *(F.when(one, F.min(c)).alias(c) for c in shown),
            F.array_sort(F.collect_list(F.struct(*shown))).alias("_rows"),
        )
        .withColumn("result", F.when(located, json(shown)).otherwise(json(plain)))
        .withColumn("columns", F.when(located, F.lit(shown)).otherwise(F.lit(plain)))
        .drop("_rows")
    )


def price_records(
    prices: DataFrame | None, asked: DataFrame, cube: DataFrame | None = None, dims: DataFrame | None = None
) -> DataFrame:
    """One record per asked pair: headline, statistics and explanation.

    ``dims`` is the stored catalogue of the prices, if there is one; ``cube`` is a
    stored :func:`daily_cube` to read in place of the prices. Staged, so it has a
    true size and can be reused by batches and streams.
    """
    facts = prices if cube is None else cube
    if cube is None and dims is None:  # read twice: for their dimensions and for their sums
        facts = stage(prices.select(*DIMS, "date", "modal_price"), "facts")
    pair_map = resolve_pairs(asked, facts, dims)
    daily = stage(daily_sums(facts, pair_map), "daily")
    stats = S.stats_record(
        pair_stats(asked_series(daily, pair_map), pair_map), PAIR, "stats_scope", "n"
    ).withColumnRenamed("n", "series_rows")
    summary = headline_summary(pair_headlines(daily, pair_map))
    pairs = pair_map.scopes.select(*PAIR)
    joined = join_same(join_same(pairs, stats, PAIR, "left"), summary, PAIR, "left")
    records = (
        joined.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        .withColumn("result", F.coalesce("result", F.lit("[]")))
        .withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))
        .withColumn("explanation", render.explanation(F.col("term"), F.col("loc")))
        .withColumn("query", query_label(F.col("loc")))
    )
    return stage(records, "price-records")


def query_label(location: Column) -> Column:
    """Which of the two headline queries answered."""
    return F.when(
        location.isNotNull(), F.lit("average price by commodity at a location")
    ).otherwise(F.lit("average price by commodity"))


def display_rows(
    rows: DataFrame, keys: list[str], order: list[str], limit: int = lexicon.DISPLAY_ROWS
) -> DataFrame:
    """The first rows of each key, as shown in a result table."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("row_no", place.cast("bigint")).where(F.col("row_no") <= limit)
