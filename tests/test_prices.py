"""Loading, series, statistics, and asked pairs."""

import dataclasses
import datetime as dt
import os
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from harvestline import lexicon, schema
from harvestline.functions import render
from harvestline.operators import series as S
from harvestline.plans import prices as P
from harvestline.session import new_folder
from harvestline.sources import prices as L

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def series_of(spark, points):
    return spark.createDataFrame(
        [("k", day(x), y) for x, y in points], "k string, date date, modal_price double"
    )


def stats_of(spark, points):
    return S.price_stats(series_of(spark, points), ["k"]).first()


def test_line_fit(spark):
    found = stats_of(spark, [(4, 11.0), (0, 10.0), (7, 20.0), (1, 12.0)])
    assert found["slope"] == pytest.approx(1.2333333333)
    assert found["intercept"] == pytest.approx(9.55)
    assert found["forecast_14d"] == pytest.approx(9.55 + 1.2333333333 * 21)
    assert (found["earliest_price"], found["latest_price"]) == (10.0, 20.0)
    assert found["percent_change"] == pytest.approx(100.0)
    assert found["trend_direction"] == "upward"


def test_short_series_are_not_fitted(spark):
    for points in ([(0, 5.0)], [(0, 5.0), (1, 9.0)]):
        found = stats_of(spark, points)
        assert found["forecast_14d"] is None and found["slope"] is None
        assert found["trend_direction"] == "stable"
    assert stats_of(spark, [(0, 5.0), (1, 9.0)])["percent_change"] == pytest.approx(80.0)
    assert S.price_stats(series_of(spark, []), ["k"]).count() == 0


@pytest.mark.parametrize(
    "step, trend",
    [(0.5, "stable"), (-0.5, "stable"), (0.625, "upward"), (-0.625, "downward"), (0.0, "stable")],
)
def test_trend_bounds_are_strict(spark, step, trend):
    assert stats_of(spark, [(i, 100 + step * i) for i in range(9)])["trend_direction"] == trend


def test_zero_start_and_null_end(spark):
    assert stats_of(spark, [(0, 0.0), (1, 3.0)])["percent_change"] == 0.0
    found = stats_of(spark, [(0, 4.0), (1, 5.0), (2, None)])
    assert found["latest_price"] is None and found["percent_change"] is None
    assert found["n"] == 3 and found["slope"] == pytest.approx(1.0)


def test_record_rounds_like_the_display(spark):
    stats = S.price_stats(series_of(spark, [(0, 1.0), (1, 2.675)]), ["k"])
    record = S.stats_record(stats, ["k"]).first()
    assert record["latest_price"] == 2.67 and record["percent_change"] == 167.5


def test_moving_average_counts_rows_not_days(spark):
    points = [(0, 1.0), (1, 2.0), (40, None), (41, 6.0), *((50 + i, 1.0) for i in range(7))]
    averaged = S.moving_average(series_of(spark, points), ["k"])
    found = [row["ma_7"] for row in averaged.orderBy("date").collect()]
    assert found[:4] == [1.0, 1.5, 1.5, 3.0]
    assert found[-1] == 1.0
    indexed = S.day_index(series_of(spark, points), ["k"]).agg(F.max("day_index")).first()[0]
    assert indexed == 56


def test_columns_are_parameters_and_required(spark):
    df = series_of(spark, [(0, 1.0)]).withColumnsRenamed({"date": "d", "modal_price": "p"})
    assert S.price_stats(df, ["k"], "p", "d").first()["latest_price"] == 1.0
    with pytest.raises(ValueError, match="modal_price"):
        S.price_stats(df, ["k"])


# --- loading --------------------------------------------------------------

CSV = """commodity,date,market,state,min_price,max_price,modal_price,variety
Wheat,2024-01-01,Indore, MP , 12 ,"1,200",1e3,x
Wheat,2024-01-02,"In,dore",N/A,abc,nan,inf,NA
Onion,2024-01-02,None,MP,12d,0x1p3,,y
"""


def write(folder, text):
    path = os.path.join(folder, "prices.csv")
    with open(path, "w", encoding="utf-8") as file:
        file.write(text)
    return path


def test_files_of_other_column_orders(spark, tmp_path):
    """One folder of two orders fails; read by file they are united by name."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    head = "date,commodity,market,state,min_price,max_price,modal_price"
    (folder / "a.csv").write_text(f"{head}\n2024-01-01,Wheat,Indore,MP,1,2,3\n")
    swapped = head.replace("market,state", "state,market")
    (folder / "b.csv").write_text(f'{swapped}\n2024-01-02,Wheat,MP,"Indore\nEast",1,2,3\n')
    with pytest.raises(Exception, match="header"):
        L.read_price_text(spark, str(folder)).collect()
    both = L.read_price_files(spark, [str(folder / "a.csv"), str(folder / "b.csv")], multi_line=True)
    assert rows(both, "market", "state") == [("Indore", "MP"), ("Indore\nEast", "MP")]


def test_load(spark, tmp_path):
    loaded = L.to_prices(L.read_price_text(spark, write(tmp_path, CSV)))
    assert [f for f in loaded.schema][:7] == list(schema.PRICES)
    assert rows(loaded) == sorted(
        [
            (day(0), "Wheat", "Indore", " MP ", 12.0, None, 1000.0, "x"),
            (day(1), "Wheat", "In,dore", None, None, None, float("inf"), None),
            (day(1), "Onion", None, "MP", None, None, None, "y"),
        ],
        key=repr,
    )


def test_load_replaces_the_table(spark, tmp_path):
    table = new_folder(spark, "prices")
    csv = write(tmp_path, CSV)
    for _ in range(2):
        stored = L.load_prices(spark, csv, table)
        assert L.row_count(stored).first()["n_rows"] == 3
    assert stored.columns == [*schema.PRICE_COLUMNS, "variety"]
    assert rows(stored) == rows(L.to_prices(L.read_price_text(spark, csv)))
    report = {row["name"]: row for row in L.column_report(stored).collect()}
    assert report["modal_price"]["n_values"] == 2 and report["date"]["type"] == "date"
    assert L.sample(stored, 2).count() == 2


def test_bad_dates(spark, tmp_path):
    raw = L.read_price_text(spark, write(tmp_path, CSV.replace("2024-01-02", "not-a-date")))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        L.to_prices(raw).collect()
    assert L.to_prices(raw, strict=False).where("date is null").count() == 2
    text = CSV.replace("2024-01-02", "02/01/2024").replace("2024-01-01", "01/01/2024")
    slashed = L.read_price_text(spark, write(tmp_path, text))
    assert L.to_prices(slashed, "dd/MM/yyyy").agg(F.max("date")).first()[0] == day(1)


def test_missing_file_and_column(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        L.read_price_text(spark, str(tmp_path / "none.csv"))
    raw = spark.createDataFrame([("a",)], "commodity string")
    with pytest.raises(ValueError, match="modal_price"):
        L.to_prices(raw)


# --- asked pairs ----------------------------------------------------------


@pytest.fixture(scope="module")
def prices(spark):
    facts = [
        ("Wheat", "Indore", "MP", 0, 10.0), ("Wheat", "Indore", "MP", 0, 20.0),
        ("Wheat", "Bhopal", "MP", 0, 60.0), ("Wheat", "Bhopal", "MP", 5, 40.0),
        ("Wheat Durum", "Indore", "MP", 0, 30.0), ("Onion", "Pune", "Maharashtra", 1, None),
        ("Onion", "Pune", "Maharashtra", 2, 7.0), ("Rice", None, "Punjab", 3, 8.0),
    ]
    return spark.createDataFrame(
        [(day(n), c, m, s, p) for c, m, s, n, p in facts],
        "date date, commodity string, market string, state string, modal_price double",
    )


ASKED = [("wheat", None), ("Wheat", "indore"), ("Onion", "Punjab"), ("Rice", "punjab"),
         ("Rice", ""), ("Tomato", None), ("Wheat Durum", "MP"), ("Wheat", "indore")]


@pytest.mark.parametrize("small, lines", [(True, P.MAX_LINES), (False, 0), (False, 99)])
def test_asked_pairs(spark, prices, monkeypatch, small, lines):
    monkeypatch.setattr(P, "is_small", lambda df: small)
    monkeypatch.setattr(P, "MAX_LINES", lines)
    asked = spark.createDataFrame(ASKED, "term string, loc string")
    cube = P.daily_cube(prices)
    pair_map = P.resolve_pairs(asked, cube)
    daily = P.daily_sums(cube, pair_map)
    series = P.pair_series(P.asked_series(daily, pair_map), pair_map)
    assert rows(series) == sorted(
        [
            ("wheat", None, "all", day(0), 30.0), ("wheat", None, "all", day(5), 40.0),
            ("Wheat", "indore", "located", day(0), 20.0),
            ("Onion", "Punjab", "all", day(1), None), ("Onion", "Punjab", "all", day(2), 7.0),
            ("Rice", "punjab", "located", day(3), 8.0), ("Rice", None, "all", day(3), 8.0),
            ("Wheat Durum", "MP", "located", day(0), 30.0),
        ],
        key=repr,
    )
    headlines = P.pair_headlines(daily, pair_map)
    assert rows(headlines) == sorted(
        [
            ("wheat", None, "Wheat", None, "MP", 32.5), ("wheat", None, "Wheat Durum", None, "MP", 30.0),
            ("Wheat", "indore", "Wheat", "Indore", "MP", 15.0),
            ("Wheat", "indore", "Wheat Durum", "Indore", "MP", 30.0),
            ("Rice", "punjab", "Rice", None, "Punjab", 8.0), ("Rice", None, "Rice", None, "Punjab", 8.0),
            ("Wheat Durum", "MP", "Wheat Durum", "Indore", "MP", 30.0),
        ],
        key=repr,
    )


@pytest.mark.parametrize("names", [0, 200])
def test_asked_pairs_folded_or_joined(spark, prices, monkeypatch, names):
    """Few names are a projection and many a join; both give the same lines, and members that fit are broadcast."""
    asked = spark.createDataFrame([*ASKED, ("%e%", "m%p"), ("w\\", "MP"), (None, "MP")], "term string, loc string")
    monkeypatch.setattr(P, "MAX_FOLDED_NAMES", names)
    pair_map = P.resolve_pairs(asked, prices)
    lines = rows(pair_map.lines.drop("line"))
    assert ("%e%", "m%p", "Wheat", "Bhopal", "MP") in lines and ("%e%", None, "Rice", None, "Punjab") in lines
    monkeypatch.setattr(P, "MAX_FOLDED_NAMES", 200 - names)
    other = P.resolve_pairs(asked, prices)
    assert rows(other.lines.drop("line")) == lines and rows(other.scopes) == rows(pair_map.scopes)
    plans = []
    for small in (True, False):
        daily = P.daily_sums(prices, dataclasses.replace(pair_map, members_small=small))
        plans.append((rows(daily), daily._jdf.queryExecution().executedPlan().toString()))
    assert plans[0][0] == plans[1][0] and "BroadcastHashJoin" in plans[0][1]


def test_members_grow_with_asked_places_only(spark, monkeypatch):
    """Many markets of one state are one place, and facts without a catalogue are stored once."""
    facts = [(day(n % 3), f"Wheat {n % 2}", f"m{n:03}", "MP" if n % 4 else "UP", float(n)) for n in range(200)]
    prices = spark.createDataFrame(facts, "date date, commodity string, market string, state string, modal_price double")
    asked = spark.createDataFrame([("wheat", None), ("wheat", "mp"), ("1", "m00")], "term string, loc string")
    pair_map = P.resolve_pairs(asked, prices)
    assert pair_map.members.count() <= 20
    folded = rows(P.price_records(prices, asked))
    staged, original = [], P.stage
    monkeypatch.setattr(P, "stage", lambda df, name: staged.append(name) or original(df, name))
    monkeypatch.setattr(P, "MAX_FOLDED_NAMES", 0)
    assert rows(P.price_records(prices, asked)) == folded
    assert staged.count("facts") == 1


def test_facts_are_read_once_and_pruned(spark, prices, monkeypatch):
    """One plan reads the stored facts: of asked commodities, without unused columns, and shuffled as daily sums only."""
    table = new_folder(spark, "prices")
    columns = [F.lit(None).cast("double").alias(c) for c in ("min_price", "max_price")]
    version = L.write_prices(prices.select("*", *columns), table)
    staged, original = [], P.stage
    monkeypatch.setattr(P, "stage", lambda df, name: staged.append((name, df)) or original(df, name))
    asked = spark.createDataFrame([("wheat", None), ("Onion", "pune")], "term string, loc string")
    stored = L.open_prices(spark, table, version=version)
    found = P.price_records(stored, asked, dims=L.open_catalogue(spark, table, version))
    assert rows(found) == rows(P.price_records(prices, asked))
    facts = version.folders(L.FACTS)[0]
    reading = [(name, df) for name, df in staged if any(facts in file for file in df.inputFiles())]
    assert [name for name, _ in reading] == ["daily"]
    plan = reading[0][1]._jdf.queryExecution().executedPlan().toString()
    assert "min_price" not in plan
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "hashpartitioning(line" in shuffles[0]
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)[1]
    assert "commodity" in filters and "Onion" in filters and "Rice" not in filters


@pytest.mark.parametrize("limit", [0, 1000])
def test_terms_become_lists_of_dimension_values(spark, prices, monkeypatch, limit):
    monkeypatch.setattr(S, "MAX_LISTED_VALUES", limit)
    dims = L.catalogue(prices)
    for commodity, location in [("wheat", None), (None, "m%p"), ("e", "PUNJAB"), ("none", "none"), ("", "i")]:
        found = S.filter_prices(prices, commodity, location, goods=dims, places=dims)
        assert rows(found) == rows(S.filter_prices(prices, commodity, location))
    table = new_folder(spark, "prices")
    prices.write.parquet(table)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = S.filter_prices(spark.read.parquet(table), "wheat", "m%p", dims, dims)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    assert ("In(commodity" in pushed and "market" in pushed) == (limit > 0)


def test_records(spark, prices):
    asked = spark.createDataFrame(ASKED, "term string, loc string")
    records = {(r["term"], r["loc"]): r for r in P.price_records(prices, asked).collect()}
    assert len(records) == 7
    tomato = records["Tomato", None]
    assert tomato["n_rows"] == 0 and tomato["latest_price"] is None
    assert tomato["result"] == "[]" and tomato["columns"] == []
    onion = records["Onion", "Punjab"]
    assert (onion["n_rows"], onion["stats_scope"], onion["latest_price"]) == (0, "all", 7.0)
    assert onion["explanation"] == "Query executed for commodity='Onion', location='Punjab'."
    wheat = records["wheat", None]
    assert (wheat["n_rows"], wheat["commodity"], wheat["percent_change"]) == (2, None, 33.33)
    assert wheat["explanation"].endswith("across available regions.")
    text = render.price_answer_text(
        F.col("n_rows"), F.col("modal_price"), F.col("forecast_14d"), F.col("trend_direction")
    )
    shown = {
        (r["term"], r["loc"]): r["t"]
        for r in P.price_records(prices, asked).select("term", "loc", text.alias("t")).collect()
    }
    assert shown["Rice", None] == "Average modal price: **₹8.00** per quintal."
    assert shown["wheat", None] == lexicon.NO_DATA_TEXT


def test_averages(spark, prices):
    assert rows(S.average_by_commodity(prices)) == sorted(
        [("Wheat", "MP", 32.5), ("Wheat Durum", "MP", 30.0), ("Onion", "Maharashtra", 7.0),
         ("Rice", "Punjab", 8.0)],
        key=repr,
    )
    located = S.average_by_commodity(prices, "m%p", "WHEAT")
    assert rows(located) == sorted(
        [("Wheat Durum", "Indore", "MP", 30.0), ("Wheat", "Bhopal", "MP", 32.5)], key=repr
    )


def test_answer_text_variants(spark):
    def text(n, average, forecast, trend, error=None):
        column = render.price_answer_text(
            F.lit(n), F.lit(average).cast("double"), F.lit(forecast).cast("double"),
            F.lit(trend).cast("string"), F.lit(error).cast("string"),
        )
        return spark.range(1).select(column).first()[0]

    assert text(1, 1234.5, 1300.0, "upward") == (
        "Average modal price: **₹1,234.50** per quintal.\n\n🔮 **14-Day Trend Forecast:** "
        "₹1300.0/quintal (upward trajectory)."
    )
    assert text(1, 5.0, 0.0, "stable") == "Average modal price: **₹5.00** per quintal."
    assert text(1, 5.0, None, None) == "Average modal price: **₹5.00** per quintal."
    assert text(0, None, None, None) == text(2, None, 3.0, "stable") == lexicon.NO_DATA_TEXT
    assert text(1, 5.0, None, None, "boom") == "⚠️ Query error: boom"


def test_chat_text_variants(spark):
    def text(n, values, language, error=None):
        columns = {c: F.lit(v).cast("string") for c, v in values.items()}
        column = render.chat_answer_text(
            F.lit(n), columns, F.lit(language), F.lit(error).cast("string")
        )
        return spark.range(1).select(column).first()[0]

    row = {"commodity": "Rice", "market": None, "state": "Punjab", "modal_price": "8.0"}
    assert text(1, row, "en") == "**commodity**: Rice | **state**: Punjab | **modal_price**: 8.0"
    assert text(1, {"modal_price": "8.0"}, "en") is None
    assert text(4, row, "en") == "Found **4 data points**. See the chart and data below."
    assert text(4, row, "hi") == "**4 डेटा पॉइंट** मिले। नीचे चार्ट और डेटा देखें।"
    assert text(0, row, "hi") == lexicon.NO_DATA_TEXT_HI
    assert text(1, row, "hi", "boom") == "⚠️ क्वेरी में त्रुटि: boom"


def test_result_json_writes_nulls(spark):
    headlines = spark.createDataFrame(
        [("t", "x", "b", "m", None, None), ("t", "x", "a", None, "s", 2.5), ("t", None, "a", None, "s", 1.0)],
        "term string, loc string, commodity string, market string, state string, modal_price double",
    )
    found = {row["loc"]: row for row in P.headline_summary(headlines).collect()}
    assert found["x"]["result"] == (
        '[{"commodity":"a","market":null,"state":"s","modal_price":2.5},'
        '{"commodity":"b","market":"m","state":null,"modal_price":null}]'
    )
    assert found["x"]["columns"] == ["commodity", "market", "state", "modal_price"]
    assert found["x"]["n_rows"] == 2 and found["x"]["state"] is None
    assert found[None]["result"] == '[{"commodity":"a","state":"s","modal_price":1.0}]'
    assert found[None]["columns"] == ["commodity", "state", "modal_price"]
