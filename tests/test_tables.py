"""Versioned tables and the daily state."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from harvestline.operators import series as S
from harvestline.session import new_folder
from harvestline.sources import daily_state as M
from harvestline.sources import documents as D
from harvestline.sources import prices as L
from harvestline.sources import versions

PRICES = "date date, commodity string, market string, state string, modal_price double"


def facts(spark, *triples):
    made = [(dt.date(2024, 1, d), c, "m", "s", p) for d, c, p in triples]
    return spark.createDataFrame(made, PRICES)


def opened(spark, path, version=None):
    return rows(L.open_prices(spark, path, version=version), "commodity", "modal_price")


def test_a_load_that_dies_leaves_the_old_table(spark):
    path = new_folder(spark, "prices")
    assert versions.newest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        L.open_prices(spark, path)
    L.write_prices(facts(spark, (1, "a", 1.0)), path)
    bad = facts(spark, (1, "b", 2.0), (2, "c", 3.0))
    dying = bad.withColumn("modal_price", F.when(F.col("commodity") == "c", F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="lost"):
        L.write_prices(dying, path)
    assert opened(spark, path) == [("a", 1.0)]
    assert rows(L.open_catalogue(spark, path)) == [("a", "m", "s")]


def test_readers_keep_the_version_they_pinned(spark):
    path = new_folder(spark, "prices")
    first = L.write_prices(facts(spark, (1, "a", 1.0)), path)
    before = L.open_prices(spark, path)
    second = L.write_prices(facts(spark, (1, "b", 2.0)), path)
    assert (first.number, second.number) == (0, 1)
    assert rows(before, "commodity") == [("a",)] and opened(spark, path) == [("b", 2.0)]
    assert opened(spark, path, versions.pinned(spark, path, 0)) == [("a", 1.0)]
    with pytest.raises(FileNotFoundError, match="version 7"):
        versions.pinned(spark, path, 7)


def test_two_writers_of_one_number_are_not_mixed(spark, monkeypatch):
    path = new_folder(spark, "table")
    versions.replace(spark.range(1), path, "rows")
    last = versions.newest(spark, path)
    names = [versions.new_data(path)[0] for _ in range(2)]
    monkeypatch.setattr(versions, "newest", lambda *_: last)
    for name in names:
        versions.publish(spark, path, {"x": name, "y": name})
    monkeypatch.undo()
    found = versions.newest(spark, path)
    assert found.number == 1 and len(set(found.parts.values())) == 1
    assert versions.pinned(spark, path, 1) == found


def test_an_index_is_replaced_as_a_whole(spark):
    path = new_folder(spark, "index")

    def chunks(*ids):
        return spark.createDataFrame([(i, "s", "t") for i in ids], "chunk_id string, scheme string, text string")

    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<float>")
    old = D.build_index(chunks("a"), vectors, path)
    D.build_index(chunks("b"), vectors, path)
    assert rows(old, "chunk_id") == [("a",)] and rows(D.open_index(spark, path), "chunk_id") == [("b",)]


def test_broken_lines_are_kept_beside_the_rest(spark, tmp_path):
    text = (
        "date,commodity,market,state,min_price,max_price,modal_price\n"
        "2024-01-01,a,m,s,1,2,3\n2024-01-02,b,m\n2024-13-01,c,m,s,1,2,3\n2024-01-03,d,m,s,1,2,3,4,5\n"
        "2024-01-04,e,\"m, x\",s,x,,7\n,f,m,s,1,2,3\n"
    )
    (tmp_path / "p.csv").write_text(text)
    path = new_folder(spark, "prices")
    version = L.load_checked(spark, str(tmp_path), path)
    found = rows(L.open_prices(spark, path, version=version), "commodity", "market", "min_price", "modal_price")
    assert found == [("a", "m", 1.0, 3.0), ("e", "m, x", None, 7.0), ("f", "m", 1.0, 3.0)]
    errors = rows(L.open_errors(spark, path))
    assert [e for e, _ in errors] == ["bad date", "broken line", "broken line"]
    assert errors[1][1] == "2024-01-02,b,m" and errors[2][1] == "2024-01-03,d,m,s,1,2,3,4,5"
    assert '"date":"2024-13-01"' in errors[0][1] and '"commodity":"c"' in errors[0][1]


# --- daily state ------------------------------------------------------------


def random_facts(spark, n=400):
    rng = random.Random(4)
    made = []
    for _ in range(n):
        day = dt.date(2023, 11, 1) + dt.timedelta(days=rng.choice([0, 1, 5, 31, 32, 60, 200]))
        made.append((None if rng.random() < 0.02 else day, rng.choice(["a", "b", None]), "m", rng.choice("xy"),
                     None if rng.random() < 0.1 else round(rng.uniform(0, 9), 2)))
    made += [(dt.date(2024, 1, 1), "one", "m", "x", 5.0), (None, "undated", "m", "x", 5.0), (dt.date(2024, 1, 1), "null", "m", "x", None)]
    made += [(dt.date(2024, 1, d), "zero", "m", "x", float(d - 1)) for d in (1, 2, 3)]
    return spark.createDataFrame(made, PRICES)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-8 * max(1.0, abs(a))
    return a == b


def test_moments_give_the_statistics_of_all_facts(spark):
    keys = ["commodity", "state"]
    prices = random_facts(spark)
    path = new_folder(spark, "state")
    M.add_prices(prices.where("modal_price < 3 or modal_price is null"), path, keys)
    M.add_prices(prices.where("modal_price >= 3 and date < '2024-01-01'"), path, keys)
    M.add_prices(prices.where("modal_price >= 3 and (date >= '2024-01-01' or date is null)"), path, keys)
    expected = S.price_stats(S.daily_average(prices, keys), keys)
    found = M.series_stats(M.open_moments(spark, path), keys)
    assert sorted(found.columns) == sorted(expected.columns)
    ours, theirs = rows(found, *expected.columns[:2]), rows(expected, *expected.columns[:2])
    assert ours == theirs
    by_key = {tuple(r[k] for k in keys): r for r in found.collect()}
    for row in expected.collect():
        for column in expected.columns:
            assert close(by_key[tuple(row[k] for k in keys)][column], row[column]), (row, column)
    daily = rows(M.open_daily(spark, path), "commodity", "state", "date", "price_n")
    assert daily == rows(M.daily_sums(prices, keys), "commodity", "state", "date", "price_n")


def test_a_new_day_rewrites_its_month_only(spark, monkeypatch):
    path = new_folder(spark, "state")
    old = random_facts(spark).where("date is not null")
    first = M.add_prices(old, path, ["commodity"])
    read = []
    original = M._read
    monkeypatch.setattr(M, "_read", lambda spark, version, data, parts=None: read.append(parts) or original(spark, version, data, parts))
    new = spark.createDataFrame([(dt.date(2024, 1, 30), "a", "m", "x", 3.0)], PRICES)
    second = M.add_prices(new, path, ["commodity"])
    assert read == [["2024-01"]]
    assert {p for p in second.parts if second.parts[p] != first.parts.get(p)} == {"2024-01"}
    assert rows(M.open_daily(spark, path, first), "price_n") == rows(M.daily_sums(old, ["commodity"]), "price_n")
    whole = S.price_stats(S.daily_average(old.unionByName(new), ["commodity"]), ["commodity"])
    found = M.series_stats(M.open_moments(spark, path), ["commodity"])
    for a, b in zip(rows(found, "commodity", "slope", "latest_price"), rows(whole, "commodity", "slope", "latest_price")):
        assert all(map(close, a, b))
    assert M.add_prices(new.where("false"), path, ["commodity"]) == second
    third = M.add_prices(spark.createDataFrame([(dt.date(2025, 3, 1), "a", "m", "x", 3.0)], PRICES), path, ["commodity"])
    assert read == [["2024-01"]] + [None] * (len(read) - 1) and "2025-03" in third.parts


def test_a_hot_key_is_summed_before_the_shuffle(spark):
    plan = M.daily_sums(facts(spark, (1, "a", 1.0)), ["commodity"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning(commodity")
