"""Readers and exports, there and back."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bars, sinks

DAY = datetime.date


def put(path, text):
    path.write_text(text)
    return str(path)


def test_bars_from_a_json_array(spark, tmp_path):
    rows = [{"timestamp": f"2024-01-0{i}", "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 10.0 * i} for i in (1, 2)]
    got = bars.read_bars_json(spark, put(tmp_path / "a.json", json.dumps(rows)), "S").orderBy("date").collect()
    assert [(r["symbol"], r["date"], r["volume"]) for r in got] == [("S", DAY(2024, 1, 1), 10.0), ("S", DAY(2024, 1, 2), 20.0)]
    with pytest.raises(Exception):  # noqa: B017
        bars.read_bars_json(spark, put(tmp_path / "b.json", json.dumps([{"timestamp": "2024-01-01", "open": "x"}])), "S").collect()
    with pytest.raises(ValueError, match="high_below_low: 1"):
        bars.checked(spark.createDataFrame([("S", DAY(2024, 1, 1), 1.0, 1.0, 2.0, 1.0, 1.0)], "symbol string, date date, open double, high double, low double, close double, volume double"))


def test_day_values_and_rows(spark, tmp_path):
    values = bars.read_day_values(spark, put(tmp_path / "v.json", json.dumps({"2024-01-01": 1.5, "2024-01-02": "x", "no date": 3, "2024-01-03": None})))
    assert values.collect() == [(DAY(2024, 1, 1), 1.5)]
    rows = bars.read_day_rows(spark, put(tmp_path / "r.json", json.dumps([["date", "a", "b"], ["2024-01-01", 1, 2], ["2024-01-02", "x", 2]])))
    assert [(r["date"], r["counts"]) for r in rows.collect()] == [(DAY(2024, 1, 1), [1.0, 2.0])]


def test_features_are_read_strictly(spark, tmp_path):
    good = bars.read_features(spark, put(tmp_path / "g.csv", "date,a,b\n2024-01-01,1.5,\n2024-01-02,x,2\n"))
    assert good.dtypes == [("date", "date"), ("a", "double"), ("b", "double")]
    assert good.orderBy("date").collect() == [(DAY(2024, 1, 1), 1.5, None), (DAY(2024, 1, 2), None, 2.0)]
    for name, text in (("d", "date,a\n2024-13-01,1\n"), ("r", "date,a\n2024-01-01,1\n2024-01-01,2\n")):
        with pytest.raises(Exception, match="date"):
            bars.read_features(spark, put(tmp_path / f"{name}.csv", text)).collect()
    with pytest.raises(ValueError, match="lacks"):
        bars.read_features(spark, str(tmp_path / "g.csv"), ["a", "z"])


@pytest.mark.parametrize("kind", ["csv", "parquet", "jsonl"])
def test_rows_there_and_back(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "name string, value double")
    sinks.write_rows(df, str(tmp_path / "out"), kind)
    assert sorted(bars.read_rows(spark, str(tmp_path / "out"), kind).select("name", "value").collect()) == [("a", 1.5), ("b", 2.5)]
    with pytest.raises(ValueError):
        sinks.write_rows(df, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError):
        bars.read_rows(spark, str(tmp_path / "out"), "xml")


def test_exports(spark):
    days = [(DAY(2024, 1, 2), 1.123456789, "S"), (DAY(2024, 1, 1), None, "S")]
    df = spark.createDataFrame(days, "date date, x double, symbol string")
    first = sinks.date_first(df, ["x", "date"], required="x")
    assert first.columns == ["date", "x"] and first.collect() == [("2024-01-02", 1.12345679)]
    assert json.loads(sinks.json_matrix(df.select("date", F.coalesce("x", F.lit(0.0)).alias("x")), ["x"])) == [["date", "x"], ["2024-01-01", 0.0], ["2024-01-02", 1.123456789]]
    payload = json.loads(sinks.chart_payload(df, ["x"]).first()["json"])
    assert payload == {"dates": ["2024-01-01", "2024-01-02"], "series": {"x": [None, 1.12345679]}}
    groups = sinks.column_groups(["buy_score", "buy_zone_5pct", "phase", "r1", "close"])
    assert groups == {"scores": ["buy_score"], "labels": ["buy_zone_5pct"], "components": ["phase"], "diagnostics": ["r1"]}
    price = spark.createDataFrame([("S", DAY(2024, 1, 1), 1.0, 2.0), ("S", DAY(2024, 1, 2), 3.0, 2.0)], "symbol string, date date, open double, close double").withColumn("volume", F.lit(1.0))
    joined = {r["date"]: r["x"] for r in sinks.dashboard(price, df).collect()}
    assert joined == {DAY(2024, 1, 1): None, DAY(2024, 1, 2): 1.123456789}
    assert [r["up"] for r in sinks.up_days(price).orderBy("date").collect()] == [1, 0]


def test_stored_features_follow_their_input(spark, tmp_path):
    """An input replaced within a session, and a cleared checkpoint folder, give new results."""
    import shutil

    from tidemark.plans import catalog
    from tidemark.sources import storage

    source = str(tmp_path / "sf")
    (tmp_path / "sf").mkdir()
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.write.parquet(f"{source}/orders.parquet")
    before = catalog.QUERIES["market_states"](spark, source).count()
    assert before == catalog.QUERIES["daily_bars"](spark, source).count() > 0
    first = dict(storage._STORED)
    assert catalog.QUERIES["market_states"](spark, source).count() == before and storage._STORED == first
    for _, path in first.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    assert catalog.QUERIES["market_states"](spark, source).count() == before and storage._STORED != first
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderpriority < '3'").write.mode("overwrite").parquet(f"{source}/orders.parquet")
    fewer = catalog.QUERIES["market_states"](spark, source).count()
    assert 0 < fewer == catalog.QUERIES["daily_bars"](spark, source).count() < before
