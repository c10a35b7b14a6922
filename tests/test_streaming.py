"""A stream gives what a table gives, whatever the order, repeats and crashes it comes with."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, swings
from tidemark.streaming import events as ev
from tidemark.streaming import live, sinks


def test_window_bars_of_a_stream(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    table.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = ev.window_bars(ev.read_events(spark, str(tmp_path / "in"), table.schema), "1 day")
    query = stream.writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r["symbol"], r["start"])
    want = ev.window_bars(table.withColumn("ts", table["ts"].cast("timestamp")), "1 day").collect()
    assert sorted(spark.table("bars").collect(), key=key) == sorted(want, key=key)


def day(i):
    return datetime.date(2022, 1, 1) + datetime.timedelta(days=i)


def replay(spark, folder, batches, schema, build):
    """Rows of the stream ``build`` over batches, one file each, the query restarted between them."""
    got = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = build(spark.readStream.schema(schema).parquet(str(folder / "in")))
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(folder / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None, i
    return got


def shuffled(rows, late, pieces, seed=0):
    """``rows`` in pieces, none coming more than ``late`` days after a later one; some twice."""
    rng = np.random.default_rng(seed)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] - datetime.date(2022, 1, 1)).days + rng.uniform(0, late))
    cut = [order[len(order) * k // pieces : len(order) * (k + 1) // pieces] for k in range(pieces)]
    return [[rows[i] for i in part + part[:5]] for part in cut]


def test_swings_of_shuffled_bars_equal_the_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    bars = []
    for s in "ab":
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 90)))
        bars += [(s, day(i), float(c * 1.01), float(c * 0.99), float(c), 0.03) for i, c in enumerate(close)]
    schema = "symbol string, date date, high double, low double, close double, atr_pct double"
    flush = [("~", day(400), 1.0, 1.0, 1.0, 0.03)]
    got = replay(spark, tmp_path, [*shuffled(bars, 5, 3), flush], schema, lambda s: live.online_swings(s, late="6 days"))
    want = swings.zigzag(spark.createDataFrame(bars, schema)).collect()
    assert len(got) == 180 and len({(r["symbol"], r["date"]) for r in got}) == 180
    assert sum(r["confirmed"] for r in got) == len(want) > 6
    assert {(r["symbol"], r["pivot_date"]) for r in got if r["confirmed"]} == {(r["symbol"], r["end_date"]) for r in want}
    for s in "ab":  # in order within each series
        dates = [r["date"] for r in got if r["symbol"] == s]
        assert dates == sorted(dates)


def test_regimes_and_means_of_shuffled_rows_equal_the_table(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 6))
    pack = models.fit_hmm(rng.normal(size=(200, 6)))
    rows = [("s", day(i), *map(float, v)) for i, v in enumerate(x)]
    schema = "symbol string, date date, " + ", ".join(f"{n} double" for n in models.HMM_INPUTS)
    flush = [("~", day(400), *[0.0] * 6)]
    found = replay(spark, tmp_path / "hmm", [*shuffled(rows, 4, 2), flush], schema, lambda s: live.online_regimes(s, pack, "5 days"))
    p = np.array([r["p"] for r in sorted(found, key=lambda r: r["date"])])
    assert p == pytest.approx(models.apply_hmm(pack, x))
    values = [("s", day(i), None if i % 9 == 4 else float(v)) for i, v in enumerate(x[:, 0])]
    found = replay(spark, tmp_path / "mean", [*shuffled(values, 4, 2), [("~", day(400), 1.0)]], "symbol string, date date, value double", lambda s: live.online_ewma(s, 10, "5 days"))
    last = max(found, key=lambda r: r["date"])
    known = pd.Series([v for *_, v in values if v is not None])
    assert last["n"] == len(known) and last["ewma"] == pytest.approx(known.ewm(span=10, adjust=False).mean().iloc[-1])


def test_idle_series_are_forgotten(spark, tmp_path):
    rows = [("s", day(0), 1.0), ("s", day(1), 3.0)]
    batches = [rows, [("~", day(50), 1.0)], [("~", day(120), 1.0)], [("s", day(130), 7.0), ("~", day(300), 1.0)], [("~", day(400), 1.0)]]
    schema = "symbol string, date date, value double"
    kept = replay(spark, tmp_path / "kept", batches, schema, lambda s: live.online_ewma(s, 3, "2 days"))
    gone = replay(spark, tmp_path / "gone", batches, schema, lambda s: live.online_ewma(s, 3, "2 days", idle_days=20))
    assert {(r["date"], r["n"]) for r in kept if r["symbol"] == "s"} == {(day(0), 1), (day(1), 2), (day(130), 3)}
    assert {(r["date"], r["n"]) for r in gone if r["symbol"] == "s"} == {(day(0), 1), (day(1), 2), (day(130), 1)}


def summed(rows):
    return rows.groupBy("day", "kind").agg(F.sum("amount").alias("amount"))


SCHEMA = "day date, kind string, amount long"


def stored(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("day", "kind", "amount").collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "days")
    put = sinks.upsert_days(path, ["kind"], merge=summed)
    first = spark.createDataFrame([(day(0), "a", 1), (day(0), "a", 2), (day(1), "b", 5)], SCHEMA)
    second = spark.createDataFrame([(day(1), "b", 10), (day(2), "c", 7)], SCHEMA)
    put(first, 0)
    put(second, 1)
    want = [(day(0), "a", 3), (day(1), "b", 15), (day(2), "c", 7)]
    assert stored(spark, path) == want
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "days").rglob(f"day={day(0)}/*.parquet")}
    put(second, 1)
    put(first, 0)
    assert stored(spark, path) == want and untouched == {p: p.stat().st_mtime_ns for p in (tmp_path / "days").rglob(f"day={day(0)}/*.parquet")}
    put(spark.createDataFrame([], SCHEMA), 2)
    assert stored(spark, path) == want
    # a crash that left one of a batch's days behind: only the other is taken again
    third = spark.createDataFrame([(day(0), "a", 100), (day(2), "c", 100)], SCHEMA)
    put(third.where(F.col("day") == F.lit(day(0))), 3)
    put(third, 3)
    assert stored(spark, path) == [(day(0), "a", 103), (day(1), "b", 15), (day(2), "c", 107)]


def test_newer_rows_replace_older_ones(spark, tmp_path):
    path = str(tmp_path / "days")
    put = sinks.upsert_days(path, ["kind"])
    put(spark.createDataFrame([(day(0), "a", 1), (day(0), "b", 2)], SCHEMA), 0)
    put(spark.createDataFrame([(day(0), "b", 9), (day(0), "b", 8), (day(1), "a", 4)], SCHEMA), 1)
    assert stored(spark, path) == [(day(0), "a", 1), (day(0), "b", 9), (day(1), "a", 4)]


def test_a_killed_ingestion_resumes_without_loss_or_doubling(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "days", "c"))
    rows = [(day(int(d)), str(k), int(a)) for d, k, a in zip(rng.integers(5, size=200), rng.choice(list("abc"), 200), rng.integers(1, 100, 200))]
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    real, calls = sinks.upsert_days, []

    def dying(*args, **kw):
        put = real(*args, **kw)

        def crash(batch, number):
            put(batch, number)
            calls.append(number)
            if len(calls) == 2:  # after the table is written, before the batch is recorded
                raise RuntimeError("killed")

        return crash

    monkeypatch.setattr(sinks, "upsert_days", dying)
    with pytest.raises(Exception, match="killed"):
        sinks.ingest_files(spark, source, SCHEMA, path, checkpoint, ["kind"], merge=summed, files_at_once=1)
    assert sinks.ingest_files(spark, source, SCHEMA, path, checkpoint, ["kind"], merge=summed, files_at_once=1) == 3
    assert calls == [0, 1, 1, 2, 3]
    assert stored(spark, path) == sorted(tuple(r) for r in summed(spark.createDataFrame(rows, SCHEMA)).collect())
    assert sinks.ingest_files(spark, source, SCHEMA, path, checkpoint, ["kind"], merge=summed) == 0
