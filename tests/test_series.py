"""Closed-form series, and queries against their SQL."""

import datetime as dt
import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candles, metrics, scores, similarity, swings, targets
from tidemark.operators import price_features as pf
from tidemark.plans import series_queries
from tidemark.sources import bars as src

SF = "/root/testdata/sf0.001"


def bars_of(spark, closes, opens=None, highs=None, lows=None, symbol="a"):
    day, rows = dt.date(2020, 1, 1), []
    for i, close in enumerate(closes):
        o = opens[i] if opens else (closes[i - 1] if i else close)
        h = highs[i] if highs else max(o, close)
        lo = lows[i] if lows else min(o, close)
        rows.append((symbol, day + dt.timedelta(days=i), float(o), float(h), float(lo), float(close), 1.0))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_steady_rise(spark):
    last = pf.features(bars_of(spark, [100 * 1.01**i for i in range(300)])).orderBy(F.desc("date")).first()
    assert last["ER_50"] == pytest.approx(1.0)
    assert last["band_pos"] == 1.0
    assert last["run_length_up"] == 299
    assert last["time_since_local_high"] == 0 and last["time_since_local_low"] == 49
    assert last["ewma_vol"] == pytest.approx(np.log(1.01))
    assert last["TS_20"] > 1e3  # the deviation is floored


def test_flat_prices(spark):
    rows = pf.price_features(bars_of(spark, [50.0] * 120)).orderBy("date").collect()
    assert rows[-1]["switch_rate_50"] == 0 and rows[-1]["run_length_up"] == 0
    assert rows[-1]["candle_range"] == pytest.approx(1e-8) and rows[0]["true_range"] == 0
    assert rows[98]["band_hi"] is None and rows[99]["band_hi"] == 50
    shape = candles.candle_classes(candles.candle_features(bars_of(spark, [50.0] * 8))).first()
    assert shape["shape_class"] == "doji-ish" and shape["direction_class"] == "flat"


def test_missing_columns_leave_their_families_null(spark):
    rows = pf.price_features(bars_of(spark, [float(i + 1) for i in range(120)]).select("symbol", "date", "close")).orderBy("date").collect()
    assert rows[-1]["atr"] is None and rows[-1]["volume_log1p"] is None and rows[-1]["band_pos"] == 1.0


def test_zigzag_alternates_and_leaves_the_open_leg(spark):
    wave = [100 + 20 * abs((i % 20) - 10) / 10 for i in range(200)]
    found = swings.zigzag(swings.with_atr(bars_of(spark, wave), 5), [1.0]).orderBy("start_date").collect()
    assert len(found) > 10
    assert all(a["direction"] != b["direction"] and a["end_date"] == b["start_date"] for a, b in zip(found, found[1:], strict=False))
    assert all((r["amplitude_pct"] > 0) == (r["direction"] == "up") for r in found)


def test_first_touch_of_both_barriers(spark):
    b = bars_of(spark, [100.0] * 6, opens=[100.0] * 6, highs=[100, 101, 103, 100, 100, 100], lows=[100, 99.5, 97, 100, 100, 100])
    rows = targets.targets(b).orderBy("date").collect()
    assert rows[0]["first_touch_2pct_3d"] == "both_same_bar" and rows[2]["first_touch_2pct_3d"] == "none"
    assert rows[3]["first_touch_2pct_3d"] is None


def test_pivot_day_belongs_to_the_earlier_swing(spark):
    day = lambda i: dt.date(2020, 1, i)
    sw = spark.createDataFrame([("a", day(1), day(5), "up", 0.1, 4), ("a", day(5), day(9), "down", -0.1, 4)], "symbol string, start_date date, end_date date, direction string, amplitude_pct double, duration_days int")
    days = spark.createDataFrame([("a", day(i)) for i in (1, 5, 6, 12)], "symbol string, date date")
    inside = {r["date"]: r["direction"] for r in swings.containing(days, sw).collect()}
    assert inside == {day(1): "up", day(5): "up", day(6): "down"}
    following = {r["date"]: r["next_start"] for r in swings.next_swing(days, sw).collect()}
    assert following == {day(1): day(5), day(5): None, day(6): None, day(12): None}


def test_invalid_bars_are_named(spark):
    b = bars_of(spark, [1.0, 2.0]).withColumn("high", F.lit(0.5))
    with pytest.raises(ValueError, match="high_below_low"):
        src.checked(b)


def test_metrics_of_a_perfect_score(spark):
    rows = spark.createDataFrame([("t", i / 10, int(i >= 5)) for i in range(10)], "split string, score double, label int")
    got = metrics.classification(rows, ["split"]).first()
    assert got["roc_auc"] == 1.0 and got["average_precision"] == 1.0 and got["f1"] == 1.0


def test_weighted_mean_of_known_parts(spark):
    row = spark.createDataFrame([(0.5, None, 1.0)], "buy_phase double, buy_analog double, buy_exhaustion double").select(scores.timing("buy").alias("t")).first()
    assert row["t"] == pytest.approx((0.5 * 0.45 + 0.25) / 0.70)


def test_unknown_metric(spark):
    w = spark.createDataFrame([("a", 1, dt.date(2020, 1, 1), dt.date(2020, 1, 2), [1.0])], "symbol string, start_row int, start_date date, end_date date, vector array<double>")
    with pytest.raises(ValueError, match="unknown metric"):
        similarity.similar_intervals(w, "a", 1, 1, "other")


QUICK = ["daily_bars", "price_trend", "price_path", "price_ewma_volatility", "chain_size_buckets", "forward_targets", "first_touch_targets", "candle_classes", "swing_detection", "swing_next", "zone_labels", "event_bars", "display_hashes", "volume_json"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans.catalog import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    relation = con.sql(ORACLE_SQL[name])
    order = [[d[0] for d in relation.description].index(n) for n in names]

    def plain(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)[:19] if isinstance(v, dt.datetime) else str(v)

    left = sorted(tuple(plain(r[n]) for n in names) for r in got.collect())
    right = sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    assert left == right


def test_running_sums_equal_frames_over_a_long_series(spark):
    """Slopes, means and deviations far from the start of a series, with a gap, a flat stretch and a bad close."""
    import numpy as np

    from tidemark.operators.price_features import price_features

    rng = np.random.default_rng(3)
    closes = [float(x) for x in np.exp(9 + np.cumsum(rng.normal(0, 0.02, 6000)))]
    closes[2000:2300] = [closes[2000]] * 300
    closes[1000], closes[1500] = None, 0.0
    closes[500] = float("inf")
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), x, float(rng.integers(0, 9000))) for i, x in enumerate(closes)]
    got = price_features(spark.createDataFrame(rows, "symbol string, date date, close double, volume double")).orderBy("date").toPandas()
    lc = np.array([np.log(x) if x and np.isfinite(x) else np.nan for x in closes])
    r1 = np.append(np.nan, np.diff(lc))
    v = np.log1p(np.array([r[3] for r in rows]))
    for n in (20, 200):
        for t in [n - 1, n, 499, 505, 1000 + n, 1000 + n + 1, 1400, 2150, 2299, 4000, 5999]:
            lw, rw = lc[t - n + 1 : t + 1], r1[t - n + 1 : t + 1]
            sd = max(rw.std(), 1e-8)
            for name, want in ((f"TS_{n}", rw.mean() / sd), (f"LR_{n}", np.polyfit(np.arange(n), lw, 1)[0] / sd if not np.isnan(lw).any() else np.nan)):
                found = got[name][t]
                assert (np.isnan(want) and np.isnan(found)) or found == pytest.approx(want, rel=1e-9, abs=1e-7), (name, t)
    for t in (728, 729, 5999):
        w = v[t - 729 : t + 1] if t >= 729 else np.array([np.nan])
        want = (v[t] - w.mean()) / w.std()
        assert (np.isnan(want) and np.isnan(got["volume_z"][t])) or got["volume_z"][t] == pytest.approx(want, rel=1e-9)


def test_first_of_repeated_outputs_in_order_of_files_and_rows(spark, tmp_path):
    """Spark reads the largest file first; the first row by file and place in it counts nevertheless, a missing amount never if there is another."""
    place = tmp_path / "lineitem.parquet"
    place.mkdir()
    later = pd.DataFrame({"l_orderkey": range(3000), "l_linenumber": 1, "l_extendedprice": 7.0})
    pd.DataFrame({"l_orderkey": [1, 1, 2, 2, 4], "l_linenumber": [1, 1, 1, 1, 1], "l_extendedprice": [5.0, 6.0, None, 8.0, None]}).astype({"l_linenumber": "int32"}).to_parquet(place / "part-0.parquet", row_group_size=1)
    pd.concat([later, later.assign(l_extendedprice=9.0)]).astype({"l_linenumber": "int32"}).to_parquet(place / "part-1.parquet", row_group_size=100)
    orders = pd.DataFrame({"o_orderkey": range(3000), "o_orderdate": pd.Timestamp("2020-01-01")})
    orders.to_parquet(tmp_path / "orders.parquet")
    got = {r["tx_hash"]: r["amount"] for r in series_queries.ledger(spark, str(tmp_path))[2].collect()}
    assert got == {k: {1: 5.0, 2: 8.0}.get(k, 7.0) for k in range(3000)}
