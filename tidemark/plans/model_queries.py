"""Model, simulation, export, hash and event queries; those that SQL can express have it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import columns as fc
from tidemark.operators import classifier, metrics, models, swings
from tidemark.plans import series_queries as sq
from tidemark.plans import signal_queries as sg
from tidemark.plans import sql_features as sf
from tidemark.plans.queries import query, rounded_doubles
from tidemark.sources import bars as src
from tidemark.sources import sinks
from tidemark.sources.storage import shared_dir, stored
from tidemark.streaming import events as ev
from tidemark.streaming import sinks as day_sinks

c = F.col
r = sf.r


@query()
def hmm_regimes(spark, sf_dir):
    """Filtered regime probabilities of a model fitted to each series."""
    return models.hmm_regimes(sq.feature_store(spark, sf_dir))


@query()
def hazard_probabilities(spark, sf_dir):
    """Calibrated probabilities of a large fall and of a large rise within ten rows."""
    rows = metrics.chronological_split(sq.feature_store(spark, sf_dir).na.drop(subset=list(models.HAZARD_INPUTS)))
    labels = models.hazard_labels(src.order_bars(spark, sf_dir), rows.where("split = 'train'"))
    data = stored(rows.join(labels, ["symbol", "date"]), "hazard")
    both = models.calibrated(models.calibrated(data, models.HAZARD_INPUTS, "correction", "P_CORRECTION_10D_CAL"), models.HAZARD_INPUTS, "rebound", "P_REBOUND_10D_CAL")
    return both.select("symbol", "date", "split", "correction", "P_CORRECTION_10D_CAL", "rebound", "P_REBOUND_10D_CAL")


@query()
def zone_model_metrics(spark, sf_dir):
    """Metrics by split of a balanced logistic model of the buy zone."""
    bars = src.order_bars(spark, sf_dir)
    zones = swings.zone_labels(bars, swings.zigzag(swings.with_atr(bars))).select("symbol", "date", c("buy_zone_5pct").alias("label"))
    rows = stored(metrics.chronological_split(sq.feature_store(spark, sf_dir).where(c("TS_50").isNotNull()).join(zones, ["symbol", "date"])), "zone")
    model, pack = models.fit_logistic(rows.where("split = 'train'"), models.HAZARD_INPUTS, "label")
    return metrics.classification(models.predict(model, pack, rows, "score"), ["split"])


@query()
def zone_model_coefficients(spark, sf_dir):
    bars = src.order_bars(spark, sf_dir)
    zones = swings.zone_labels(bars, swings.zigzag(swings.with_atr(bars))).select("symbol", "date", c("buy_zone_5pct").alias("label"))
    rows = stored(metrics.chronological_split(sq.feature_store(spark, sf_dir).where(c("TS_50").isNotNull()).join(zones, ["symbol", "date"])), "zone")
    model, pack = models.fit_logistic(rows.where("split = 'train'"), models.HAZARD_INPUTS, "label")
    return models.coefficients(model, pack, spark)


@query()
def ordinal_zone_score(spark, sf_dir):
    """Three-class model: outside, in the five, in the three percent zone; p2 + .55 p1."""
    from pyspark.ml.functions import vector_to_array

    bars = src.order_bars(spark, sf_dir)
    zones = swings.zone_labels(bars, swings.zigzag(swings.with_atr(bars))).select("symbol", "date", (c("buy_zone_5pct") + c("buy_zone_3pct")).alias("label"))
    rows = stored(metrics.chronological_split(sq.feature_store(spark, sf_dir).where(c("TS_50").isNotNull()).join(zones, ["symbol", "date"])), "ordinal")
    model, pack = models.fit_logistic(rows.where("split = 'train'"), models.HAZARD_INPUTS, "label", classes=3)
    p = vector_to_array("probability")
    return model.transform(models.scaled(rows, pack)).select("symbol", "date", "split", (p[2] + 0.55 * p[1]).alias("ordinal_score"))


@query()
def score_combiner(spark, sf_dir):
    """Buy score of a model over phase and exhaustion stand-ins, fitted before the test rows."""
    bars = src.order_bars(spark, sf_dir)
    zones = swings.zone_labels(bars, swings.zigzag(swings.with_atr(bars))).select("symbol", "date", c("buy_zone_5pct").alias("label"))
    scores = sq.feature_store(spark, sf_dir).select("symbol", "date", (1 - c("band_pos")).alias("phase"), (-c("dist_from_mean_vol_units")).alias("exhaustion"))
    rows = stored(metrics.chronological_split(scores.where(c("phase").isNotNull()).join(zones, ["symbol", "date"])), "combiner")
    return models.combined(rows, ["phase", "exhaustion"], "label", "score").select("symbol", "date", "split", "score")


@query(
    f"""WITH {sq.SQL_CONTEXT}, wx AS (SELECT symbol, r1 AS x, lag(P_SHOCK_HMM) OVER (PARTITION BY symbol ORDER BY date) AS w FROM ctx), k AS (SELECT symbol, x, coalesce(greatest(w, 0.0), 0.0) AS w FROM wx WHERE x IS NOT NULL AND w IS NOT NULL)
    SELECT symbol, {r("sum(w * x) / sum(w)", 8)} AS mean, {r("greatest(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) * (sum(w * x) / sum(w)), 0.0)", 8)} AS variance FROM k GROUP BY 1"""
)
def regime_return_moments(spark, sf_dir):
    """Return moments weighted by the previous row's shock probability."""
    rows = sq.context_frame(spark, sf_dir).select("symbol", c("r1").alias("x"), F.lag("P_SHOCK_HMM").over(fc.series()).alias("w")).where(c("x").isNotNull() & c("w").isNotNull())
    return rounded_doubles(metrics.weighted_moments(rows, ["symbol"]), 8)


@query(f"WITH {sf.BARS}, q AS (SELECT symbol, quantile_cont(close, 0.01) AS a, quantile_cont(close, 0.99) AS b FROM bars GROUP BY 1) SELECT symbol, date, {r('least(greatest(close, a), b)')} AS close FROM bars JOIN q USING (symbol)")
def winsorised_close(spark, sf_dir):
    return rounded_doubles(metrics.winsorised(src.order_bars(spark, sf_dir).select("symbol", "date", "close"), ["symbol"], "close", 0.01))


@query("WITH t AS (SELECT n_regionkey AS region, c_acctbal AS x, c_custkey % 7 + 1.0 AS w FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT region, x, sum(w) OVER (PARTITION BY region ORDER BY x RANGE UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY region) AS total FROM t) SELECT region, min(x) AS weighted_median FROM r WHERE run >= 0.5 * total GROUP BY 1")
def weighted_median_balance(spark, sf_dir):
    people = src.table(spark, sf_dir, "customer").join(F.broadcast(src.table(spark, sf_dir, "nation")), c("c_nationkey") == c("n_nationkey"))
    return metrics.weighted_median(people.select(c("n_regionkey").alias("region"), c("c_acctbal").alias("x"), (c("c_custkey") % 7 + 1.0).alias("w")), ["region"])


# ----------------------------------------------------------------- exports


@query(f"WITH {sf.BARS} SELECT symbol, CAST(sum(CASE WHEN close >= open THEN 1 ELSE 0 END) AS BIGINT) AS up_days, count(*) AS days FROM bars GROUP BY 1")
def volume_up_days(spark, sf_dir):
    return sinks.up_days(src.order_bars(spark, sf_dir)).groupBy("symbol").agg(F.sum("up").alias("up_days"), F.count(F.lit(1)).alias("days"))


@query(f"WITH {sf.BARS} SELECT symbol, date, CASE WHEN row_number() OVER w > 20 THEN {r('avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)')} END AS sma FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def chart_moving_average(spark, sf_dir):
    bars = src.order_bars(spark, sf_dir)
    mean = F.avg("close").over(fc.last_rows(20))
    return bars.select("symbol", "date", F.when(F.row_number().over(fc.series()) > 20, fc.rounded(mean)).alias("sma"))


@query("SELECT CAST(o_orderdate AS DATE) AS date, round(sum(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END * o_totalprice), 2) AS amount FROM orders GROUP BY 1")
def amount_upsert(spark, sf_dir):
    """A day's amounts added to those already there."""
    orders = src.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), c("o_totalprice").alias("amount"), "o_orderkey")
    both = sinks.upsert_amounts(orders.select("date", "amount"), orders.where("o_orderkey % 2 = 0").select("date", "amount"))
    return both.select("date", F.round("amount", 2).alias("amount"))


@query(f"WITH {sf.BARS} SELECT * FROM bars WHERE date >= DATE '1996-01-01' OR volume >= 1")
def refreshed_tail(spark, sf_dir):
    """Old bars up to the first new one, then the new ones."""
    bars = src.order_bars(spark, sf_dir)
    return src.append_tail(bars, bars.where(c("date") >= "1996-01-01"))


@query(
    f"""WITH {sf.features_cte()}, e AS (SELECT symbol, CASE WHEN day(date) = 9 THEN NULL ELSE date END AS date FROM store), g AS (SELECT symbol, date, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT 'columns' AS "check", false AS passed UNION ALL SELECT 'no_future_columns', false UNION ALL SELECT 'not_empty', count(*) > 0 FROM g UNION ALL SELECT 'dates_known', count(*) FILTER (WHERE date IS NULL) = 0 FROM g UNION ALL SELECT 'dates_unique', max(n) = 1 FROM g"""
)
def contract_checks(spark, sf_dir):
    """A feature table that breaks its contract: a column lacks, one knows the future, the dates of each ninth are lost."""
    rows = sq.feature_store(spark, sf_dir)
    spoilt = rows.select("symbol", F.when(F.dayofmonth("date") != 9, c("date")).alias("date"), "close", "TS_50", c("close").alias("ret_5d"))
    return sinks.contract(spoilt, ["symbol", "date", "close", "TS_50", "band_pos"])


_SPOILT = """sp AS (SELECT symbol, CASE WHEN day(date) = 2 THEN NULL ELSE date END AS date, CASE WHEN day(date) = 3 THEN -open ELSE open END AS open, CASE WHEN day(date) = 4 THEN low / 2 ELSE high END AS high, CASE WHEN day(date) = 5 THEN high * 2 ELSE low END AS low, CASE WHEN day(date) = 6 THEN NULL ELSE close END AS close, CASE WHEN day(date) = 7 THEN -1.0 ELSE volume END AS volume FROM bars),
sq AS (SELECT * FROM sp UNION ALL SELECT * FROM sp WHERE day(date) = 8), fl AS (SELECT *, count(*) OVER (PARTITION BY symbol, date) AS n FROM sq)"""
_RULES = {
    "price_not_positive_finite": "NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0, false)",
    "volume_not_finite": "NOT coalesce(volume >= 0, false)",
    "high_below_low": "NOT coalesce(high >= low, false)",
    "high_below_body": "NOT coalesce(high >= greatest(open, close), false)",
    "low_above_body": "NOT coalesce(low <= least(open, close), false)",
    "date_missing": "date IS NULL",
    "date_repeated": "n > 1",
}


@query(f"WITH {sf.BARS},{_SPOILT} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {v}) AS n, min(date) FILTER (WHERE {v}) AS first FROM fl" for k, v in _RULES.items()))
def bar_violations(spark, sf_dir):
    """Bars of which some days of each month were spoilt, against the rules of a valid series."""
    bars, day = src.order_bars(spark, sf_dir), F.dayofmonth("date")
    spoilt = bars.select(
        "symbol", F.when(day != 2, c("date")).alias("date"), F.when(day == 3, -c("open")).otherwise(c("open")).alias("open"), F.when(day == 4, c("low") / 2).otherwise(c("high")).alias("high"),
        F.when(day == 5, c("high") * 2).otherwise(c("low")).alias("low"), F.when(day != 6, c("close")).alias("close"), F.when(day == 7, -1.0).otherwise(c("volume").cast("double")).alias("volume"),
    )
    return src.violations(spoilt.unionByName(spoilt.where(F.dayofmonth("date") == 8)))


@query(f"WITH {sf.BARS} SELECT symbol, to_json(map_from_entries(list({{'k': CAST(date AS VARCHAR), 'v': volume}} ORDER BY date))) AS json FROM bars GROUP BY 1")
def volume_json(spark, sf_dir):
    return sinks.json_object(src.order_bars(spark, sf_dir), "date", "volume", ["symbol"])


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 20, '0') AS padded, upper(hex(c_name)) AS name_hex, CAST(CASE WHEN c_custkey < 253 THEN 1 WHEN c_custkey < 65536 THEN 3 ELSE 5 END AS INT) AS compact_length, CAST(ascii(substr(c_name, 1, 1)) + 256 * ascii(substr(c_name, 2, 1)) AS BIGINT) AS little_endian FROM customer")
def byte_functions(spark, sf_dir):
    name = F.encode("c_name", "UTF-8")
    return src.table(spark, sf_dir, "customer").select("c_custkey", fc.zero_padded(c("c_custkey")).alias("padded"), F.hex("c_name").alias("name_hex"), fc.compact_size_length(c("c_custkey")).alias("compact_length"), fc.little_endian(F.substring(name, 1, 2)).alias("little_endian"))


@query("SELECT c_custkey, array_to_string(list_reverse(regexp_extract_all(upper(sha256(unhex(sha256(c_name)))), '..')), '') AS hash FROM customer")
def display_hashes(spark, sf_dir):
    return src.table(spark, sf_dir, "customer").select("c_custkey", F.hex(fc.double_sha256_display(F.encode("c_name", "UTF-8"))).alias("hash"))


# ------------------------------------------------------------------ events


@query("SELECT event_type AS symbol, date_trunc('hour', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2")
def event_bars(spark, sf_dir):
    """Hourly bars of events by type; the same plan serves a stream."""
    rows = src.table(spark, sf_dir, "events").withColumn("ts", c("ts").cast("timestamp"))
    return ev.window_bars(rows)


@query(f"WITH RECURSIVE {sq.ZIGZAG},{sq.PRICED} SELECT symbol, start_date, end_date, direction, start_price, end_price FROM priced")
def swing_segments(spark, sf_dir):
    """Ends of each swing with their prices, for a chart overlay."""
    bars = src.order_bars(spark, sf_dir)
    return swings.pivot_prices(swings.zigzag(swings.with_atr(bars)), bars).select("symbol", "start_date", "end_date", "direction", "start_price", "end_price")


@query(f"WITH RECURSIVE {sg.DATASET} SELECT count(*) AS rows, count(TS_200) AS with_trend, count(ewma_vol) AS with_ewma, count(days_since_last_pivot) AS with_pivot, count(ONCHAIN_DOM_Z) AS with_chain FROM ds")
def dataset_coverage(spark, sf_dir):
    data = sg.dataset(spark, sf_dir)
    names = {"with_trend": "TS_200", "with_ewma": "ewma_vol", "with_pivot": "days_since_last_pivot", "with_chain": "ONCHAIN_DOM_Z"}
    return data.agg(F.count(F.lit(1)).alias("rows"), *[F.count(v).alias(k) for k, v in names.items()])


# ------------------------------------------------------------------ numbers and categories

_MIXED = ["TS_50", "ER_20", "band_pos", "relative_volume_20"]
_KINDS = ["state_hmm_label", "live_swing_direction"]


def mixed_rows(spark, sf_dir):
    """Rows with numbers and categories, split by time."""
    return metrics.chronological_split(sg.dataset(spark, sf_dir).where(c("r1").isNotNull()).select("symbol", "date", *_MIXED, *_KINDS))


_place = lambda n: f"CASE WHEN list_contains({n}_levels, coalesce({n}, {n}_common)) THEN list_position({n}_levels, coalesce({n}, {n}_common)) - 1 ELSE len({n}_levels) END"


@query(
    f"""WITH RECURSIVE {sg.DATASET}, base AS (SELECT symbol, date, {", ".join(_MIXED + _KINDS)}, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ds WHERE r1 IS NOT NULL),
    sp AS (SELECT *, CASE WHEN i <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN i <= floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM base),
    mids AS (SELECT {", ".join(f"median({x}) AS {x}_med" for x in _MIXED)} FROM sp WHERE split = 'train'),
    fil AS (SELECT {", ".join(f"avg(coalesce({x}, {x}_med)) AS {x}_mean, stddev_pop(coalesce({x}, {x}_med)) AS {x}_sd" for x in _MIXED)} FROM sp, mids WHERE split = 'train'),
    {", ".join(f"com_{n} AS (SELECT {n} AS {n}_common FROM sp WHERE split = 'train' AND {n} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), lev_{n} AS (SELECT list(DISTINCT coalesce({n}, {n}_common) ORDER BY coalesce({n}, {n}_common)) AS {n}_levels FROM sp, com_{n} WHERE split = 'train')" for n in _KINDS)}
    SELECT symbol, date, split, {", ".join(r(f"(coalesce({x}, {x}_med) - {x}_mean) / {x}_sd") + f" AS {x}" for x in _MIXED)}, {", ".join(f"CAST({_place(n)} AS INT) AS {n}_place" for n in _KINDS)}
    FROM sp, mids, fil, {", ".join(f"com_{n}, lev_{n}" for n in _KINDS)}"""
)
def reversal_inputs(spark, sf_dir):
    """What a classifier is given: filled and standardised numbers, and the places of categories, an unknown one behind the known."""
    from pyspark.ml import Pipeline

    rows = mixed_rows(spark, sf_dir)
    train = stored(rows.where("split = 'train'"), "mixed")
    done = Pipeline(stages=classifier.preparation(train, _MIXED, _KINDS)).fit(train).transform(rows)
    return rounded_doubles(done.select("symbol", "date", "split", *[c(f"_n_{n}").alias(n) for n in _MIXED], *[c(f"_i_{n}").cast("int").alias(f"{n}_place") for n in _KINDS]))


@query()
def reversal_classifier(spark, sf_dir):
    """Metrics by split of a balanced logistic model of the buy zone over numbers and categories, saved and loaded again."""
    bars = sq.bar_store(spark, sf_dir)
    zones = swings.zone_labels(bars, swings.zigzag(swings.with_atr(bars))).select("symbol", "date", c("buy_zone_5pct").alias("label"))
    rows = stored(mixed_rows(spark, sf_dir).join(zones, ["symbol", "date"]), "reversal")
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/reversal-model"
    classifier.save(classifier.fit_classifier(rows.where("split = 'train'"), [*_MIXED, *_KINDS], "label"), path)
    return metrics.classification(classifier.classify(classifier.load(path), rows), ["split"])


# ------------------------------------------------------------------ ingestion


@query("SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS kind, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount, count(*) AS orders FROM orders GROUP BY 1, 2")
def streamed_amounts(spark, sf_dir):
    """Cents and numbers of orders by day and status, taken from the order files as a stream into partitions of years; a second run of the same checkpoint finds nothing new."""
    folder = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    schema = src.table(spark, sf_dir, "orders").schema

    def prepare(stream):
        return stream.select(F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("year"), c("o_orderstatus").alias("kind"), F.round(c("o_totalprice") * 100).cast("long").alias("amount"), F.lit(1).cast("long").alias("orders"))

    def merge(rows):
        return rows.groupBy("day", "year", "kind").agg(F.sum("amount").alias("amount"), F.sum("orders").alias("orders"))

    for _ in range(2):
        day_sinks.ingest_files(spark, f"{sf_dir}/orders[.]parquet", schema, f"{folder}/years", f"{folder}/checkpoint", ["day", "kind"], "year", merge=merge, prepare=prepare)
    return spark.read.parquet(f"{folder}/years").select("day", "kind", "amount", "orders")
