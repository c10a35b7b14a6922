"""Queries of what a table must hold before a model sees it, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as fc
from tidemark.operators import metrics, selection, swings, targets
from tidemark.plans import series_queries as sq
from tidemark.plans import sql_features as sf
from tidemark.plans.queries import query, rounded_doubles
from tidemark.sources import bars as src

c = F.col
r = sf.r


@query(f"WITH {sf.BARS} SELECT symbol, count(*) AS n, min(date) AS first, max(date) AS last, string_agg(CAST(CAST(floor(close) AS BIGINT) AS VARCHAR), ',' ORDER BY date) AS closes FROM bars GROUP BY 1")
def column_series(spark, sf_dir):
    found = selection.column_series(src.order_bars(spark, sf_dir), ["close", "volume"])
    whole = F.transform("close", lambda x: F.floor(x).cast("bigint").cast("string"))
    return found.select("symbol", F.size("dates").cast("long").alias("n"), F.get("dates", F.lit(0)).alias("first"), F.element_at("dates", -1).alias("last"), F.array_join(whole, ",").alias("closes"))


@query(f"WITH {sf.BARS} SELECT symbol, date, unnest(['open', 'high', 'low', 'close']) AS name, unnest([open, high, low, close]) AS value FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-02-28'")
def printed_range(spark, sf_dir):
    return selection.date_range(src.order_bars(spark, sf_dir), "1995-01-01", "1995-02-28", ["open", "high", "low", "close"])


@query(f"WITH RECURSIVE {sq.ZIGZAG} SELECT symbol, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, direction, CASE WHEN isfinite(amplitude_pct) THEN {r('amplitude_pct')} END AS amplitude_pct, CAST(duration_days AS BIGINT) AS duration_days FROM sw")
def swing_overlay(spark, sf_dir):
    return rounded_doubles(swings.overlay(swings.zigzag(sq.ranged(spark, sf_dir))))


_USABLE = ("TS_200", "ER_50", "band_pos")


@query(f"WITH {sf.features_cte()} SELECT symbol, date, {', '.join(_USABLE)} FROM store WHERE {' OR '.join(f'{n} IS NOT NULL' for n in _USABLE)}")
def rows_with_any_feature(spark, sf_dir):
    return selection.with_any(sq.feature_store(spark, sf_dir), _USABLE).select("symbol", "date", *_USABLE)


@query(
    f"WITH {sf.features_cte()}, k AS (SELECT symbol, date, {' AND '.join(f'{n} IS NOT NULL' for n in _USABLE)} AS whole FROM store) SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE whole) AS usable, count(*) FILTER (WHERE NOT whole) AS dropped, min(date) FILTER (WHERE whole) AS first, max(date) FILTER (WHERE whole) AS last FROM k GROUP BY 1"
)
def usable_rows(spark, sf_dir):
    return selection.complete_rows(sq.feature_store(spark, sf_dir), _USABLE)


_SPLIT = "CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) <= floor(count(*) OVER (PARTITION BY symbol) * 0.7) THEN 'train' ELSE 'rest' END"


def _columns_frame(spark, sf_dir):
    """Train rows with columns of every sort: causal and leaking, varying, constant and empty, of text and truth."""
    rows = metrics.chronological_split(sq.context_frame(spark, sf_dir)).where("split = 'train'")
    extra = {"always": F.lit(1.0), "never": F.lit(None).cast("double"), "rising": c("r1") > 0, "next_close": c("close"), "buy_zone_5pct": F.lit(1), "regime": c("state_hmm_label")}
    return rows.withColumns(extra).select("date", "TS_20", "ER_20", *extra)


_VARYING = (("TS_20", "numeric"), ("ER_20", "numeric"), ("always", "numeric"), ("never", "numeric"), ("rising", "numeric"), ("regime", "categorical"))


@query(
    f"""WITH {sq.SQL_CONTEXT}, t AS (SELECT *, {_SPLIT} AS split, 1.0 AS always, CAST(NULL AS DOUBLE) AS never, r1 > 0 AS rising, state_hmm_label AS regime FROM ctx),
    k AS ({" UNION ALL ".join(f"SELECT '{n}' AS column, '{kind}' AS kind, count(DISTINCT {n}) AS values FROM t WHERE split = 'train'" for n, kind in _VARYING)}) SELECT * FROM k WHERE values > 1"""
)
def feature_columns(spark, sf_dir):
    rows = _columns_frame(spark, sf_dir)
    return selection.varying_columns(rows, rows.columns)


_REGIMES = ("CORE", "DRIFT", "SHOCK", "SURGE")


@query(
    f"""WITH {sq.SQL_CONTEXT}, t AS (SELECT symbol, date, state_hmm_label AS regime, {_SPLIT} AS split FROM ctx), m AS (SELECT regime FROM t WHERE split = 'train' AND regime IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, regime LIMIT 1),
    k AS (SELECT DISTINCT regime FROM t WHERE split = 'train' AND regime IS NOT NULL)
    SELECT symbol, date, {", ".join(f"CASE WHEN '{n}' IN (SELECT regime FROM k) THEN CASE WHEN coalesce(t.regime, (SELECT regime FROM m)) = '{n}' THEN 1.0 ELSE 0.0 END END AS is_{n.lower()}" for n in _REGIMES)} FROM t"""
)
def regime_one_hot(spark, sf_dir):
    rows = metrics.chronological_split(sq.context_frame(spark, sf_dir)).select("symbol", "date", "split", c("state_hmm_label").alias("regime"))
    found = selection.one_hot(rows, "regime", c("split") == "train")
    return found.select("symbol", "date", *[(c(f"`regime={n}`") if f"regime={n}" in found.columns else F.lit(None).cast("double")).alias(f"is_{n.lower()}") for n in _REGIMES])


@query(f"WITH {sf.BARS}, days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_linenumber = 1) SELECT symbol, date FROM bars ANTI JOIN days USING (date)")
def coverage_gaps(spark, sf_dir):
    """Bars on days without a first shipment."""
    days = src.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(c("l_shipdate").cast("date").alias("date"))
    return selection.uncovered(src.order_bars(spark, sf_dir).select("symbol", "date"), days)


@query(
    f"""WITH {sq.SQL_CONTEXT}, b AS (SELECT symbol, date, 1 - band_pos AS buy_probability FROM ctx WHERE band_pos IS NOT NULL), s AS (SELECT symbol, date, band_pos AS sell_probability FROM ctx WHERE TS_50 IS NOT NULL)
    SELECT symbol, date, {r("buy_probability", 8)} AS buy_probability, {r("sell_probability", 8)} AS sell_probability FROM b JOIN s USING (symbol, date)"""
)
def paired_predictions(spark, sf_dir):
    """Buy and sell predictions of a day, one of each."""
    rows = sq.context_frame(spark, sf_dir)
    buy, sell = rows.where(c("band_pos").isNotNull()).select("symbol", "date", (1 - c("band_pos")).alias("buy_probability")), rows.where(c("TS_50").isNotNull()).select("symbol", "date", c("band_pos").alias("sell_probability"))
    return rounded_doubles(selection.one_to_one(buy, sell, ["symbol", "date"]), 8)


@query(
    f"""WITH {sq.SQL_CONTEXT}, p AS (SELECT symbol, CAST(date + INTERVAL 30 DAY AS DATE) AS date, P_SHOCK_HMM AS p FROM ctx)
    SELECT symbol, date, {r("close")} AS close, p FROM (SELECT symbol, date, close FROM bars) FULL JOIN p USING (symbol, date) WHERE close IS NOT NULL"""
)
def closes_with_probabilities(spark, sf_dir):
    """Closes and the probabilities of thirty days before; probabilities of days without a close go."""
    later = sq.context_frame(spark, sf_dir).select("symbol", F.date_add("date", 30).alias("date"), c("P_SHOCK_HMM").alias("p"))
    return rounded_doubles(selection.outer_without(src.order_bars(spark, sf_dir).select("symbol", "date", "close"), later, ["symbol", "date"], "close"))


@query(f"WITH RECURSIVE {sq.ZIGZAG} SELECT b.symbol, b.date, {r('sw.amplitude_pct')} AS amplitude_pct FROM bars b LEFT JOIN sw ON sw.symbol = b.symbol AND sw.start_date = b.date")
def chart_aligned(spark, sf_dir):
    """Swings on the index of a chart's days."""
    found = swings.zigzag(sq.ranged(spark, sf_dir)).select("symbol", c("start_date").alias("date"), "amplitude_pct")
    return rounded_doubles(selection.aligned(src.order_bars(spark, sf_dir).select("symbol", "date"), found, ["symbol", "date"], ["amplitude_pct"]))


@query(
    f"""WITH {sf.features_cte()}, s AS (SELECT symbol, date, 'buy_score' AS name, 1 - band_pos AS score FROM store UNION ALL SELECT symbol, date, 'sell_score', band_pos FROM store)
    SELECT s.symbol, s.date, name, {r("CASE WHEN name LIKE '%buy%' THEN low ELSE high END")} AS price FROM s JOIN bars USING (symbol, date) WHERE score >= 0.9"""
)
def chart_markers(spark, sf_dir):
    rows = sq.feature_store(spark, sf_dir)
    scores = rows.select("symbol", "date", (1 - c("band_pos")).alias("buy_score"), c("band_pos").alias("sell_score")).unpivot(["symbol", "date"], ["buy_score", "sell_score"], "name", "score")
    return rounded_doubles(selection.markers(src.order_bars(spark, sf_dir), scores, 0.9))


_HORIZONS = (3, 5, 10)


def _after(k: int) -> str:
    known = f"CASE WHEN lead(close, {k}) OVER w IS NOT NULL THEN"
    return f"ln(lead(close, {k}) OVER w / close) AS r{k}, {known} max(high) OVER n{k} / close - 1 END AS u{k}, {known} min(low) OVER n{k} / close - 1 END AS d{k}"


@query(
    f"""WITH {sf.BARS}, o AS (SELECT symbol, row_number() OVER w AS end_row, {", ".join(map(_after, _HORIZONS))} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), {", ".join(f"n{k} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)" for k in _HORIZONS)}),
    i AS (SELECT *, 1.0 / (1 + end_row % 7) AS similarity FROM o WHERE end_row % 20 = 0),
    x AS ({" UNION ALL ".join(f"SELECT symbol, similarity, {k} AS horizon, r{k} AS r, u{k} AS u, d{k} AS d FROM i" for k in _HORIZONS)})
    SELECT symbol, horizon, count(*) AS n, {r("median(similarity)")} AS similarity_median, {r("avg(r)")} AS logret_mean, {r("median(r)")} AS logret_median, {r("avg(CASE WHEN coalesce(r > 0, false) THEN 1.0 ELSE 0.0 END)")} AS winrate, {r("median(u)")} AS mfe_median, {r("median(d)")} AS mae_median FROM x GROUP BY 1, 2"""
)
def interval_outcomes(spark, sf_dir):
    """What followed every twentieth row, by horizon."""
    bars = src.order_bars(spark, sf_dir)
    row = F.row_number().over(fc.series())
    intervals = bars.select("symbol", row.alias("end_row")).where("end_row % 20 = 0").withColumn("similarity", 1.0 / (1 + c("end_row") % 7))
    return rounded_doubles(selection.outcome_summary(selection.interval_outcomes(intervals, bars, _HORIZONS), _HORIZONS))


_SUMMARY = f"grid AS (SELECT CAST(atr_window AS INT) AS atr_window, k, count(*) AS swings, median(abs(amplitude_pct)) AS median_abs_amplitude, median(duration_days) AS median_duration FROM ({sq._GRID}) GROUP BY 1, 2)"
_choice = lambda name, low, high, few, many, centre, other: (
    f"(SELECT '{name}' AS granularity, atr_window, k, swings, {r('median_duration')} AS median_duration FROM (SELECT *, median_duration BETWEEN {low} AND {high} AND swings BETWEEN {few} AND {many} AS fits FROM grid WHERE k IN (1.25, 1.5, 2.0)) WHERE fits OR median_duration {other} 4"
    f" ORDER BY fits DESC, abs(median_duration - {centre}), abs(atr_window - 14), k, swings DESC LIMIT 1)"
)


@query(f"WITH RECURSIVE {sf.BARS},{sf.STEPS},{sq._grid_ctes()},{_SUMMARY} {_choice('fine', 3, 4, 650, 800, 3, '<=')} UNION ALL {_choice('medium', 4, 7, 300, 600, 5, '>=')}")
def swing_recommended(spark, sf_dir):
    return rounded_doubles(selection.recommended_grid(swings.grid_summary(src.order_bars(spark, sf_dir))))


@query(f"WITH RECURSIVE {sf.BARS},{sf.STEPS},{sq._grid_ctes()},{_SUMMARY} SELECT k, {', '.join(r(f'{f}({n})') + f' AS {n}_{f}' if n != 'swings' else f'{f}({n}) AS {n}_{f}' for n in ('swings', 'median_abs_amplitude', 'median_duration') for f in ('min', 'max'))} FROM grid GROUP BY 1")
def swing_ranges(spark, sf_dir):
    return rounded_doubles(selection.grid_ranges(swings.grid_summary(src.order_bars(spark, sf_dir)), "k"))


@query(
    f"""WITH {sf.BARS}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1), t AS (SELECT *, CASE WHEN n >= 1200 THEN least(greatest(CAST(round_even(n * 0.2, 0) AS BIGINT), 200), n - 1000) END AS test_rows FROM n),
    k AS (SELECT *, least(greatest(CAST(round_even((n - test_rows) * 0.2, 0) AS BIGINT), 200), n - test_rows - 800) AS calibration_rows FROM t WHERE test_rows IS NOT NULL UNION ALL SELECT *, NULL FROM t WHERE test_rows IS NULL)
    SELECT symbol, n, test_rows, calibration_rows, n - test_rows - calibration_rows AS train_rows FROM k"""
)
def temporal_bounds(spark, sf_dir):
    return selection.temporal_bounds(src.order_bars(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")))


_TARGETS = [n for n in sq.TARGET_COLUMNS if n.startswith(("ret_", "touch_", "max_up_"))]


@query(f"WITH {sf.BARS},{sq.TARGETS} {' UNION ALL '.join(f"SELECT '{n}' AS target, coalesce(bool_and({n} IN (0, 1)), false) AS is_binary, {str(n.startswith('ret_')).lower()} AS is_return FROM tgts" for n in _TARGETS)}")
def target_kinds(spark, sf_dir):
    return selection.target_kinds(targets.targets(src.order_bars(spark, sf_dir)), _TARGETS)


_FLAGS = [f"{s}_zone_{n}" for s in ("buy", "sell") for n in ("5pct", "3pct", "frac_10", "frac_5")]


@query(
    f"""WITH RECURSIVE {sq.ZIGZAG},{sq.ZONES}, zl AS (SELECT b.symbol, b.date, direction, distance, fraction, {", ".join(sq._zone)} FROM bars b LEFT JOIN zd USING (symbol, date)),
    bad AS (SELECT * REPLACE (CASE WHEN day(date) = 3 THEN -0.5 ELSE distance END AS distance, CASE WHEN day(date) = 4 THEN 1.5 ELSE fraction END AS fraction, CASE WHEN day(date) = 5 THEN 1 WHEN day(date) = 6 THEN 2 ELSE buy_zone_5pct END AS buy_zone_5pct, CASE WHEN day(date) = 5 THEN 1 ELSE sell_zone_3pct END AS sell_zone_3pct) FROM zl WHERE day(date) <> 7),
    e AS (SELECT * FROM bad UNION ALL SELECT * FROM bad WHERE day(date) = 8), f AS (SELECT *, {" OR ".join(f"{n} > 0" for n in _FLAGS[:4])} AS buys, {" OR ".join(f"{n} > 0" for n in _FLAGS[4:])} AS sells FROM e),
    pd AS (SELECT d.k, p.date IS NULL AS unknown FROM (SELECT symbol, date, count(*) AS k FROM e GROUP BY 1, 2) d FULL JOIN bars p ON p.symbol = d.symbol AND p.date = d.date)
    SELECT 'buy_outside_down' AS rule, count(*) FILTER (WHERE buys AND coalesce(direction, '') <> 'down') AS n FROM f UNION ALL SELECT 'sell_outside_up', count(*) FILTER (WHERE sells AND coalesce(direction, '') <> 'up') FROM f
    UNION ALL SELECT 'fraction_out_of_range', count(*) FILTER (WHERE fraction < 0 OR fraction > 1) FROM f UNION ALL SELECT 'distance_negative', count(*) FILTER (WHERE distance < -1e-12) FROM f
    UNION ALL SELECT 'flag_not_binary', count(*) FILTER (WHERE {" OR ".join(f"{n} NOT IN (0, 1)" for n in _FLAGS)}) FROM f UNION ALL SELECT 'both_sides', count(*) FILTER (WHERE buys AND sells) FROM f
    UNION ALL SELECT 'date_repeated', count(*) FILTER (WHERE k > 1) FROM pd UNION ALL SELECT 'date_missing', count(*) FILTER (WHERE k IS NULL) FROM pd UNION ALL SELECT 'date_unknown', count(*) FILTER (WHERE unknown) FROM pd"""
)
def zone_invariants(spark, sf_dir):
    """Violations in zone labels of which some days of each month were spoilt."""
    bars, day = src.order_bars(spark, sf_dir), F.dayofmonth("date")
    zones = swings.zone_labels(bars, swings.zigzag(swings.with_atr(bars))).where(day != 7)
    spoilt = zones.withColumns(
        {
            "distance": F.when(day == 3, -0.5).otherwise(c("distance")),
            "fraction": F.when(day == 4, 1.5).otherwise(c("fraction")),
            "buy_zone_5pct": F.when(day == 5, 1).when(day == 6, 2).otherwise(c("buy_zone_5pct")),
            "sell_zone_3pct": F.when(day == 5, 1).otherwise(c("sell_zone_3pct")),
        }
    )
    return selection.zone_violations(spoilt.unionByName(spoilt.where(day == 8)), bars)


_SIGNED = ("r1", "TS_20", "vol_20", "band_pos")


@query(
    f"""WITH {sq.SQL_CONTEXT}, l AS (SELECT symbol, {", ".join(_SIGNED)}, unnest(['P_CORE_HMM', 'P_DRIFT_HMM', 'P_SHOCK_HMM', 'P_SURGE_HMM']) AS state, unnest([P_CORE_HMM, P_DRIFT_HMM, P_SHOCK_HMM, P_SURGE_HMM]) AS p FROM ctx WHERE P_CORE_HMM IS NOT NULL AND P_DRIFT_HMM IS NOT NULL AND P_SHOCK_HMM IS NOT NULL AND P_SURGE_HMM IS NOT NULL)
    SELECT symbol, state, {r("avg(p)", 8)} AS occupancy, {", ".join(r(f"sum({n} * p) / sum(p) FILTER (WHERE {n} IS NOT NULL)", 8) + f" AS mean_{n}" for n in _SIGNED)} FROM l GROUP BY 1, 2"""
)
def state_signatures(spark, sf_dir):
    return rounded_doubles(selection.signature_table(sq.context_frame(spark, sf_dir), ["P_CORE_HMM", "P_DRIFT_HMM", "P_SHOCK_HMM", "P_SURGE_HMM"], _SIGNED), 8)


@query(
    f"""WITH {sq.SQL_CONTEXT}, g AS (SELECT symbol, state_hmm_label AS state, avg(r1) AS mean, stddev_pop(r1) AS sd, CAST(count(*) AS DOUBLE) AS weight FROM ctx WHERE state_hmm_label IS NOT NULL AND r1 IS NOT NULL GROUP BY 1, 2),
    h AS (SELECT *, weight / sum(weight) OVER (PARTITION BY symbol) AS w FROM g), k AS (SELECT symbol, sum(w * mean) AS m, sum(w * (sd * sd + mean * mean)) AS q FROM h GROUP BY 1)
    SELECT symbol, {r("m", 8)} AS mean, {r("sqrt(greatest(q - m * m, 1e-12))", 8)} AS sd FROM k"""
)
def regime_mixture(spark, sf_dir):
    """Moments of the daily return as a mixture of the regimes' own."""
    rows = sq.context_frame(spark, sf_dir).where(c("state_hmm_label").isNotNull() & c("r1").isNotNull())
    parts = rows.groupBy("symbol", "state_hmm_label").agg(F.avg("r1").alias("mean"), F.stddev_pop("r1").alias("sd"), F.count(F.lit(1)).cast("double").alias("weight"))
    return rounded_doubles(selection.mixture_moments(parts, ["symbol"]), 8)


_METHODS = {"baseline_fixed_weight": "1 - band_pos", "hybrid_volatile": "(1 - band_pos) * (1 + atr_pct)", "hybrid_calm": "1 - 0.5 * band_pos - 0.5 * ER_20"}


@query(
    f"""WITH RECURSIVE {sf.features_cte()},{sq.zigzag_cte()},{sq.ZONES}, v AS (SELECT s.symbol, s.date, k.start_date, z.distance, x.method, x.score FROM store s JOIN zd z USING (symbol, date) JOIN cont k USING (symbol, date), LATERAL (SELECT unnest(['{"', '".join(_METHODS)}']) AS method, unnest([{", ".join(r(e, 8) for e in _METHODS.values())}]) AS score) x WHERE z.direction = 'down' AND x.score IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY symbol, method ORDER BY score DESC, date) AS i, count(*) OVER (PARTITION BY symbol, method) AS n, row_number() OVER (PARTITION BY symbol, method, start_date ORDER BY score DESC, date) AS bi FROM v),
    g AS (SELECT symbol, method, avg(distance) FILTER (WHERE bi = 1) AS distance, avg(CAST(distance <= 0.05 AS DOUBLE)) FILTER (WHERE bi = 1) AS hit_5, avg(CAST(distance <= 0.05 AS DOUBLE)) FILTER (WHERE i <= 0.1 * n) AS top_hit_5 FROM o GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY distance, method) AS i FROM g WHERE method <> 'baseline_fixed_weight')
    SELECT f.symbol, b.method AS candidate, CASE WHEN b.distance < f.distance AND b.hit_5 >= f.hit_5 AND b.top_hit_5 >= f.top_hit_5 THEN 'Continue' WHEN b.distance < f.distance THEN 'Continue cautiously' ELSE 'Pause / likely dead end' END AS verdict
    FROM g f JOIN b ON b.symbol = f.symbol AND b.i = 1 WHERE f.method = 'baseline_fixed_weight'"""
)
def method_recommendation(spark, sf_dir):
    """Which of two scores beats the baseline in picking the row of a down swing that is nearest its low: distances and hits of each swing's best row, hits of the top tenth of all rows."""
    from pyspark.sql import Window

    bars = src.order_bars(spark, sf_dir)
    found = swings.zigzag(swings.with_atr(bars))
    zones = swings.zone_labels(bars, found).where("direction = 'down'").select("symbol", "date", "distance").join(swings.containing(bars.select("symbol", "date"), found).select("symbol", "date", "start_date"), ["symbol", "date"])
    rows = sq.feature_store(spark, sf_dir).join(zones, ["symbol", "date"]).select("symbol", "date", "start_date", "distance", *[fc.rounded(F.expr(e), 8).alias(n) for n, e in _METHODS.items()])
    long = rows.unpivot(["symbol", "date", "start_date", "distance"], list(_METHODS), "method", "score").where(c("score").isNotNull())
    w = Window.partitionBy("symbol", "method")
    best = F.row_number().over(Window.partitionBy("symbol", "method", "start_date").orderBy(F.desc("score"), "date")) == 1
    x = long.withColumns({"i": F.row_number().over(w.orderBy(F.desc("score"), "date")), "n": F.count(F.lit(1)).over(w), "best": best})
    near = (c("distance") <= 0.05).cast("double")
    found = x.groupBy("symbol", "method").agg(F.avg(F.when(c("best"), c("distance"))).alias("distance"), F.avg(F.when(c("best"), near)).alias("hit_5"), F.avg(F.when(c("i") <= 0.1 * c("n"), near)).alias("top_hit_5"))
    return selection.recommendation(found, "baseline_fixed_weight")


