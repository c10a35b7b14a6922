"""Ledger, target, candle, state and swing queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import candles, chain, states, swings, targets
from tidemark.operators import price_features as pf
from tidemark.plans import sql_features as sf
from tidemark.plans.queries import query, rounded_doubles
from tidemark.sources import bars as src
from tidemark.sources.storage import stored_once

c = F.col

# ------------------------------------------------------------------ ledger

#: Bounds of the amount buckets over order lines.
LINE_BOUNDS = (1e3, 5e3, 1e4, 5e4, 1e5, 2e5, 4e5)


def ledger(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order days as blocks, orders as transactions, order lines as outputs. Lines that repeat a number within an order differ: the first of the table counts."""
    orders, lines = src.table(spark, sf_dir, "orders"), src.placed_table(spark, sf_dir, "lineitem")
    day = F.to_date("o_orderdate")
    blocks = orders.select(day.cast("string").alias("hash"), day.cast("timestamp").alias("time"), (c("o_orderkey") % 4).alias("file"))
    txs = orders.select(day.cast("string").alias("block_hash"), c("o_orderkey").alias("hash"))
    outs = lines.select(c("l_orderkey").alias("tx_hash"), c("l_linenumber").alias("count"), c("l_extendedprice").alias("amount"), "place")
    return chain.unique_rows(blocks, txs, outs)


LEDGER = """
blocks AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS hash, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS time FROM orders GROUP BY 1, 2),
txs AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS block_hash, o_orderkey AS hash FROM orders),
outs AS (SELECT l_orderkey AS tx_hash, l_linenumber AS count, any_value(l_extendedprice) AS amount FROM lineitem GROUP BY 1, 2),
txsum AS (SELECT o.tx_hash, b.time, sum(o.amount) AS amount FROM outs o JOIN txs t ON t.hash = o.tx_hash JOIN blocks b ON b.hash = t.block_hash GROUP BY 1, 2)"""


def _amounts(unit: str) -> None:
    def run(spark, sf_dir):
        return chain.amounts_by_period(*ledger(spark, sf_dir), unit=unit).select(F.to_date("period").alias("period"), F.round("amount", 2).alias("amount"))

    run.__name__ = f"chain_amount_by_{unit}"
    query(f"WITH {LEDGER} SELECT CAST(date_trunc('{unit}', time) AS DATE) AS period, round(sum(amount), 2) AS amount FROM txsum GROUP BY 1")(run)


for _unit in ("day", "week", "month", "year"):
    _amounts(_unit)

_EDGES = [None, *LINE_BOUNDS, None]
COUNTS = ", ".join(
    f"count(*) FILTER (WHERE {' AND '.join(x for x in (f'amount >= {a}' if a else '', f'amount < {b}' if b else '') if x)}) AS {n}" for n, a, b in zip(chain.BUCKETS, _EDGES, _EDGES[1:], strict=False)
)


@query(f"WITH {LEDGER} SELECT CAST(time AS DATE) AS date, {COUNTS} FROM txsum GROUP BY 1")
def chain_size_buckets(spark, sf_dir):
    return chain.bucket_counts(chain.tx_totals(*ledger(spark, sf_dir)), LINE_BOUNDS)


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS hash, CAST(count(DISTINCT o_orderkey % 4) AS BIGINT) AS files FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 4) > 1")
def chain_doubled_blocks(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    return chain.doubled_blocks(orders.select(F.to_date("o_orderdate").cast("string").alias("hash"), (c("o_orderkey") % 4).alias("file")))


@query("SELECT CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders")
def chain_time_range(spark, sf_dir):
    return ledger(spark, sf_dir)[0].agg(F.to_date(F.min("time")).alias("first"), F.to_date(F.max("time")).alias("last"))


def chain_frame(spark, sf_dir) -> DataFrame:
    tables = ledger(spark, sf_dir)
    one = F.lit("chain").alias("symbol")
    amounts = chain.amounts_by_period(*tables).select(one, F.to_date("period").alias("date"), F.round("amount", 2).alias("amount"))
    counts = chain.bucket_counts(chain.tx_totals(*tables), LINE_BOUNDS).select(one, "*")
    return chain.chain_features(amounts, counts)


CHAIN = f"""{LEDGER},
cday AS (SELECT 'chain' AS symbol, CAST(time AS DATE) AS date, round(sum(amount), 2) AS amount, {COUNTS} FROM txsum GROUP BY 1, 2),
c0 AS (SELECT symbol, date, amount, CAST(b7_rest AS DOUBLE) AS whale, CAST(b6_lt_1000 AS DOUBLE) AS mid,
       CAST(b0_lt_0_001 + b1_lt_0_01 + b2_lt_0_1 + b3_lt_1 + b4_lt_10 + b5_lt_100 AS DOUBLE) AS small FROM cday),
c1 AS (SELECT *, CASE WHEN amount > 0 THEN ln(amount) END AS alog, CASE WHEN whale + mid + small > 0 THEN whale / (whale + mid + small) END AS share,
       CASE WHEN small > 0 THEN (whale + mid) / small END AS dom FROM c0),
c2 AS (SELECT *, CASE WHEN dom > 0 THEN ln(dom) END AS dlog, row_number() OVER w AS rn FROM c1 WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def _z(x: str) -> str:
    return f"CASE WHEN rn >= 365 AND count({x}) OVER w365 >= 73 THEN CASE WHEN coalesce(stddev_samp({x}) OVER w365, 0) = 0 THEN 0.0 ELSE ({x} - avg({x}) OVER w365) / stddev_samp({x}) OVER w365 END END"


def _pct(x: str) -> str:
    last = f"last_value({x} IGNORE NULLS) OVER before"
    return f"CASE WHEN {last} <> 0 THEN {x} / {last} - 1 END"


CHAIN_COLUMNS = {
    "ONCHAIN_AMOUNT_TOTAL": "amount", "ONCHAIN_AMOUNT_LOG": "alog", "ONCHAIN_TX_WHALE": "whale", "ONCHAIN_TX_MID": "mid", "ONCHAIN_TX_SMALL": "small", "ONCHAIN_WHALE_SHARE": "share", "ONCHAIN_DOMINANCE": "dom",
    "ONCHAIN_VOL_Z": _z("alog"), "ONCHAIN_DOM_Z": _z("dlog"), "ONCHAIN_WHALE_SHARE_Z": _z("share"), "ONCHAIN_AMOUNT_PCT": _pct("amount"), "ONCHAIN_WHALE_TX_PCT": _pct("whale"), "ONCHAIN_DOM_PCT": _pct("dom"),
}


@query(
    f"WITH {CHAIN} SELECT symbol, date, {', '.join(f'{sf.r(e)} AS {n}' for n, e in CHAIN_COLUMNS.items())} FROM c2 WINDOW w365 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 364 PRECEDING AND CURRENT ROW), before AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def chain_features(spark, sf_dir):
    return rounded_doubles(chain_frame(spark, sf_dir))


# ----------------------------------------------------------------- targets

NEXT = ", ".join(f"n{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)" for n in (1, 3, 5, 10))


def _complete(value: str, n: int) -> str:
    return f"(CASE WHEN count(*) OVER n{n} = {n} THEN {value} OVER n{n} END)"


def _first_touch(n: int) -> str:
    hit = "x.high >= close * 1.02 OR x.low <= close * 0.98"
    first = f"list_filter(list({{'high': high, 'low': low}}) OVER n{n}, lambda x: {hit})[1]"
    return f"CASE WHEN count(*) OVER n{n} = {n} THEN CASE WHEN {first} IS NULL THEN 'none' WHEN {first}.high >= close * 1.02 AND {first}.low <= close * 0.98 THEN 'both_same_bar' WHEN {first}.high >= close * 1.02 THEN 'up' ELSE 'down' END END"


TARGET_COLUMNS = {f"ret_{k}d": sf.r(f"lead(close, {k}) OVER w / close - 1") for k in targets.RETURNS}
TARGET_COLUMNS |= {f"max_up_{n}d": sf.r(f"{_complete('max(high)', n)} / close - 1") for n in (3, 5, 10)} | {f"max_down_{n}d": sf.r(f"{_complete('min(low)', n)} / close - 1") for n in (3, 5, 10)}
for _s, _n in targets.TOUCHES:
    TARGET_COLUMNS[f"touch_up_{round(_s * 100)}pct_{_n}d"] = f"CAST({_complete('max(high)', _n)} >= close * {1 + _s!r} AS DOUBLE)"
    TARGET_COLUMNS[f"touch_down_{round(_s * 100)}pct_{_n}d"] = f"CAST({_complete('min(low)', _n)} <= close * {1 - _s!r} AS DOUBLE)"
TARGETS = f"tgts AS (SELECT symbol, date, {', '.join(f'{e} AS {n}' for n, e in TARGET_COLUMNS.items())} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), {NEXT})"


@query(f"WITH {sf.BARS}, {TARGETS} SELECT * FROM tgts")
def forward_targets(spark, sf_dir):
    found = targets.targets(src.order_bars(spark, sf_dir))
    return rounded_doubles(found.drop(*[f"first_touch_2pct_{n}d" for n in targets.EXCURSIONS]))


@query(f"WITH {sf.BARS} SELECT symbol, date, {', '.join(f'{_first_touch(n)} AS first_touch_2pct_{n}d' for n in targets.EXCURSIONS)} FROM bars WINDOW {NEXT}")
def first_touch_targets(spark, sf_dir):
    return targets.targets(src.order_bars(spark, sf_dir)).select("symbol", "date", *[f"first_touch_2pct_{n}d" for n in targets.EXCURSIONS])


# ----------------------------------------------------------------- candles

_share = lambda x: f"CASE WHEN range_size > 0 THEN {x} / range_size ELSE 0.0 END"
CANDLES = f"""
k0 AS (SELECT *, high - low AS range_size, close - open AS net_move, high - greatest(open, close) AS upper_shadow, least(open, close) - low AS lower_shadow,
              coalesce(lag(close) OVER w, open) AS prev_close FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
k1 AS (SELECT *, range_size / prev_close AS pct_range_size, net_move / prev_close AS pct_net_move, upper_shadow / prev_close AS pct_upper_shadow, lower_shadow / prev_close AS pct_lower_shadow,
              {_share("abs(net_move)")} AS frac_body, {_share("upper_shadow")} AS frac_upper_shadow, {_share("lower_shadow")} AS frac_lower_shadow,
              CAST(sign(net_move) AS DOUBLE) AS direction, {_share("(close - low)")} AS close_in_range FROM k0)"""
_CANDLE = ["range_size", "net_move", "upper_shadow", "lower_shadow", "prev_close", *[f"pct_{n}" for n in ("range_size", "net_move", "upper_shadow", "lower_shadow")], "frac_body", "frac_upper_shadow", "frac_lower_shadow", "direction", "close_in_range"]
_OUTCOMES = {k: v for n in candles.HORIZONS for k, v in {f"fwd_logret_{n}": f"ln(lead(close, {n}) OVER w / close)", f"mfe_{n}": f"{_complete('max(high)', n)} / close - 1", f"mae_{n}": f"{_complete('min(low)', n)} / close - 1"}.items()}


@query(f"WITH {sf.BARS}, {CANDLES} SELECT symbol, date, {', '.join(f'{sf.r(n)} AS {n}' for n in _CANDLE)}, {', '.join(f'{sf.r(e)} AS {n}' for n, e in _OUTCOMES.items())} FROM k1 WINDOW w AS (PARTITION BY symbol ORDER BY date), {NEXT}")
def candle_features(spark, sf_dir):
    return rounded_doubles(candles.candle_features(src.order_bars(spark, sf_dir)))


@query(
    f"""WITH {sf.BARS}, {CANDLES}, q AS (SELECT symbol, list_sort(list_distinct(quantile_cont(pct_range_size, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM k1 GROUP BY 1),
    n AS (SELECT k1.symbol, date, 'Q' || CAST(1 + len(list_filter(e[2:len(e) - 1], lambda v: pct_range_size > v)) AS VARCHAR) AS vol_class,
      CASE WHEN frac_body <= 0.1 THEN 'doji-ish' WHEN frac_body >= 0.5 THEN 'body-dominant' WHEN frac_lower_shadow >= 0.5 THEN 'lower-dominant' WHEN frac_upper_shadow >= 0.5 THEN 'upper-dominant' ELSE 'balanced' END AS shape_class,
      CASE WHEN direction > 0 THEN 'bull' WHEN direction < 0 THEN 'bear' ELSE 'flat' END AS direction_class FROM k1 JOIN q USING (symbol))
    SELECT *, vol_class || '|' || shape_class || '|' || direction_class AS candle_class FROM n"""
)
def candle_classes(spark, sf_dir):
    found = candles.candle_classes(candles.candle_features(src.order_bars(spark, sf_dir)))
    return found.select("symbol", "date", "vol_class", "shape_class", "direction_class", "candle_class")


# ------------------------------------------------------------------ states


def context(features: DataFrame) -> DataFrame:
    """Stand-ins for fitted regime and hazard probabilities: fixed functions of the features, so that what follows them can be checked value by value."""
    squash = lambda z: F.lit(1.0) / (1 + F.exp(-z))
    x = features.withColumns({"P_CORRECTION_10D_CAL": F.round(squash(40 * c("downside_semi_vol") - 2 * c("TS_50") - 1), 6), "P_REBOUND_10D_CAL": F.round(squash(40 * c("upside_semi_vol") + 2 * c("TS_20") - 1), 6), "P_SHOCK_HMM": F.round(squash(60 * c("vol_20") - 6 * c("ER_20") - 1), 6)})
    rest = 1 - c("P_SHOCK_HMM")
    x = x.withColumns({"P_DRIFT_HMM": F.round(rest * squash(4 * c("TS_50")) * 0.6, 6), "P_SURGE_HMM": F.round(rest * squash(4 * c("TS_20")) * 0.3, 6)})
    x = x.withColumn("P_CORE_HMM", F.round(1 - c("P_SHOCK_HMM") - c("P_DRIFT_HMM") - c("P_SURGE_HMM"), 6))
    top = F.greatest("P_CORE_HMM", "P_DRIFT_HMM", "P_SHOCK_HMM", "P_SURGE_HMM")
    label = F.when(c("P_CORE_HMM") == top, "CORE").when(c("P_DRIFT_HMM") == top, "DRIFT").when(c("P_SHOCK_HMM") == top, "SHOCK").when(c("P_SURGE_HMM") == top, "SURGE")
    known = c("P_SHOCK_HMM").isNotNull() & c("P_CORE_HMM").isNotNull()
    x = x.withColumns({"state_hmm_label": F.when(known, label), "hmm_confidence": F.when(known, top)})
    return x.withColumn("hard_risk_off_flag_safe", F.when(c("P_SHOCK_HMM").isNotNull() & c("P_CORRECTION_10D_CAL").isNotNull(), F.when((c("P_SHOCK_HMM") >= 0.7) & (c("P_CORRECTION_10D_CAL") >= 0.65), 1.0).otherwise(0.0)))


def bar_store(spark, sf_dir) -> DataFrame:
    return stored_once(spark, sf_dir, "bars", ["orders"], lambda: src.order_bars(spark, sf_dir))


def feature_store(spark, sf_dir) -> DataFrame:
    """Price features as a feature store keeps them, with eight decimals."""
    return stored_once(spark, sf_dir, "features", ["orders"], lambda: rounded_doubles(pf.price_features(bar_store(spark, sf_dir)), 8))


def context_frame(spark, sf_dir) -> DataFrame:
    return context(feature_store(spark, sf_dir))


_sq = lambda z: f"1.0 / (1 + exp(-({z})))"
CONTEXT = f"""
x0 AS (SELECT *, round({_sq("40 * downside_semi_vol - 2 * TS_50 - 1")}, 6) AS P_CORRECTION_10D_CAL, round({_sq("40 * upside_semi_vol + 2 * TS_20 - 1")}, 6) AS P_REBOUND_10D_CAL, round({_sq("60 * vol_20 - 6 * ER_20 - 1")}, 6) AS P_SHOCK_HMM FROM store),
x1 AS (SELECT *, round((1 - P_SHOCK_HMM) * {_sq("4 * TS_50")} * 0.6, 6) AS P_DRIFT_HMM, round((1 - P_SHOCK_HMM) * {_sq("4 * TS_20")} * 0.3, 6) AS P_SURGE_HMM FROM x0),
x2 AS (SELECT *, round(1 - P_SHOCK_HMM - P_DRIFT_HMM - P_SURGE_HMM, 6) AS P_CORE_HMM FROM x1),
x3 AS (SELECT *, CASE WHEN P_CORE_HMM IS NOT NULL THEN greatest(P_CORE_HMM, P_DRIFT_HMM, P_SHOCK_HMM, P_SURGE_HMM) END AS hmm_confidence FROM x2),
ctx AS (SELECT *, CASE WHEN hmm_confidence IS NOT NULL THEN CASE WHEN P_CORE_HMM = hmm_confidence THEN 'CORE' WHEN P_DRIFT_HMM = hmm_confidence THEN 'DRIFT' WHEN P_SHOCK_HMM = hmm_confidence THEN 'SHOCK' ELSE 'SURGE' END END AS state_hmm_label,
        CASE WHEN P_SHOCK_HMM IS NOT NULL AND P_CORRECTION_10D_CAL IS NOT NULL THEN CASE WHEN P_SHOCK_HMM >= 0.7 AND P_CORRECTION_10D_CAL >= 0.65 THEN 1.0 ELSE 0.0 END END AS hard_risk_off_flag_safe FROM x3)"""
SQL_CONTEXT = f"{sf.features_cte()},{CONTEXT}"


def _rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY symbol, {x} IS NULL ORDER BY {x}) + (count({x}) OVER (PARTITION BY symbol, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY symbol) END"


_mean = lambda a, b: f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE ({a} + {b}) / 2 END"
STATES = f"""
s0 AS (SELECT *, {", ".join(f"{_rank(n)} AS rank_{n}" for n in ("atr_pct", "vol_20", "relative_volume_20", "volume_z"))} FROM ctx),
s1 AS (SELECT *, {_mean("rank_atr_pct", "rank_vol_20")} AS vs, {_mean("rank_relative_volume_20", "rank_volume_z")} AS ps, P_REBOUND_10D_CAL - P_CORRECTION_10D_CAL AS skew FROM s0),
s2 AS (SELECT *, CASE WHEN TS_20 IS NOT NULL AND TS_50 IS NOT NULL AND TS_200 IS NOT NULL THEN CASE WHEN CAST(TS_20 > 0 AS INT) + CAST(TS_50 > 0 AS INT) + CAST(TS_200 > 0 AS INT) >= 2 THEN 'bullish'
              WHEN CAST(TS_20 < 0 AS INT) + CAST(TS_50 < 0 AS INT) + CAST(TS_200 < 0 AS INT) >= 2 THEN 'bearish' ELSE 'mixed' END END AS trend_state,
              CASE WHEN vs <= 0.25 THEN 'low' WHEN vs <= 0.5 THEN 'moderate' WHEN vs <= 0.75 THEN 'elevated' WHEN vs IS NOT NULL THEN 'very_high' END AS vol_state,
              CASE WHEN band_pos <= 1.0 / 3 THEN 'lower_band_area' WHEN band_pos >= 2.0 / 3 THEN 'upper_band_area' WHEN band_pos IS NOT NULL THEN 'mid_range' END AS position_state,
              CASE WHEN ps <= 0.2 THEN 'weak' WHEN ps >= 0.8 THEN 'strong' WHEN ps IS NOT NULL THEN 'normal' END AS participation_state,
              CASE WHEN skew IS NOT NULL AND P_SHOCK_HMM IS NOT NULL AND hard_risk_off_flag_safe IS NOT NULL THEN CASE WHEN hard_risk_off_flag_safe >= 0.5 THEN 'risk_off'
              WHEN (P_SHOCK_HMM >= 0.5 AND skew <= 0) OR skew <= -0.1 THEN 'downside_risk_elevated' WHEN skew >= 0.1 THEN 'rebound_potential_elevated' ELSE 'balanced' END END AS risk_state FROM s1),
st AS (SELECT symbol, date, trend_state, vol_state, position_state, participation_state, risk_state,
       CASE WHEN trend_state || vol_state || position_state || participation_state || risk_state || state_hmm_label IS NULL THEN NULL
            WHEN risk_state = 'risk_off' OR (state_hmm_label = 'SHOCK' AND vol_state IN ('elevated', 'very_high')) THEN 'high_vol_stress'
            WHEN risk_state = 'downside_risk_elevated' AND trend_state = 'bearish' THEN 'downside_risk'
            WHEN risk_state = 'rebound_potential_elevated' AND position_state = 'lower_band_area' THEN 'rebound_setup'
            WHEN trend_state = 'bullish' AND participation_state IN ('normal', 'strong') AND risk_state = 'balanced' THEN 'constructive_trend'
            WHEN trend_state = 'bullish' THEN 'fragile_trend'
            WHEN trend_state = 'mixed' AND vol_state = 'low' AND position_state = 'mid_range' THEN 'compressed_balance'
            WHEN trend_state = 'mixed' AND risk_state = 'balanced' THEN 'neutral_balance' ELSE 'transitional_mix' END AS market_regime,
       trend_state || '|' || vol_state || '|' || position_state || '|' || participation_state || '|' || risk_state AS state_compact FROM s2)"""


@query(f"WITH {SQL_CONTEXT},{STATES} SELECT * FROM st")
def market_states(spark, sf_dir):
    return states.states(context_frame(spark, sf_dir))


@query(f"WITH {SQL_CONTEXT},{STATES} SELECT trend_state, position_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY trend_state), 6) AS share FROM st WHERE trend_state IS NOT NULL AND position_state IS NOT NULL GROUP BY 1, 2")
def state_crosstab(spark, sf_dir):
    """Count and share within the trend state; the first slice of the engine."""
    from pyspark.sql import Window

    found = states.states(context_frame(spark, sf_dir)).where(c("trend_state").isNotNull() & c("position_state").isNotNull())
    n = found.groupBy("trend_state", "position_state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy("trend_state")), 6))


@query(
    f"""WITH {SQL_CONTEXT},{STATES}, g AS (SELECT symbol, date, trend_state, CASE WHEN trend_state IS NOT DISTINCT FROM lag(trend_state) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed FROM st WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    i AS (SELECT *, sum(changed) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS run_id FROM g)
    SELECT symbol, date, trend_state, CAST(run_id AS BIGINT) AS run_id, row_number() OVER (PARTITION BY symbol, run_id ORDER BY date) AS run_age, count(*) OVER (PARTITION BY symbol, run_id) AS run_length FROM i"""
)
def state_runs(spark, sf_dir):
    found = states.runs(states.states(context_frame(spark, sf_dir)).select("symbol", "date", "trend_state"), "trend_state")
    return found.select("symbol", "date", "trend_state", c("run_id").cast("long").alias("run_id"), c("run_age").cast("long").alias("run_age"), "run_length")


TREND_INPUTS = ("TS_20", "TS_50", "TS_200", "ER_20", "ER_50", "R_14", "R_7", "LR_20")
TREND = f"""
t0 AS (SELECT *, {", ".join(f"{_rank(n)} AS p_{n}" for n in TREND_INPUTS)}, {" AND ".join(f"{n} IS NOT NULL" for n in TREND_INPUTS)} AS known FROM store),
t1 AS (SELECT *, TS_50 > 0 AND TS_200 > 0 AND (TS_20 > 0 OR (TS_20 > -0.08 AND LR_20 > 0)) AS supportive, TS_50 <= 0 AND TS_200 <= 0 AS weak, p_ER_20 >= 0.6 AND p_ER_50 >= 0.67 AS clean,
       p_ER_20 <= 0.33 AND p_ER_50 <= 0.4 AS noisy, TS_20 > 0 AND LR_20 > 0 AND R_14 <= 0 AS rebound, p_R_7 >= 0.8 OR p_R_14 >= 0.8 AS extended FROM t0),
t2 AS (SELECT *, supportive AND p_TS_50 >= 0.6 AND p_TS_200 >= 0.55 AS strong, supportive AND R_7 < 0 AND R_14 <= 0.03 AS pullback, extended AND TS_20 > 0 AND p_TS_20 >= 0.67 AS very FROM t1)"""


@query(
    f"""WITH {sf.features_cte()},{TREND} SELECT symbol, date, CASE WHEN NOT known THEN NULL WHEN strong AND clean AND NOT pullback AND NOT very THEN 'STRONG_CLEAN_UPTREND' WHEN supportive AND pullback AND ER_50 > 0.1 THEN 'PULLBACK_IN_UPTREND'
    WHEN supportive AND clean THEN 'WEAK_UPTREND' WHEN supportive AND NOT clean THEN 'NOISY_UPTREND' WHEN weak AND rebound AND ER_20 >= 0.18 THEN 'CLEAN_REBOUND_ATTEMPT' WHEN weak THEN 'BEARISH_PRESSURE' WHEN ER_20 <= 0.14 AND ER_50 <= 0.1 THEN 'CHOPPY_NEUTRAL' ELSE 'FAILED_BOUNCE_OR_WEAK_STRUCTURE' END AS trend_state_v1,
    CASE WHEN NOT known THEN NULL WHEN pullback THEN 'PULLBACK' WHEN weak AND rebound THEN 'REBOUND_ATTEMPT' WHEN very THEN 'EXTENDED' WHEN clean AND R_7 > 0 AND R_14 > 0 THEN 'EARLY_MOVE' ELSE 'CHOP' END AS trend_context_v1,
    {", ".join(f"CASE WHEN known THEN CAST({n} AS DOUBLE) END AS {name}" for n, name in (("supportive", "supportive_structure_flag"), ("weak", "weak_backdrop_flag"), ("clean", "clean_trend_flag"), ("noisy", "noisy_trend_flag"), ("pullback", "pullback_flag"), ("rebound", "rebound_attempt_flag"), ("extended", "extended_move_flag")))} FROM t2"""
)
def trend_states(spark, sf_dir):
    return states.trend_flags(feature_store(spark, sf_dir))


# ------------------------------------------------------------------ swings


def ranged(spark, sf_dir, n: int = 10) -> DataFrame:
    return swings.with_atr(src.order_bars(spark, sf_dir), n)


def zigzag_cte(atr: str = "10", ks: str = "1.5") -> str:
    """CTEs up to ``sw``: confirmed swings; the scan is a recursion over row numbers."""
    return f"""
z0 AS (SELECT symbol, date, high, low, close, CASE WHEN count(tr) OVER wn = {atr} THEN avg(tr) OVER wn END / greatest(close, 1e-8) AS atr_pct FROM f1 WINDOW wn AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {atr} - 1 PRECEDING AND CURRENT ROW)),
z1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM z0 WHERE atr_pct IS NOT NULL),
ks AS (SELECT CAST(unnest([{ks}]) AS DOUBLE) AS k),
zz AS (SELECT symbol, k, i, date, close AS piv, date AS piv_at, CAST(0 AS INT) AS dir, CAST(NULL AS DOUBLE) AS ext, CAST(NULL AS DATE) AS ext_at, CAST(NULL AS DATE) AS s_start, CAST(NULL AS DATE) AS s_end, CAST(NULL AS DOUBLE) AS s_amp FROM z1, ks WHERE i = 1
  UNION ALL
  SELECT b.symbol, p.k, b.i, b.date,
    CASE WHEN e.ev = 'rev' THEN p.ext ELSE p.piv END, CASE WHEN e.ev = 'rev' THEN p.ext_at ELSE p.piv_at END,
    CASE e.ev WHEN 'up0' THEN 1 WHEN 'dn0' THEN -1 WHEN 'rev' THEN -p.dir ELSE p.dir END,
    CASE e.ev WHEN 'up0' THEN b.high WHEN 'dn0' THEN b.low WHEN 'ext' THEN CASE WHEN p.dir = 1 THEN b.high ELSE b.low END WHEN 'rev' THEN CASE WHEN p.dir = 1 THEN b.low ELSE b.high END ELSE p.ext END,
    CASE WHEN e.ev = 'none' THEN p.ext_at ELSE b.date END,
    CASE WHEN e.ev = 'rev' THEN p.piv_at END, CASE WHEN e.ev = 'rev' THEN p.ext_at END, CASE WHEN e.ev = 'rev' THEN p.ext / p.piv - 1 END
  FROM zz p JOIN z1 b ON b.symbol = p.symbol AND b.i = p.i + 1,
  LATERAL (SELECT CASE WHEN p.dir = 0 THEN CASE WHEN b.high / p.piv - 1 >= p.k * b.atr_pct AND b.high / p.piv - 1 >= abs(b.low / p.piv - 1) THEN 'up0' WHEN abs(b.low / p.piv - 1) >= p.k * b.atr_pct THEN 'dn0' ELSE 'none' END
    WHEN p.dir = 1 THEN CASE WHEN b.high >= p.ext THEN 'ext' WHEN 1 - b.low / p.ext >= p.k * b.atr_pct THEN 'rev' ELSE 'none' END
    ELSE CASE WHEN b.low <= p.ext THEN 'ext' WHEN b.high / p.ext - 1 >= p.k * b.atr_pct THEN 'rev' ELSE 'none' END END AS ev) e),
sw AS (SELECT symbol, k, s_start AS start_date, s_end AS end_date, CASE WHEN s_amp > 0 THEN 'up' ELSE 'down' END AS direction, s_amp AS amplitude_pct, CAST(s_end - s_start AS INT) AS duration_days FROM zz WHERE s_start IS NOT NULL)"""


ZIGZAG = f"{sf.BARS},{sf.STEPS},{zigzag_cte()}"


@query(f"WITH RECURSIVE {ZIGZAG} SELECT symbol, k, start_date, end_date, direction, {sf.r('amplitude_pct')} AS amplitude_pct, duration_days FROM sw")
def swing_detection(spark, sf_dir):
    return rounded_doubles(swings.zigzag(ranged(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {ZIGZAG}, med AS (SELECT symbol, median(abs(amplitude_pct)) AS size, median(duration_days) AS age FROM sw GROUP BY 1),
    conf AS (SELECT symbol, i, date, dir, s_start IS NOT NULL AS today, CASE WHEN s_start IS NOT NULL THEN piv_at END AS p_at, CASE WHEN s_start IS NOT NULL THEN piv END AS p FROM zz),
    lv AS (SELECT symbol, i, date, dir, today, last_value(p_at IGNORE NULLS) OVER u AS p_at, last_value(p IGNORE NULLS) OVER u AS p FROM conf WINDOW u AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING))
    SELECT lv.symbol, lv.date, CASE dir WHEN 0 THEN 'unknown' WHEN 1 THEN 'up' ELSE 'down' END AS live_swing_direction, today AS swing_confirmed_today, p_at AS last_confirmed_pivot_date, p AS last_confirmed_pivot_price,
      CAST(lv.date - p_at AS DOUBLE) AS days_since_last_pivot, {sf.r("close / p - 1")} AS distance_from_last_pivot_pct, {sf.r("(close - p) / (atr_pct * close)")} AS distance_from_last_pivot_atr_units, {sf.r("atr_pct")} AS atr_pct,
      {sf.r("(lv.date - p_at) / age")} AS current_swing_age_pct_of_median, {sf.r("abs(close / p - 1) / size")} AS current_swing_size_pct_of_median
    FROM lv JOIN z1 USING (symbol, i) LEFT JOIN med USING (symbol)"""
)
def live_swing_state(spark, sf_dir):
    return rounded_doubles(swings.live_state(ranged(spark, sf_dir)))


_GRID = " UNION ALL ".join(f"SELECT {n} AS atr_window, * FROM sw{n}" for n in (10, 14, 20))


def _grid_ctes() -> str:
    import re

    out = []
    for n in (10, 14, 20):
        out.append(re.sub(r"\b(z0|z1|ks|zz|sw)\b", rf"\g<1>{n}", zigzag_cte(str(n), "1.0, 1.25, 1.5, 2.0, 2.5")))
    return ",".join(out)


@query(f"WITH RECURSIVE {sf.BARS},{sf.STEPS},{_grid_ctes()} SELECT CAST(atr_window AS INT) AS atr_window, k, count(*) AS swings, count(*) FILTER (WHERE direction = 'up') AS up_swings, count(*) FILTER (WHERE direction = 'down') AS down_swings, {sf.r('median(abs(amplitude_pct))')} AS median_abs_amplitude, {sf.r('median(duration_days)')} AS median_duration, {sf.r('avg(duration_days)')} AS mean_duration FROM ({_GRID}) GROUP BY 1, 2")
def swing_sensitivity(spark, sf_dir):
    return rounded_doubles(swings.grid_summary(src.order_bars(spark, sf_dir)))


TAXONOMY = """
cuts AS (SELECT symbol, quantile_cont(abs(amplitude_pct), [1.0/3, 2.0/3]) AS s, quantile_cont(duration_days, [1.0/3, 2.0/3]) AS d FROM sw GROUP BY 1),
tax AS (SELECT sw.*, abs(amplitude_pct) AS abs_amplitude_pct, CASE WHEN abs(amplitude_pct) <= s[1] THEN 'small' WHEN abs(amplitude_pct) <= s[2] THEN 'medium' ELSE 'large' END AS size_class,
        CASE WHEN duration_days <= d[1] THEN 'short' WHEN duration_days <= d[2] THEN 'medium' ELSE 'long' END AS duration_class, CAST(row_number() OVER (PARTITION BY symbol ORDER BY start_date, end_date) AS INT) AS swing_id FROM sw JOIN cuts USING (symbol))"""


@query(f"WITH RECURSIVE {ZIGZAG},{TAXONOMY} SELECT symbol, swing_id, start_date, end_date, direction, {sf.r('abs_amplitude_pct')} AS abs_amplitude_pct, duration_days, size_class, duration_class FROM tax")
def swing_taxonomy(spark, sf_dir):
    found = swings.taxonomy(swings.zigzag(ranged(spark, sf_dir)))
    return rounded_doubles(found.select("symbol", "swing_id", "start_date", "end_date", "direction", "abs_amplitude_pct", "duration_days", "size_class", "duration_class"))


CONTAINING = """
hit AS (SELECT b.symbol, b.date, sw.start_date, sw.end_date, sw.direction, sw.duration_days, row_number() OVER (PARTITION BY b.symbol, b.date ORDER BY sw.start_date, sw.end_date) AS o
        FROM bars b JOIN sw ON sw.symbol = b.symbol AND b.date BETWEEN sw.start_date AND sw.end_date),
cont AS (SELECT symbol, date, start_date, end_date, direction, (date - start_date) / greatest(duration_days, 1) AS stage_pct FROM hit WHERE o = 1)"""


@query(f"WITH RECURSIVE {ZIGZAG},{CONTAINING} SELECT symbol, date, start_date, end_date, direction, {sf.r('stage_pct')} AS stage_pct, CASE WHEN stage_pct <= 1.0/3 THEN 'early' WHEN stage_pct <= 2.0/3 THEN 'mid' ELSE 'late' END AS stage FROM cont")
def swing_containing(spark, sf_dir):
    found = swings.containing(src.order_bars(spark, sf_dir).select("symbol", "date"), swings.zigzag(ranged(spark, sf_dir)))
    return rounded_doubles(found.select("symbol", "date", "start_date", "end_date", "direction", "stage_pct", "stage"))


@query(f"WITH RECURSIVE {ZIGZAG} SELECT b.symbol, b.date, sw.start_date AS next_start, sw.direction AS next_direction, {sf.r('sw.amplitude_pct')} AS next_amplitude FROM bars b ASOF LEFT JOIN sw ON b.symbol = sw.symbol AND b.date < sw.start_date")
def swing_next(spark, sf_dir):
    return rounded_doubles(swings.next_swing(src.order_bars(spark, sf_dir), swings.zigzag(ranged(spark, sf_dir))))


PRICED = """
priced AS (SELECT sw.*, CASE WHEN direction = 'up' THEN s.low ELSE s.high END AS start_price, CASE WHEN direction = 'up' THEN e.high ELSE e.low END AS end_price
           FROM sw JOIN bars s ON s.symbol = sw.symbol AND s.date = sw.start_date JOIN bars e ON e.symbol = sw.symbol AND e.date = sw.end_date)"""


@query(f"WITH RECURSIVE {ZIGZAG},{PRICED}, lows AS (SELECT symbol, end_date AS low_date, end_price AS low_price FROM priced WHERE direction = 'down') SELECT b.symbol, b.date, min(low_date) AS low_date, arg_min(low_price, low_date) AS low_price FROM bars b JOIN lows l ON l.symbol = b.symbol AND l.low_date > b.date AND l.low_price <= b.close GROUP BY 1, 2")
def swing_first_lower_low(spark, sf_dir):
    bars = src.order_bars(spark, sf_dir)
    lows = swings.pivot_prices(swings.zigzag(swings.with_atr(bars)), bars).where("direction = 'down'").select("symbol", c("end_date").alias("low_date"), c("end_price").alias("low_price"))
    return swings.first_lower_low(bars, lows)


ZONES = f"""{PRICED},{CONTAINING},
zn AS (SELECT c.symbol, c.date, c.direction, c.stage_pct, b.close, p.start_price, p.end_price, least(p.start_price, p.end_price) AS lo, greatest(p.start_price, p.end_price) AS hi
       FROM cont c JOIN bars b USING (symbol, date) JOIN priced p USING (symbol, start_date, end_date)),
zd AS (SELECT *, CASE WHEN direction = 'down' THEN greatest(close / lo - 1, 0.0) ELSE greatest(hi / close - 1, 0.0) END AS distance,
       CASE WHEN hi > lo THEN least(greatest(CASE WHEN direction = 'down' THEN (close - lo) / (hi - lo) ELSE (hi - close) / (hi - lo) END, 0.0), 1.0) END AS fraction FROM zn)"""
_zone = [f"CAST(coalesce(direction = '{d}' AND {v} <= {cut}, false) AS INT) AS {s}_zone_{n}" for s, d in (("buy", "down"), ("sell", "up")) for v, cut, n in (("distance", 0.05, "5pct"), ("distance", 0.03, "3pct"), ("fraction", 0.10, "frac_10"), ("fraction", 0.05, "frac_5"))]


@query(f"WITH RECURSIVE {ZIGZAG},{ZONES} SELECT b.symbol, b.date, direction, {sf.r('distance')} AS distance, {sf.r('fraction')} AS fraction, {', '.join(_zone)} FROM bars b LEFT JOIN zd USING (symbol, date)")
def zone_labels(spark, sf_dir):
    bars = src.order_bars(spark, sf_dir)
    return rounded_doubles(swings.zone_labels(bars, swings.zigzag(swings.with_atr(bars))))


_clip = lambda x: f"least(greatest({x}, 0.0), 1.0)"


@query(
    f"""WITH RECURSIVE {ZIGZAG},{ZONES}, bt AS (SELECT symbol, date, {_clip("stage_pct")} AS tp, CASE WHEN start_price > end_price THEN {_clip("(start_price - close) / (start_price - end_price)")} END AS rp, close / end_price - 1 AS above FROM zn WHERE direction = 'down')
    SELECT b.symbol, b.date, {sf.r("tp")} AS time_progress, {sf.r("rp")} AS range_progress, CAST(coalesce(tp >= 0.8 AND rp >= 0.8, false) AS INT) AS zone_80, CAST(coalesce(tp >= 0.9 AND rp >= 0.9, false) AS INT) AS zone_90,
      CAST(coalesce(above <= 0.02, false) AS INT) AS near_low_2pct, CAST(coalesce(above <= 0.03, false) AS INT) AS near_low_3pct FROM bars b LEFT JOIN bt USING (symbol, date)"""
)
def bottom_labels(spark, sf_dir):
    bars = src.order_bars(spark, sf_dir)
    return rounded_doubles(swings.bottom_labels(bars, swings.zigzag(swings.with_atr(bars))))
