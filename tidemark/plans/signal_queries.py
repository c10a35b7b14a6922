"""Exposure, score, signal, analog, audit and metric queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as fc
from tidemark.operators import audit, exposure, metrics, scores, similarity, swings, targets
from tidemark.operators import price_features as pf
from tidemark.plans import series_queries as sq
from tidemark.plans import sql_features as sf
from tidemark.plans.queries import query, rounded_doubles
from tidemark.sources import bars as src
from tidemark.sources.storage import stored, stored_once

c = F.col
r = sf.r


def dataset(spark, sf_dir) -> DataFrame:
    """Features, regime context, live swing state and chain features of each bar, with eight decimals as stored."""
    return stored_once(spark, sf_dir, "dataset", ["orders", "lineitem"], lambda: _dataset(spark, sf_dir))


def _dataset(spark, sf_dir) -> DataFrame:
    bars = sq.bar_store(spark, sf_dir)
    live = rounded_doubles(swings.live_state(swings.with_atr(bars)).drop("atr_pct", "last_confirmed_pivot_date", "last_confirmed_pivot_price"), 8)
    chain = rounded_doubles(sq.chain_frame(spark, sf_dir).select("date", "ONCHAIN_VOL_Z", "ONCHAIN_DOM_Z", "ONCHAIN_WHALE_SHARE_Z"), 8)
    ewma = rounded_doubles(pf.ewma_vol(bars), 8)
    data = sq.context(sq.feature_store(spark, sf_dir)).join(ewma, ["symbol", "date"]).join(live, ["symbol", "date"], "left").join(chain, "date", "left")
    return data


_LIVE = f"""
med AS (SELECT symbol, median(abs(amplitude_pct)) AS size, median(duration_days) AS age FROM sw GROUP BY 1),
conf AS (SELECT symbol, i, date, dir, s_start IS NOT NULL AS today, CASE WHEN s_start IS NOT NULL THEN piv_at END AS p_at, CASE WHEN s_start IS NOT NULL THEN piv END AS p FROM zz),
lv AS (SELECT symbol, i, date, dir, today, last_value(p_at IGNORE NULLS) OVER u AS p_at, last_value(p IGNORE NULLS) OVER u AS p FROM conf WINDOW u AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)),
live AS (SELECT lv.symbol, lv.date, CASE dir WHEN 0 THEN 'unknown' WHEN 1 THEN 'up' ELSE 'down' END AS live_swing_direction, CAST(lv.date - p_at AS DOUBLE) AS days_since_last_pivot, {r("close / p - 1", 8)} AS distance_from_last_pivot_pct,
  {r("(lv.date - p_at) / age", 8)} AS current_swing_age_pct_of_median, {r("abs(close / p - 1) / size", 8)} AS current_swing_size_pct_of_median FROM lv JOIN z1 USING (symbol, i) LEFT JOIN med USING (symbol))"""
_CHAINZ = f"{sq.CHAIN},\ncz AS (SELECT date, {', '.join(f'{r(sq.CHAIN_COLUMNS[n], 8)} AS {n}' for n in ('ONCHAIN_VOL_Z', 'ONCHAIN_DOM_Z', 'ONCHAIN_WHALE_SHARE_Z'))} FROM c2 WINDOW w365 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 364 PRECEDING AND CURRENT ROW))"
DATASET = f"""{sq.SQL_CONTEXT},{sf.EWMA},{sq.zigzag_cte()},{_LIVE},{_CHAINZ},
ds AS (SELECT ctx.*, live.* EXCLUDE (symbol, date), cz.* EXCLUDE (date), round(CASE WHEN ew.k >= 20 THEN sqrt(ew.e) END, 8) + 0.0 AS ewma_vol
       FROM ctx LEFT JOIN ew ON ew.symbol = ctx.symbol AND ew.date = ctx.date LEFT JOIN live ON live.symbol = ctx.symbol AND live.date = ctx.date LEFT JOIN cz ON cz.date = ctx.date)"""

# ---------------------------------------------------------------- exposure

_c01 = sf.clip01
EXPOSURE = f"""
e0 AS (SELECT *, {_c01("(P_DRIFT_HMM + P_SURGE_HMM)")} AS pos, coalesce(P_CORRECTION_10D_CAL, 0.2) AS p_corr, coalesce(P_REBOUND_10D_CAL, 0.2) AS p_reb FROM ctx),
e1 AS (SELECT *, {_c01("(pos + 0.5 * P_CORE_HMM)")} AS support, CASE WHEN pos IS NOT NULL THEN least(greatest(pos - P_SHOCK_HMM, -1.0), 1.0) END AS tilt, {_c01("((hmm_confidence - 0.35) / 0.35)")} AS dominance FROM e0),
e2 AS (SELECT *, {_c01("(support * dominance)")} AS conviction, coalesce(P_SHOCK_HMM >= 0.7 AND pos <= 0.3 AND p_corr >= 0.65 AND (coalesce(TS_50 <= 0, false) OR coalesce(band_pos <= 0.35, false) OR coalesce(state_hmm_label = 'SHOCK' AND hmm_confidence >= 0.6, false)), false) AS risk_off FROM e1),
e3 AS (SELECT symbol, date, risk_off, tilt, conviction, pos, p_corr, p_reb, CASE WHEN risk_off THEN 0.0 ELSE 0.15 + (1 - 0.15) * conviction * {_c01("pow(1 - p_corr, 2)")} END AS target FROM e2)"""


@query(
    f"""WITH RECURSIVE {sq.SQL_CONTEXT},{EXPOSURE}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM e3 WHERE target IS NOT NULL),
    s AS (SELECT symbol, date, i, risk_off, CAST(0.15 AS DOUBLE) AS prev, least(1.0, greatest(0.0, 0.15 + least(CASE WHEN risk_off THEN 0.5 ELSE 0.1 END, greatest(-CASE WHEN risk_off THEN 0.5 ELSE 0.1 END, target - 0.15)))) AS e FROM g WHERE i = 1
      UNION ALL SELECT g.symbol, g.date, g.i, g.risk_off, s.e, least(1.0, greatest(0.0, s.e + least(CASE WHEN g.risk_off THEN 0.5 ELSE 0.1 END, greatest(-CASE WHEN g.risk_off THEN 0.5 ELSE 0.1 END, g.target - s.e)))) FROM s JOIN g ON g.symbol = s.symbol AND g.i = s.i + 1)
    SELECT symbol, date, risk_off, {r("e")} AS exposure, {r("greatest(0.0, e - prev)")} AS entry_step FROM s"""
)
def exposure_safe(spark, sf_dir):
    return rounded_doubles(exposure.safe_exposure(sq.context_frame(spark, sf_dir)))


_move = lambda held: f"least(1.0, greatest(-1.0, {held} + least(lim, greatest(-lim, e_star - {held}))))"


@query(
    f"""WITH RECURSIVE {sq.SQL_CONTEXT},{EXPOSURE}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, CASE WHEN risk_off THEN 0.5 ELSE 0.1 END AS lim FROM e3 WHERE tilt IS NOT NULL AND conviction IS NOT NULL),
    s AS (SELECT symbol, CAST(0 AS BIGINT) AS i, 0 AS d, CAST(0.0 AS DOUBLE) AS was, CAST(0.0 AS DOUBLE) AS e FROM g WHERE i = 1
      UNION ALL SELECT symbol, i, d, e, {_move("e")} FROM (
        SELECT *, least(1.0, greatest(-1.0, d * conviction * pow(1 - CASE WHEN d < 0 THEN p_reb ELSE p_corr END, 2))) AS e_star FROM (
          SELECT g.*, s.e, CASE WHEN g.risk_off THEN 0 WHEN s.d >= 0 AND g.tilt > 0.1 THEN 1 WHEN s.d >= 0 AND g.tilt < -0.2 THEN -1 WHEN s.d < 0 AND g.tilt < -0.1 THEN -1 WHEN s.d < 0 AND g.tilt > 0.2 THEN 1 ELSE 0 END AS d
          FROM s JOIN g ON g.symbol = s.symbol AND g.i = s.i + 1)))
    SELECT g.symbol, g.date, g.risk_off, s.d AS direction, {r("s.e")} AS exposure, {r("least(2.0, greatest(1.0, 1 + g.pos * g.conviction * (1 - CASE WHEN s.d < 0 THEN g.p_reb ELSE g.p_corr END)))")} AS leverage,
      {r("CASE WHEN sign(s.e) = sign(s.was) OR s.was = 0 THEN greatest(0.0, abs(s.e) - abs(s.was)) ELSE 0.0 END")} AS entry_step FROM s JOIN g ON g.symbol = s.symbol AND g.i = s.i"""
)
def exposure_aggressive(spark, sf_dir):
    return rounded_doubles(exposure.aggressive_exposure(sq.context_frame(spark, sf_dir)))


# ------------------------------------------------------------------ scores


def analog_inputs(spark, sf_dir) -> DataFrame:
    """(symbol, date, buy_analog, sell_analog): how often the most similar earlier rows of falling (rising) legs were followed by a buy (sell) zone within five rows."""
    bars = sq.bar_store(spark, sf_dir)
    zones = swings.zone_labels(bars, swings.zigzag(swings.with_atr(bars))).drop("direction")
    data = stored(dataset(spark, sf_dir).join(zones.select("symbol", "date", *[f"{s}_zone_{n}pct" for s in ("buy", "sell") for n in (5, 3)]), ["symbol", "date"], "left"), "analog-rows")
    out = data.select("symbol", "date")
    for side, way in (("buy", "down"), ("sell", "up")):
        rows = data.withColumns({"vector": similarity.analog_vector(), "way": F.coalesce("live_swing_direction", F.lit("unknown"))} | similarity.zone_outcomes(side))
        found = similarity.analogs(rows, side=way).select("symbol", "date", fc.rounded(c("analog_hit_5"), 5).alias(f"{side}_analog"))
        out = out.join(found, ["symbol", "date"], "left")
    return out


def scored(spark, sf_dir) -> DataFrame:
    """Buy and sell phase, analogs, exhaustion and fixed-weight timing; the phase stands in for a fitted zone model."""
    analogs = stored_once(spark, sf_dir, "analogs", ["orders", "lineitem"], lambda: analog_inputs(spark, sf_dir))
    phase = {"buy_phase": 1 - c("band_pos"), "sell_phase": c("band_pos")}
    x = dataset(spark, sf_dir).join(analogs, ["symbol", "date"]).withColumns(phase | {f"{s}_exhaustion": scores.exhaustion(s) for s in ("buy", "sell")} | {"buy_exhaustion_weighted": scores.buy_exhaustion_weighted()})
    x = x.withColumns({f"{s}_timing": scores.timing(s) for s in ("buy", "sell")})
    mixed = scores.hybrids(c("buy_phase"), c("buy_timing"), c("buy_exhaustion_weighted"))
    return x.withColumns(mixed | {"consensus": scores.consensus(c("buy_phase"), c("buy_timing"), c("buy_exhaustion"), c("buy_exhaustion_weighted"))})


_k = lambda n: f"coalesce({n}, 0.0)"
_cl = lambda x: f"least(greatest({x}, 0.0), 1.0)"


_lagged = ["r1", "CASE WHEN atr > 0 THEN candle_body / atr END", "CASE WHEN atr > 0 THEN candle_range / atr END", "upper_wick_ratio", "lower_wick_ratio", "close_in_range"]
_sym = lambda x: f"least(greatest({x}, -1.0), 1.0)"
_STATE = [
    _cl(_k("band_pos")), _sym(_k("dist_from_mean_vol_units") + " / 3"), _cl(_k("atr_pct") + " / 0.1"), _cl(_k("ewma_vol") + " / 0.1"), _cl(_k("P_CORRECTION_10D_CAL")), _cl(_k("P_REBOUND_10D_CAL")), _cl(_k("P_SHOCK_HMM")), _cl(_k("P_SURGE_HMM")),
    "CASE live_swing_direction WHEN 'down' THEN -1.0 WHEN 'up' THEN 1.0 ELSE 0.0 END", _cl(_k("days_since_last_pivot") + " / 20"), _sym(_k("distance_from_last_pivot_pct") + " / 0.2"), _cl(_k("current_swing_age_pct_of_median") + " / 2"), _cl(_k("current_swing_size_pct_of_median") + " / 2"),
    _sym(_k("ONCHAIN_DOM_Z") + " / 3"), _sym(_k("ONCHAIN_WHALE_SHARE_Z") + " / 3"), _sym(_k("ONCHAIN_VOL_Z") + " / 3"),
]
_VECTOR = ", ".join([f"CAST(lag({x}, {k}) OVER w AS DOUBLE)" if k else f"CAST({x} AS DOUBLE)" for k in range(5) for x in _lagged] + [f"CAST({x} AS DOUBLE)" for x in _STATE])


def _analogs(side: str, way: str) -> str:
    """CTEs up to ``<side>_an``: the weighted share of the most similar earlier rows on ``way`` that a zone followed."""
    return f"""{side}_pr AS (SELECT a.symbol, a.date, b.i AS bi, b.{side}_hit AS h, list_dot_product(a.v, b.v) / (a.nv * b.nv + 1e-12) AS s FROM an1 a JOIN an1 b ON b.symbol = a.symbol AND b.i < a.i AND b.way = '{way}' AND b.{side}_hit IS NOT NULL AND b.nv > 0 WHERE a.nv > 0),
{side}_tk AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY s DESC, bi DESC) AS rk, max(s) OVER (PARTITION BY symbol, date) AS ms FROM {side}_pr),
{side}_an AS (SELECT symbol, date, {r("sum(exp((s - ms) / 0.15) * h) / sum(exp((s - ms) / 0.15))", 5)} AS {side}_analog FROM {side}_tk WHERE rk <= 40 GROUP BY 1, 2)"""


ANALOGS = f"""{sq.ZONES},
an0 AS (SELECT ds.symbol, ds.date, row_number() OVER w AS i, coalesce(live_swing_direction, 'unknown') AS way, [{_VECTOR}] AS v, {", ".join(f"max(CAST(coalesce(zd.direction = '{d}' AND distance <= 0.05, false) AS INT)) OVER f AS {s}_hit" for s, d in (("buy", "down"), ("sell", "up")))}
        FROM ds LEFT JOIN zd ON zd.symbol = ds.symbol AND zd.date = ds.date WINDOW w AS (PARTITION BY ds.symbol ORDER BY ds.date), f AS (PARTITION BY ds.symbol ORDER BY ds.date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
an1 AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv FROM an0 WHERE len(list_filter(v, lambda x: x IS NULL)) = 0),
{_analogs("buy", "down")},
{_analogs("sell", "up")}"""


def _exhaustion(side: str) -> str:
    s, way, semi, regime = ("-1", "down", "downside_semi_vol", "P_REBOUND_10D_CAL") if side == "buy" else ("1", "up", "upside_semi_vol", "P_SURGE_HMM")
    live = "coalesce(live_swing_direction, 'unknown')"
    return _cl(
        f"(CASE WHEN {live} = '{way}' THEN 1.0 WHEN {live} = 'unknown' THEN 0.35 ELSE 0.0 END + {_cl(_k('current_swing_age_pct_of_median') + ' / 1.25')} + {_cl(_k('current_swing_size_pct_of_median') + ' / 1.25')}"
        f" + 0.5 * {_cl(f'{s} * ' + _k('dist_from_mean_vol_units') + ' / 3')} + 0.5 * {_cl(f'{s} * (' + _cl(_k('band_pos')) + ' - 0.5) / 0.5')} + {_cl(f'1 - {_k(semi)} / (coalesce(ewma_vol, 0.0) + 1e-9)')}"
        f" + 0.5 * {_cl(_k('P_CORRECTION_10D_CAL'))} + 0.5 * {_cl(_k(regime))}) / 6"
    )


_third = lambda n: _cl(f"{_k(n)} / 3 + 0.5")
_WEIGHTED = _cl(
    f"""0.16 * CASE WHEN coalesce(live_swing_direction, 'unknown') = 'down' THEN 1.0 WHEN coalesce(live_swing_direction, 'unknown') = 'unknown' THEN 0.35 ELSE 0.0 END
    + 0.14 * {_cl(_k("current_swing_age_pct_of_median") + " / 1.1")} + 0.14 * {_cl(_k("current_swing_size_pct_of_median") + " / 1.1")}
    + 0.18 * (0.45 * {_cl("-" + _k("dist_from_mean_vol_units") + " / 2.5")} + 0.35 * {_cl("(0.4 - " + _cl(_k("band_pos")) + ") / 0.4")} + 0.2 * {_cl("-" + _k("distance_from_last_pivot_pct") + " / 0.18")})
    + 0.16 * (0.45 * {_cl(_k("lower_wick_ratio"))} + 0.4 * {_cl(_k("close_in_range"))} + 0.15 * CASE WHEN {_k("r1")} > 0 THEN 1.0 ELSE 0.0 END)
    + 0.10 * (0.55 * {_cl(f"{_k('downside_semi_vol')} / ({_k('ewma_vol')} + 1e-9) / 1.5")} + 0.45 * (0.5 * {_cl(_k("close_in_range"))} + 0.5 * {_cl(_k("return_accel") + " / 0.08 + 0.5")}))
    + 0.08 * (0.55 * {_cl(_k("P_REBOUND_10D_CAL"))} + 0.25 * (1 - {_cl(_k("P_SHOCK_HMM"))}) + 0.2 * {_cl(_k("P_CORRECTION_10D_CAL"))})
    + 0.04 * (0.45 * {_third("ONCHAIN_WHALE_SHARE_Z")} + 0.35 * {_third("ONCHAIN_DOM_Z")} + 0.2 * {_third("ONCHAIN_VOL_Z")})"""
)
def _timing(s: str) -> str:
    parts = ((f"{s}_phase", 0.45), (f"{s}_analog", 0.30), (f"{s}_exhaustion", 0.25))
    return _cl(f"({' + '.join(f'coalesce({n} * {w}, 0.0)' for n, w in parts)}) / ({' + '.join(f'CASE WHEN {n} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0 END' for n, w in parts)})")


SCORES = f"""
{ANALOGS},
q0 AS (SELECT ds.*, buy_analog, sell_analog, 1 - band_pos AS buy_phase, band_pos AS sell_phase, {_exhaustion("buy")} AS buy_exhaustion, {_exhaustion("sell")} AS sell_exhaustion, {_WEIGHTED} AS buy_exhaustion_weighted
       FROM ds LEFT JOIN buy_an ON buy_an.symbol = ds.symbol AND buy_an.date = ds.date LEFT JOIN sell_an ON sell_an.symbol = ds.symbol AND sell_an.date = ds.date),
q1 AS (SELECT *, {_timing("buy")} AS buy_timing, {_timing("sell")} AS sell_timing FROM q0)"""
_SCORE_COLUMNS = ["buy_phase", "sell_phase", "buy_analog", "sell_analog", "buy_exhaustion", "sell_exhaustion", "buy_exhaustion_weighted", "buy_timing", "sell_timing"]
_null_phase = lambda e: f"CASE WHEN buy_phase IS NOT NULL THEN {_cl(e)} END"


@query(
    f"""WITH RECURSIVE {DATASET},{SCORES} SELECT symbol, date, {", ".join(f"{r(n, 8)} AS {n}" for n in _SCORE_COLUMNS)}, {r(_null_phase("0.4 * buy_phase + 0.3 * buy_timing + 0.3 * buy_exhaustion_weighted"), 8)} AS hybrid_balanced,
    {r(_null_phase("0.25 * buy_phase + 0.35 * buy_timing + 0.4 * buy_exhaustion_weighted"), 8)} AS hybrid_rank_local, {r(_cl("buy_timing * (0.35 + 0.65 * buy_exhaustion_weighted)"), 8)} AS hybrid_two_stage,
    {r(_null_phase("buy_phase * greatest(buy_timing, buy_exhaustion, buy_exhaustion_weighted)"), 8)} AS consensus FROM q1"""
)
def swing_scores(spark, sf_dir):
    return rounded_doubles(scored(spark, sf_dir).select("symbol", "date", *_SCORE_COLUMNS, "hybrid_balanced", "hybrid_rank_local", "hybrid_two_stage", "consensus"), 8)


def decided(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir).where(c("buy_phase").isNotNull()).select("symbol", "date", c("buy_timing").alias("buy"), c("sell_timing").alias("sell"))
    split = metrics.chronological_split(rows)
    return rounded_doubles(scores.decisions(split, c("split") != "test").drop("split"), 8)


def signal_chain(spark, sf_dir) -> DataFrame:
    return scores.signals(scores.rules(scores.translation(scores.playbook(decided(spark, sf_dir)))))


def _aged(source: str, target: str, state: str, name: str, keep: str = "*") -> str:
    return f"""
{target}_g AS (SELECT {keep}, CASE WHEN {state} IS NOT DISTINCT FROM lag({state}) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS chg FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY date)),
{target}_i AS (SELECT * EXCLUDE (chg), CAST(sum(chg) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {name}_run_id FROM {target}_g),
{target} AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, {name}_run_id ORDER BY date) AS BIGINT) AS {name}_age, count(*) OVER (PARTITION BY symbol, {name}_run_id) AS {name}_length FROM {target}_i)"""


DECISIONS = f"""
d0 AS (SELECT symbol, date, buy_timing AS buy, sell_timing AS sell, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n FROM q1 WHERE buy_phase IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date)),
dc AS (SELECT symbol, quantile_cont(buy, [0.6, 0.8]) AS bq, quantile_cont(sell, [0.6, 0.8]) AS sq FROM d0 WHERE i <= floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) GROUP BY 1),
d1 AS (SELECT d0.symbol, date, buy, sell, buy - sell AS raw_spread, bq[1] AS bm, bq[2] AS bh, sq[1] AS sm, sq[2] AS sh FROM d0 JOIN dc USING (symbol)),
d2 AS (SELECT symbol, date, {r("buy", 8)} AS buy, {r("sell", 8)} AS sell, {r("raw_spread", 8)} AS spread,
  CASE WHEN buy >= bh AND sell < sm AND raw_spread >= 0.1 THEN 'BUY_SETUP' WHEN sell >= sh AND buy < bm AND raw_spread <= -0.1 THEN 'SELL_SETUP' WHEN buy >= bm AND sell >= sm THEN 'CONFLICT_OVERLAP' WHEN buy < bm AND sell < sm THEN 'NEUTRAL_NO_EDGE' ELSE 'TRANSITION_UNCLEAR' END AS decision_state,
  {r(_cl("abs(raw_spread) * (0.5 + 0.5 * greatest(buy, sell))"), 8)} AS clarity, {r(_cl("least(buy, sell) * greatest(buy, sell)"), 8)} AS conflict, {r("buy * (1 - sell)", 8)} AS buy_dominance, {r("sell * (1 - buy)", 8)} AS sell_dominance,
  CASE WHEN buy >= bh THEN 'high' WHEN buy >= bm THEN 'moderate' ELSE 'low' END AS buy_band, CASE WHEN sell >= sh THEN 'high' WHEN sell >= sm THEN 'moderate' ELSE 'low' END AS sell_band FROM d1),
d3 AS (SELECT *, CASE WHEN buy_band = 'high' AND sell_band = 'high' THEN 'both_high' WHEN buy_band = 'high' THEN 'buy_high' WHEN sell_band = 'high' THEN 'sell_high' WHEN buy_band = 'low' AND sell_band = 'low' THEN 'both_low' ELSE 'mixed_moderate' END AS interaction_bucket FROM d2),{_aged("d3", "dec", "decision_state", "decision")}"""
PLAYBOOK = """
p0 AS (SELECT *, CASE WHEN decision_state = 'BUY_SETUP' AND clarity >= 0.25 AND conflict < 0.22 THEN 'ACCUMULATION_WATCH' WHEN decision_state = 'SELL_SETUP' AND clarity >= 0.25 AND conflict < 0.24 THEN 'DISTRIBUTION_WATCH'
   WHEN decision_state = 'CONFLICT_OVERLAP' THEN 'HIGH_CONFLICT' WHEN decision_state = 'NEUTRAL_NO_EDGE' THEN 'NO_ACTION' ELSE 'TRANSITION_WATCH' END AS playbook_label FROM dec),
pb AS (SELECT *, CASE playbook_label WHEN 'ACCUMULATION_WATCH' THEN 'buy_side' WHEN 'DISTRIBUTION_WATCH' THEN 'sell_side' WHEN 'HIGH_CONFLICT' THEN 'mixed' WHEN 'NO_ACTION' THEN 'neutral' ELSE
     CASE WHEN decision_state = 'BUY_SETUP' THEN 'buy_lean' WHEN decision_state = 'SELL_SETUP' THEN 'sell_lean' WHEN abs(spread) < 0.1 THEN 'mixed' WHEN buy > sell THEN 'buy_lean' ELSE 'sell_lean' END END AS playbook_bias,
   CASE WHEN playbook_label IN ('ACCUMULATION_WATCH', 'DISTRIBUTION_WATCH') THEN CASE WHEN clarity >= 0.3 AND conflict < 0.25 THEN 'high' ELSE 'medium' END WHEN playbook_label = 'HIGH_CONFLICT' THEN CASE WHEN conflict >= 0.25 THEN 'high' ELSE 'medium' END
     WHEN playbook_label = 'NO_ACTION' THEN CASE WHEN decision_age < 5 THEN 'low' ELSE 'very_low' END ELSE 'medium' END AS attention,
   CASE WHEN decision_age <= 1 THEN 'early' WHEN decision_length >= 4 AND decision_age >= greatest(3, ceil(decision_length * 0.65)) THEN 'mature' ELSE 'developing' END AS maturity FROM p0)"""
TRANSLATION = f"""
r0 AS (SELECT *, CASE WHEN playbook_label = 'ACCUMULATION_WATCH' AND attention = 'high' AND clarity >= 0.3 AND conflict <= 0.22 AND spread >= 0.15 THEN 'LONG_CONTEXT_ACTIVE' WHEN playbook_label = 'DISTRIBUTION_WATCH' AND attention = 'high' AND clarity >= 0.3 AND conflict <= 0.24 AND spread <= -0.15 THEN 'SELL_CONTEXT_ACTIVE'
   WHEN playbook_label = 'HIGH_CONFLICT' THEN 'STAND_ASIDE_CONFLICT' WHEN playbook_label = 'NO_ACTION' THEN 'STAND_ASIDE_NO_EDGE' ELSE 'WAIT_CONFIRMATION' END AS raw FROM pb),
r1 AS (SELECT *, CASE WHEN raw = 'LONG_CONTEXT_ACTIVE' THEN 'long_side' WHEN raw = 'SELL_CONTEXT_ACTIVE' THEN 'sell_side' WHEN playbook_label = 'ACCUMULATION_WATCH' THEN 'long_lean' WHEN playbook_label = 'DISTRIBUTION_WATCH' THEN 'sell_lean' WHEN playbook_label = 'HIGH_CONFLICT' THEN 'mixed' WHEN playbook_label = 'NO_ACTION' THEN 'neutral'
   WHEN spread >= 0.15 AND clarity >= 0.2 AND conflict < 0.3 THEN 'long_lean' WHEN spread <= -0.15 AND clarity >= 0.2 AND conflict < 0.3 THEN 'sell_lean' ELSE 'mixed' END AS raw_bias FROM r0),
r2 AS (SELECT *, coalesce(lag(CASE WHEN raw LIKE 'STAND_ASIDE%' THEN 'neutral' ELSE raw_bias END) OVER (PARTITION BY symbol ORDER BY date), 'neutral') AS before FROM r1),
r3 AS (SELECT *, before IN ('long_side', 'sell_side', 'long_lean', 'sell_lean') AND raw LIKE 'STAND_ASIDE%' AS faded, (before LIKE 'long%' AND raw = 'SELL_CONTEXT_ACTIVE') OR (before LIKE 'sell%' AND raw = 'LONG_CONTEXT_ACTIVE') AS flipped FROM r2),
r4 AS (SELECT * EXCLUDE (raw, raw_bias, before, faded, flipped), CASE WHEN faded THEN 'CONTEXT_INVALIDATED' ELSE raw END AS operational_state, CASE WHEN faded THEN CASE WHEN raw = 'STAND_ASIDE_CONFLICT' THEN 'mixed' ELSE 'neutral' END ELSE raw_bias END AS operational_bias,
   CAST(raw IN ('LONG_CONTEXT_ACTIVE', 'SELL_CONTEXT_ACTIVE') AS INT) AS readiness, CAST(faded OR flipped AS INT) AS invalidated, CAST(faded OR flipped OR raw = 'STAND_ASIDE_CONFLICT' AS INT) AS caution, CAST(faded OR raw = 'STAND_ASIDE_CONFLICT' AS INT) AS stand_aside FROM r3),{_aged("r4", "tr", "operational_state", "operational")}"""
RULES = """
u0 AS (SELECT *, CASE WHEN invalidated = 1 OR operational_state = 'CONTEXT_INVALIDATED' THEN 'INVALIDATED' WHEN stand_aside = 1 OR operational_state = 'STAND_ASIDE_CONFLICT' THEN 'BLOCKED_BY_CONFLICT' WHEN operational_state = 'STAND_ASIDE_NO_EDGE' THEN 'BLOCKED_NO_EDGE'
   WHEN operational_state = 'LONG_CONTEXT_ACTIVE' AND readiness = 1 AND caution = 0 AND operational_bias = 'long_side' THEN 'LONG_ELIGIBLE' WHEN operational_state = 'SELL_CONTEXT_ACTIVE' AND readiness = 1 AND caution = 0 AND operational_bias = 'sell_side' THEN 'SELL_ELIGIBLE' ELSE 'AWAIT_CONFIRMATION' END AS rule_state FROM tr),
ru AS (SELECT *, CAST(rule_state = 'LONG_ELIGIBLE' AS INT) AS long_permission, CAST(rule_state = 'SELL_ELIGIBLE' AS INT) AS sell_permission, CAST(rule_state = 'AWAIT_CONFIRMATION' AS INT) AS confirmation_pending, CAST(rule_state = 'INVALIDATED' AS INT) AS invalidation_active,
   CAST(rule_state IN ('INVALIDATED', 'BLOCKED_BY_CONFLICT', 'BLOCKED_NO_EDGE') AS INT) AS blocked FROM u0)"""
SIGNALS = f"""
v0 AS (SELECT *, CASE WHEN long_permission = 1 THEN 'long' WHEN sell_permission = 1 THEN 'sell' END AS side FROM ru),
v1 AS (SELECT *, lag(side) OVER w AS held, max(long_permission) OVER e AS was_long, max(sell_permission) OVER e AS was_sell FROM v0 WINDOW w AS (PARTITION BY symbol ORDER BY date), e AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v2 AS (SELECT *, invalidation_active = 1 AND held IS NOT NULL AS broken, side IS NOT NULL AND side IS DISTINCT FROM held AS fresh FROM v1),
v3 AS (SELECT * EXCLUDE (side, held, was_long, was_sell, broken, fresh), CASE WHEN broken THEN 'SIGNAL_INVALIDATED' WHEN fresh THEN upper(side) || '_SIGNAL_NEW' WHEN side IS NOT NULL THEN upper(side) || '_SIGNAL_ACTIVE' ELSE 'NO_SIGNAL' END AS signal_state, CASE WHEN broken THEN held ELSE coalesce(side, 'none') END AS signal_side,
   CAST(fresh AS INT) AS signal_new, CAST(side IS NOT NULL AND NOT fresh AS INT) AS signal_continued, CAST(fresh AND coalesce(CASE side WHEN 'long' THEN was_long ELSE was_sell END, 0) = 1 AS INT) AS signal_reactivated, CAST(side IS NOT NULL AS INT) AS signal_active, coalesce(side, 'inactive') AS context FROM v2),{_aged("v3", "v4", "context", "context")},
v5 AS (SELECT * EXCLUDE (context_age, context_length, context), CASE WHEN signal_active = 1 THEN context_age ELSE 0 END AS context_age, CASE WHEN signal_active = 1 THEN context_length ELSE 0 END AS context_length FROM v4),{_aged("v5", "sg", "signal_state", "signal")}"""
CHAIN = f"{DATASET},{SCORES},{DECISIONS},{PLAYBOOK},{TRANSLATION},{RULES},{SIGNALS}"


def _longs(df: DataFrame) -> DataFrame:
    """Run columns as long, as SQL counts them."""
    return df.select(*[c(n).cast("long").alias(n) if n.endswith(("_run_id", "_age", "_length")) else c(n) for n in df.columns])


@query(f"WITH RECURSIVE {DATASET},{SCORES},{DECISIONS} SELECT * FROM dec")
def decision_layer(spark, sf_dir):
    return _longs(decided(spark, sf_dir))


@query(f"WITH RECURSIVE {DATASET},{SCORES},{DECISIONS},{PLAYBOOK} SELECT symbol, date, playbook_label, playbook_bias, attention, maturity FROM pb")
def playbook_layer(spark, sf_dir):
    return scores.playbook(decided(spark, sf_dir)).select("symbol", "date", "playbook_label", "playbook_bias", "attention", "maturity")


_RULE_COLUMNS = ["operational_state", "operational_bias", "readiness", "invalidated", "caution", "stand_aside", "operational_age", "operational_length", "rule_state", "long_permission", "sell_permission", "confirmation_pending", "invalidation_active", "blocked"]


@query(f"WITH RECURSIVE {DATASET},{SCORES},{DECISIONS},{PLAYBOOK},{TRANSLATION},{RULES} SELECT symbol, date, {', '.join(_RULE_COLUMNS)} FROM ru")
def rule_layer(spark, sf_dir):
    return _longs(scores.rules(scores.translation(scores.playbook(decided(spark, sf_dir)))).select("symbol", "date", *_RULE_COLUMNS))


_SIGNAL_COLUMNS = ["signal_state", "signal_side", "signal_new", "signal_continued", "signal_reactivated", "signal_active", "context_age", "context_length", "signal_age", "signal_length"]


@query(f"WITH RECURSIVE {CHAIN} SELECT symbol, date, {', '.join(_SIGNAL_COLUMNS)} FROM sg")
def signal_layer(spark, sf_dir):
    return _longs(signal_chain(spark, sf_dir).select("symbol", "date", *_SIGNAL_COLUMNS))


@query(f"WITH RECURSIVE {CHAIN} SELECT signal_state AS state, count(*) AS n, count(*) FILTER (WHERE signal_age = 1) AS runs, {r('count(*) / sum(count(*)) OVER ()')} AS share, {r('count(*) / count(*) FILTER (WHERE signal_age = 1)')} AS mean_run_length FROM sg GROUP BY 1")
def signal_summary(spark, sf_dir):
    return rounded_doubles(scores.state_summary(signal_chain(spark, sf_dir), "signal_state", "signal"))


@query(f"WITH RECURSIVE {CHAIN} SELECT decision_state, count(*) FILTER (WHERE rule_state = 'AWAIT_CONFIRMATION') AS await, count(*) FILTER (WHERE rule_state LIKE 'BLOCKED%') AS blocked, count(*) FILTER (WHERE rule_state LIKE '%ELIGIBLE') AS eligible FROM sg GROUP BY 1")
def decision_by_rule(spark, sf_dir):
    """Cross-tab of decision and rule states, pivoted."""
    kind = F.when(c("rule_state").startswith("BLOCKED"), "blocked").when(c("rule_state").endswith("ELIGIBLE"), "eligible").when(c("rule_state") == "AWAIT_CONFIRMATION", "await")
    wide = signal_chain(spark, sf_dir).withColumn("kind", kind).groupBy("decision_state").pivot("kind", ["await", "blocked", "eligible"]).count()
    return wide.fillna(0)


# ----------------------------------------------------------------- analogs


def analog_rows(spark, sf_dir) -> DataFrame:
    x = dataset(spark, sf_dir)
    return x.withColumns({"vector": similarity.analog_vector(), "way": F.coalesce("live_swing_direction", F.lit("unknown"))} | similarity.outcomes())


@query(
    f"""WITH RECURSIVE {DATASET},
    a0 AS (SELECT symbol, date, row_number() OVER w AS i, coalesce(live_swing_direction, 'unknown') AS way, [{_VECTOR}] AS v, max(high) OVER f >= close * 1.05 AS h5, max(high) OVER f >= close * 1.03 AS h3, close, list(high) OVER f AS hs FROM ds WINDOW w AS (PARTITION BY symbol ORDER BY date), f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
    a1 AS (SELECT symbol, date, i, way, h5, h3, list_position(list_transform(hs, lambda h: h >= close * 1.05), true) AS d, CASE WHEN len(list_filter(v, lambda x: x IS NULL)) = 0 THEN v END AS v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv FROM a0),
    pr AS (SELECT a.symbol, a.date, b.i AS bi, CAST(b.h5 AS INT) AS h5, CAST(b.h3 AS INT) AS h3, nullif(b.d, 0) AS d, list_dot_product(a.v, b.v) / (a.nv * b.nv + 1e-12) AS s FROM a1 a JOIN a1 b ON b.symbol = a.symbol AND b.i < a.i AND b.way = 'down' AND b.h5 IS NOT NULL AND b.nv > 0 AND b.v IS NOT NULL WHERE a.nv > 0 AND a.v IS NOT NULL),
    tk AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY s DESC, bi DESC) AS rk, max(s) OVER (PARTITION BY symbol, date) AS ms FROM pr), wt AS (SELECT *, exp((s - ms) / 0.15) AS w FROM tk WHERE rk <= 40),
    md AS (SELECT symbol, date, min(d) AS m FROM (SELECT symbol, date, d, sum(w) OVER (PARTITION BY symbol, date ORDER BY d RANGE UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY symbol, date) AS tot FROM wt WHERE d IS NOT NULL) WHERE run >= 0.5 * tot * (1 - 1e-12) GROUP BY 1, 2)
    SELECT wt.symbol, wt.date, {r("sum(w * h5) / sum(w)", 5)} AS analog_hit_5, {r("sum(w * h3) / sum(w)", 5)} AS analog_hit_3, CAST(any_value(md.m) AS DOUBLE) AS analog_days, CAST(count(*) AS INT) AS matches FROM wt LEFT JOIN md ON md.symbol = wt.symbol AND md.date = wt.date GROUP BY 1, 2"""
)
def buy_analogs(spark, sf_dir):
    return rounded_doubles(similarity.analogs(analog_rows(spark, sf_dir)), 5)


def _memory(vector: list[str], candidate: str, hits: dict[str, tuple[int, float]], temperature: float, k: int = 50) -> str:
    """SQL of ``memory_scores``: ``hits`` has the rows looked ahead and the weight of each outcome."""
    frames = ", ".join(f"f{h} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h, _ in hits.values())
    value = {n: f"sum(w * {n}) FILTER (WHERE {n} IS NOT NULL) / sum(w) FILTER (WHERE {n} IS NOT NULL)" for n in hits}
    return f"""WITH RECURSIVE {DATASET},
    a0 AS (SELECT symbol, date, row_number() OVER w AS i, {candidate} AS cand, [{", ".join(vector)}] AS v, {", ".join(f"CAST(max(high) OVER f{h} >= close * 1.05 AS INT) AS {n}" for n, (h, _) in hits.items())} FROM ds WINDOW w AS (PARTITION BY symbol ORDER BY date), {frames}),
    a1 AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nv FROM a0 WHERE len(list_filter(v, lambda x: x IS NULL)) = 0),
    pr AS (SELECT a.symbol, a.date, b.i AS bi, {", ".join(f"b.{n}" for n in hits)}, list_dot_product(a.v, b.v) / (a.nv * b.nv + 1e-12) AS s FROM a1 a JOIN a1 b ON b.symbol = a.symbol AND b.i < a.i AND b.cand AND b.nv > 0 WHERE a.nv > 0),
    tk AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY s DESC, bi DESC) AS rk, max(s) OVER (PARTITION BY symbol, date) AS ms FROM pr), wt AS (SELECT *, exp((s - ms) / {temperature}) AS w FROM tk WHERE rk <= {k}),
    g AS (SELECT symbol, date, count(*) AS n, {", ".join(f"{e} AS {n}" for n, e in value.items())} FROM wt GROUP BY 1, 2),
    h AS (SELECT symbol, date, n, ({" + ".join(f"coalesce({n} * {w}, 0)" for n, (_, w) in hits.items())}) / nullif({" + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w} ELSE 0 END" for n, (_, w) in hits.items())}, 0) AS score FROM g)
    SELECT symbol, date, {r("least(greatest(score, 0.0), 1.0)", 5)} AS score, CAST(n AS INT) AS matches FROM h WHERE score IS NOT NULL"""


def _lags(terms: list[str], n: int) -> list[str]:
    return [f"CAST(lag({x}, {k}) OVER w AS DOUBLE)" if k else f"CAST({x} AS DOUBLE)" for k in range(n) for x in terms]


@query(_memory([*_lags(_lagged, 7), *(f"CAST({x} AS DOUBLE)" for x in _STATE)], "coalesce(live_swing_direction = 'down', false)", {"hit_3": (3, 0.25), "hit_5": (5, 0.50), "hit_7": (7, 0.25)}, 0.08))
def buy_analog_horizons(spark, sf_dir):
    """Analogs over seven rows, by what followed within three, five and seven rows."""
    hits = {f"hit_{h}": similarity.outcomes(h)["hit_5"] for h in (3, 5, 7)}
    data = dataset(spark, sf_dir).withColumns(hits | {"vector": similarity.analog_vector(7), "candidate": F.coalesce(c("live_swing_direction") == "down", F.lit(False))})
    return rounded_doubles(similarity.memory_scores(data, {"hit_3": 0.25, "hit_5": 0.50, "hit_7": 0.25}, temperature=0.08), 5)


@query(_memory(_lags([*_lagged, "body_to_range_ratio"], 5), "max(high) OVER f5 IS NOT NULL", {"hit": (5, 1.0)}, 0.07))
def candle_memory(spark, sf_dir):
    """Candle patterns of five rows, by what followed within five rows."""
    data = dataset(spark, sf_dir).withColumns({"hit": similarity.outcomes(5)["hit_5"], "vector": similarity.candle_vector(5)}).withColumn("candidate", c("hit").isNotNull())
    return rounded_doubles(similarity.memory_scores(data, {"hit": 1.0}, temperature=0.07), 5)


def _intervals(metric: str, sql_distance: str | None) -> None:
    columns = ["r1", "close_in_range"]

    def run(spark, sf_dir):
        rows = sq.feature_store(spark, sf_dir).where(c("r1").isNotNull())
        windows = similarity.sequences(rows, columns, 5)
        found = similarity.similar_intervals(windows, "1-URGENT", 100, 5, metric, zone=10)
        return rounded_doubles(found)

    run.__name__ = f"similar_intervals_{metric}"
    sql = None
    if sql_distance:
        vector = ", ".join(f"lag({x}, {4 - k}) OVER w" if k < 4 else x for k in range(5) for x in columns)
        sql = f"""WITH {sf.features_cte()}, i0 AS (SELECT symbol, date, row_number() OVER w AS n, lag(date, 4) OVER w AS start_date, [{vector}] AS v FROM store WHERE r1 IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date)),
        win AS (SELECT symbol, n - 4 AS start_row, start_date, date AS end_date, v FROM i0 WHERE n >= 5 AND symbol = '1-URGENT'),
        cand AS (SELECT * FROM win WHERE (start_row + 5 <= 100 OR start_row >= 105) AND abs(start_row - 100) > 10),
        st AS (SELECT p, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT generate_subscripts(v, 1) AS p, unnest(v) AS x FROM cand) GROUP BY p), sl AS (SELECT list(m ORDER BY p) AS ms, list(CASE WHEN s > 0 THEN s ELSE 1.0 END ORDER BY p) AS ss FROM st),
        z AS (SELECT start_row, start_date, end_date, list_transform(v, lambda x, i: (x - ms[i]) / ss[i]) AS v FROM win, sl), q AS (SELECT v AS qv, start_date AS qd FROM z WHERE start_row = 100),
        d AS (SELECT z.start_row, z.start_date, z.end_date, {sql_distance} AS distance, abs(z.start_date - qd) AS gap FROM z JOIN cand USING (start_row), q), t AS (SELECT quantile_cont(distance, 0.5) AS tau FROM d)
        SELECT '1-URGENT' AS symbol, CAST(start_row AS INT) AS start_row, start_date, end_date, {r("distance")} AS distance, {r("exp(-distance / tau)")} AS similarity, CAST(gap AS INT) AS gap_days FROM d, t"""
    query(sql)(run)


_intervals("euclidean", "list_distance(z.v, qv)")
_intervals("cosine", "1 - list_dot_product(z.v, qv) / (sqrt(list_dot_product(z.v, z.v)) * sqrt(list_dot_product(qv, qv)) + 1e-12)")
_intervals("mahalanobis", None)

# ------------------------------------------------------------------- audit

_TARGETS = ["ret_10d", "max_up_10d", "max_down_10d", "touch_up_2pct_10d", "touch_down_2pct_10d"]


def conditioned(spark, sf_dir) -> DataFrame:
    goals = rounded_doubles(targets.targets(src.order_bars(spark, sf_dir)).select("symbol", "date", *_TARGETS))
    return audit.with_conditions(dataset(spark, sf_dir)).join(goals, ["symbol", "date"])


def _quantile_columns() -> str:
    return ", ".join(f"quantile_cont({n}, {v}) AS {n}_{q}" for n in audit.condition_columns() for q, v in audit.CUTS.items())


CONDITIONS = f"""{DATASET},{sq.TARGETS}, ab AS (SELECT *, abs(TS_20) AS abs_TS_20 FROM ds), qs AS (SELECT symbol, {_quantile_columns()} FROM ab GROUP BY 1),
cd AS (SELECT ab.symbol, ab.date, {", ".join(f"coalesce({audit.condition_sql(n)}, false) AS {n}" for n in audit.CONDITIONS)} FROM ab JOIN qs USING (symbol)),
cl AS ({" UNION ALL ".join(f"SELECT '{n}' AS condition, symbol, date, {n} AS met FROM cd" for n in audit.CONDITIONS)})"""


@query(f"WITH RECURSIVE {CONDITIONS} SELECT symbol, date, {', '.join(audit.CONDITIONS)} FROM cd")
def condition_flags(spark, sf_dir):
    return audit.with_conditions(dataset(spark, sf_dir)).select("symbol", "date", *audit.CONDITIONS)


_CSTATS = f"""cs AS (SELECT condition, t.target, count(*) FILTER (WHERE met) AS sample_count, avg(CAST(met AS DOUBLE)) AS coverage, avg(v) FILTER (WHERE met) AS mean, median(v) FILTER (WHERE met) AS median, avg(v) FILTER (WHERE met) - avg(v) FILTER (WHERE NOT met) AS separation,
    CASE WHEN t.target LIKE 'ret!_%' ESCAPE '!' THEN avg(CAST(v > 0 AS DOUBLE)) FILTER (WHERE met) END AS win_rate, CASE WHEN t.target LIKE 'touch!_%' ESCAPE '!' THEN avg(v) FILTER (WHERE met) END AS event_rate
    FROM cl JOIN ({" UNION ALL ".join(f"SELECT symbol, date, '{t}' AS target, {t} AS v FROM tgts" for t in _TARGETS)}) t USING (symbol, date) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {CONDITIONS},{_CSTATS} SELECT condition, target, sample_count, {', '.join(f'{r(n, 11)} AS {n}' for n in ('coverage', 'mean', 'median', 'separation', 'win_rate', 'event_rate'))} FROM cs")
def condition_statistics(spark, sf_dir):
    # means of few values with eight decimals often lie on a tie at six
    return rounded_doubles(audit.condition_stats(conditioned(spark, sf_dir), _TARGETS), 11)


_pr = lambda n: f"CASE WHEN {n} IS NOT NULL THEN (rank() OVER (PARTITION BY {n} IS NULL ORDER BY {n}) + (count({n}) OVER (PARTITION BY {n}) - 1) / 2.0) / count({n}) OVER () END"


@query(
    f"""WITH RECURSIVE {CONDITIONS},{_CSTATS}, w0 AS (SELECT condition, any_value(sample_count) AS sample_count, max(round(mean, 6)) FILTER (WHERE target = 'ret_10d') AS ret, max(round(mean, 6)) FILTER (WHERE target = 'max_up_10d') AS up, max(round(mean, 6)) FILTER (WHERE target = 'max_down_10d') AS down,
    max(round(event_rate, 6)) FILTER (WHERE target = 'touch_up_2pct_10d') AS tu, max(round(event_rate, 6)) FILTER (WHERE target = 'touch_down_2pct_10d') AS td FROM cs GROUP BY 1), w1 AS (SELECT *, {", ".join(f"{_pr(n)} AS p_{n}" for n in ("ret", "up", "down", "tu", "td"))}, least(sample_count, 75) / 75.0 AS wt FROM w0)
    SELECT condition, sample_count, {r("(p_ret + p_up + p_tu + p_down + (1 - p_td)) / 5 * wt")} AS overall_rank_score, {r("(p_ret + p_up + p_tu) / 3 * wt")} AS upside_rank_score, {r("(p_down + (1 - p_td) + p_ret) / 3 * wt")} AS downside_rank_score FROM w1"""
)
def condition_ranking(spark, sf_dir):
    return rounded_doubles(audit.condition_ranks(rounded_doubles(audit.condition_stats(conditioned(spark, sf_dir), _TARGETS))))


@query(
    f"""WITH RECURSIVE {CONDITIONS},{sq.TAXONOMY},{sq.CONTAINING} SELECT condition, count(*) AS n, {r("avg(CAST(t.direction = 'up' AS DOUBLE))")} AS up_rate, {r("avg(CAST(size_class = 'large' AS DOUBLE))")} AS large_rate, {r("avg(CAST(duration_class = 'long' AS DOUBLE))")} AS long_rate,
    {r("avg(CAST(stage_pct <= 1.0/3 AS DOUBLE))")} AS early_rate, {r("avg(CAST(stage_pct > 1.0/3 AND stage_pct <= 2.0/3 AS DOUBLE))")} AS mid_rate, {r("avg(CAST(stage_pct > 2.0/3 AS DOUBLE))")} AS late_rate
    FROM cl JOIN cont USING (symbol, date) JOIN tax t ON t.symbol = cl.symbol AND t.start_date = cont.start_date AND t.end_date = cont.end_date WHERE met GROUP BY 1"""
)
def condition_bridge(spark, sf_dir):
    bars = src.order_bars(spark, sf_dir)
    tax = swings.taxonomy(swings.zigzag(swings.with_atr(bars)))
    inside = swings.containing(bars.select("symbol", "date"), tax).join(tax.select("symbol", "start_date", "end_date", "size_class", "duration_class"), ["symbol", "start_date", "end_date"])
    return rounded_doubles(audit.bridge(audit.with_conditions(dataset(spark, sf_dir)), inside))


_BRIDGE_COLUMNS = ", ".join(f"quantile_cont({n}, {v}) AS {n}_{q}" for n in audit.condition_columns(audit.BRIDGE) for q, v in audit.CUTS.items())
_rate = lambda test, of="d IS NOT NULL": f"avg(CAST(coalesce({test}, false) AS DOUBLE)) FILTER (WHERE {of})"
_MAP = {"swing_up_rate": _rate("d = 'up'"), "swing_down_rate": _rate("d = 'down'")}
_MAP |= {f"{v}_swing_rate": _rate(f"size_class = '{v}'") for v in ("small", "medium", "large")} | {f"{n}_rate": _rate(f"duration_class = '{v}'") for v, n in (("short", "short_swing"), ("medium", "medium_duration"), ("long", "long_swing"))}
_MAP |= {f"{way}_{v}_stage_rate": _rate(f"stage = '{v}'", f"stage IS NOT NULL AND d = '{way}'") for way in ("up", "down") for v in ("early", "mid", "late")}
MAPPING = f"""{DATASET},{sq.TAXONOMY},{sq.CONTAINING}, ab AS (SELECT *, abs(TS_20) AS abs_TS_20 FROM ds), qs AS (SELECT symbol, {_BRIDGE_COLUMNS} FROM ab GROUP BY 1),
cd AS (SELECT ab.symbol, ab.date, {", ".join(f"coalesce({audit.condition_sql(n, audit.BRIDGE)}, false) AS {n}" for n in audit.BRIDGE)} FROM ab JOIN qs USING (symbol)),
cl AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT '{n}' AS condition, symbol, date, {n} AS met FROM cd" for n in audit.BRIDGE)}) WHERE met),
ins AS (SELECT cont.symbol, cont.date, t.direction AS d, abs(t.amplitude_pct) AS a, t.duration_days AS n, size_class, duration_class, CASE WHEN stage_pct <= 1.0/3 THEN 'early' WHEN stage_pct <= 2.0/3 THEN 'mid' ELSE 'late' END AS stage
        FROM cont JOIN tax t ON t.symbol = cont.symbol AND t.start_date = cont.start_date AND t.end_date = cont.end_date),
nxt AS (SELECT b.symbol, b.date, t.direction AS d, abs(t.amplitude_pct) AS a, t.duration_days AS n, size_class, duration_class, CAST(NULL AS VARCHAR) AS stage FROM ds b ASOF JOIN tax t ON t.symbol = b.symbol AND b.date < t.start_date),
maps AS (SELECT mode, condition, count(*) AS sample_count, count(d) AS mapped, median(a) AS median_swing_abs_amplitude, median(CAST(n AS DOUBLE)) AS median_swing_duration_days, {", ".join(f"{e} AS {n}" for n, e in _MAP.items())}
         FROM (SELECT 'containing' AS mode, cl.condition, ins.* FROM cl LEFT JOIN ins ON ins.symbol = cl.symbol AND ins.date = cl.date UNION ALL SELECT 'next', cl.condition, nxt.* FROM cl LEFT JOIN nxt ON nxt.symbol = cl.symbol AND nxt.date = cl.date) GROUP BY 1, 2)"""


def condition_maps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """How conditions map to the swings that contain their rows, and to the next ones."""
    bars = sq.bar_store(spark, sf_dir)
    tax = swings.taxonomy(swings.zigzag(swings.with_atr(bars)))
    rows = audit.with_conditions(dataset(spark, sf_dir), audit.BRIDGE)
    kinds = ["direction", "abs_amplitude_pct", "duration_days", "size_class", "duration_class"]
    days = bars.select("symbol", "date")
    inside = swings.containing(days, tax).select("symbol", "date", "start_date", "end_date", "stage").join(tax.select("symbol", "start_date", "end_date", *kinds), ["symbol", "start_date", "end_date"]).select("symbol", "date", *kinds, "stage")
    later = swings.next_swing(days, tax).select("symbol", "date", c("next_start").alias("start_date")).join(tax.select("symbol", "start_date", *kinds), ["symbol", "start_date"])
    return audit.condition_map(rows, inside), audit.condition_map(rows, later.select("symbol", "date", *kinds, F.lit(None).cast("string").alias("stage")))


@query(f"WITH RECURSIVE {MAPPING} SELECT mode, condition, sample_count, mapped, {', '.join(f'{r(n, 11)} AS {n}' for n in ('median_swing_abs_amplitude', 'median_swing_duration_days', *_MAP))} FROM maps")
def condition_mapping(spark, sf_dir):
    inside, later = condition_maps(spark, sf_dir)
    return rounded_doubles(inside.withColumn("mode", F.lit("containing")).unionByName(later.withColumn("mode", F.lit("next"))), 11)


_STAGES = ("early", "mid", "late")
_SHARED = ("mapped", "swing_up_rate", "swing_down_rate", "large_swing_rate")


@query(
    f"""WITH RECURSIVE {MAPPING}, m AS (SELECT a.condition, {", ".join(f"a.{n} AS {n}_containing, b.{n} AS {n}_next" for n in _SHARED)}, {", ".join(f"a.up_{s}_stage_rate" for s in _STAGES)}
    FROM maps a JOIN maps b ON a.condition = b.condition AND a.mode = 'containing' AND b.mode = 'next' WHERE a.mapped >= 25 AND b.mapped >= 25)
    SELECT condition, mapped_containing, mapped_next, {", ".join(f"{r(n, 11)} AS {n}" for n in [f"{x}_{m}" for x in _SHARED[1:] for m in ("containing", "next")] + [f"up_{s}_stage_rate" for s in _STAGES])},
           {r("greatest(up_early_stage_rate, up_mid_stage_rate, up_late_stage_rate) - abs(swing_up_rate_next - swing_down_rate_next)", 11)} AS maturity_gap,
           list_max([{", ".join(f"{{'share': coalesce(up_{s}_stage_rate, -1.0), 'stage': '{s}'}}" for s in _STAGES)}]).stage AS dominant_stage FROM m"""
)
def condition_containing_next(spark, sf_dir):
    """Conditions that tell a swing's maturity rather than the next swing."""
    return rounded_doubles(audit.containing_next(*condition_maps(spark, sf_dir)), 11)


_INDICATORS = ["TS_50", "ER_20", "band_pos", "atr_pct"]


def _pairs(spark, sf_dir) -> DataFrame:
    goals = rounded_doubles(targets.targets(src.order_bars(spark, sf_dir)).select("symbol", "date", "ret_10d", "touch_up_2pct_10d"))
    return sq.feature_store(spark, sf_dir).join(goals, ["symbol", "date"])


RELIABILITY = f"""{sf.features_cte()},{sq.TARGETS}, fl AS ({" UNION ALL ".join(f"SELECT symbol, date, '{i}' AS indicator, '{t}' AS target, {i} AS x, {t} AS y FROM store JOIN tgts USING (symbol, date)" for i in _INDICATORS for t in ("ret_10d", "touch_up_2pct_10d"))}),
rk AS (SELECT *, row_number() OVER (PARTITION BY indicator, target ORDER BY x, date, symbol) AS rn, count(*) OVER (PARTITION BY indicator, target) AS n FROM fl WHERE x IS NOT NULL AND y IS NOT NULL),
bk AS (SELECT *, greatest((5 * (rn - 1) + n - 2) // greatest(n - 1, 1) - 1, 0) AS bucket FROM rk)"""
_BUCKETS = f"SELECT indicator, target, CAST(bucket AS BIGINT) AS bucket, count(*) AS n, {r('min(x)')} AS x_min, {r('max(x)')} AS x_max, {r('avg(x)')} AS x_mean, {r('avg(y)')} AS y_mean, {r('median(y)')} AS y_median, {r('avg(CAST(y > 0 AS DOUBLE))')} AS win_rate FROM bk GROUP BY 1, 2, 3"


@query(f"WITH {RELIABILITY} {_BUCKETS}")
def indicator_reliability(spark, sf_dir):
    return rounded_doubles(audit.reliability(_pairs(spark, sf_dir), _INDICATORS, ["ret_10d", "touch_up_2pct_10d"]))


_ar = lambda x, by: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


@query(f"WITH {RELIABILITY}, rr AS (SELECT *, {_ar('x', 'indicator, target')} AS rx, {_ar('y', 'indicator, target')} AS ry FROM rk) SELECT indicator, target, {r('corr(x, y)')} AS pearson, {r('corr(rx, ry)')} AS spearman FROM rr GROUP BY 1, 2")
def indicator_correlation(spark, sf_dir):
    return rounded_doubles(audit.spearman(audit.bucketed(_pairs(spark, sf_dir), _INDICATORS, ["ret_10d", "touch_up_2pct_10d"]), ["indicator", "target"]))


@query(f"WITH {RELIABILITY}, bb AS ({_BUCKETS}), rr AS (SELECT *, {_ar('bucket', 'indicator, target')} AS rx, {_ar('y_mean', 'indicator, target')} AS ry FROM bb) SELECT indicator, target, {r('corr(rx, ry)')} AS monotonicity, {r('arg_max(y_mean, bucket) - arg_min(y_mean, bucket)')} AS top_minus_bottom FROM rr GROUP BY 1, 2")
def indicator_monotonicity(spark, sf_dir):
    buckets = rounded_doubles(audit.reliability(_pairs(spark, sf_dir), _INDICATORS, ["ret_10d", "touch_up_2pct_10d"]))
    return rounded_doubles(audit.monotonicity(buckets))


_EDGES = [0, 0.02, 0.05, 0.1, 0.2, 0.5, 1e9]


@query(f"WITH RECURSIVE {sq.ZIGZAG}, bins AS (SELECT unnest([{', '.join(str(i) for i in range(len(_EDGES) - 1))}]) AS bucket, unnest([{', '.join(repr(float(x)) for x in _EDGES[:-1])}]) AS low, unnest([{', '.join(repr(float(x)) for x in _EDGES[1:])}]) AS high) SELECT CAST(bucket AS INT) AS bucket, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(symbol) AS n FROM bins LEFT JOIN sw ON abs(amplitude_pct) >= low AND abs(amplitude_pct) < high GROUP BY 1, 2, 3")
def swing_histogram(spark, sf_dir):
    found = swings.zigzag(sq.ranged(spark, sf_dir)).withColumn("size", F.abs("amplitude_pct"))
    return audit.histogram(found, "size", _EDGES)


# ----------------------------------------------------------------- metrics


def judged(spark, sf_dir) -> DataFrame:
    """Buy timing against the five percent zone, split by time."""
    bars = src.order_bars(spark, sf_dir)
    zones = swings.zone_labels(bars, swings.zigzag(swings.with_atr(bars))).select("symbol", "date", c("buy_zone_5pct").alias("label"))
    rows = scored(spark, sf_dir).where(c("buy_phase").isNotNull()).select("symbol", "date", c("buy_timing").alias("score"), c("buy_phase").alias("other"))
    return metrics.chronological_split(rows.join(zones, ["symbol", "date"]))


JUDGED = f"""{DATASET},{SCORES}, jd AS (SELECT q.symbol, q.date, buy_timing AS score, buy_phase AS other, CAST(coalesce(zd.direction = 'down' AND distance <= 0.05, false) AS INT) AS label, row_number() OVER (PARTITION BY q.symbol ORDER BY q.date) AS i, count(*) OVER (PARTITION BY q.symbol) AS n
   FROM q1 q LEFT JOIN zd ON zd.symbol = q.symbol AND zd.date = q.date WHERE buy_phase IS NOT NULL),
ju AS (SELECT *, CASE WHEN i <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN i <= floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM jd)"""
_cs = "least(greatest(score, 1e-6), 1 - 1e-6)"


@query(
    f"""WITH RECURSIVE {JUDGED}, rk AS (SELECT *, {_ar("score", "split")} AS rr FROM ju), st AS (SELECT split, score, sum(label) AS pos, count(*) AS al FROM ju GROUP BY 1, 2), rn AS (SELECT *, sum(pos) OVER w AS cp, sum(al) OVER w AS ca FROM st WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    ap AS (SELECT split, sum(pos * cp / ca) / sum(pos) AS ap FROM rn GROUP BY 1), b AS (SELECT split, count(*) AS n, avg(label) AS prevalence, (sum(rr * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS roc, avg((score - label) * (score - label)) AS brier, -avg(label * ln({_cs}) + (1 - label) * ln(1 - {_cs})) AS ll,
      coalesce(sum(label) FILTER (WHERE score >= 0.5) / count(*) FILTER (WHERE score >= 0.5), 0.0) AS pr, coalesce(sum(label) FILTER (WHERE score >= 0.5), 0) / sum(label) AS rc FROM rk GROUP BY 1)
    SELECT split, n, {r("prevalence")} AS prevalence, {r("roc")} AS roc_auc, {r("brier")} AS brier, {r("ll")} AS log_loss, {r("pr")} AS precision, {r("rc")} AS recall, {r("CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END")} AS f1, {r("ap")} AS average_precision FROM b JOIN ap USING (split)"""
)
def score_metrics(spark, sf_dir):
    return rounded_doubles(metrics.classification(judged(spark, sf_dir), ["split"]))


@query(
    f"""WITH RECURSIVE {JUDGED}, e AS (SELECT split, list_sort(list_distinct(quantile_cont(score, [{", ".join(repr(i / 10) for i in range(11))}]))) AS e FROM ju GROUP BY 1)
    SELECT split, CAST(len(list_filter(e[2:len(e) - 1], lambda v: score > v)) AS INT) AS bin, count(*) AS n, {r("avg(score)")} AS mean_score, {r("avg(label)")} AS event_rate FROM ju JOIN e USING (split) GROUP BY 1, 2"""
)
def score_calibration(spark, sf_dir):
    return rounded_doubles(metrics.calibration_table(judged(spark, sf_dir), ["split"]))


@query(f"WITH RECURSIVE {JUDGED}, t AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, symbol, date) AS o, count(*) OVER (PARTITION BY split) AS m FROM ju) SELECT split, count(*) AS n, {r('avg(label)')} AS hit_rate FROM t WHERE o <= greatest(1, ceil(m * 0.1::DOUBLE)) GROUP BY 1")
def score_top_share(spark, sf_dir):
    return rounded_doubles(metrics.top_share(judged(spark, sf_dir), ["split"], 0.1).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("hit_rate")))


@query(f"WITH RECURSIVE {JUDGED} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE score >= t) AS selected, {r('avg(CAST(score >= t AS DOUBLE))')} AS share, {r('avg(label) FILTER (WHERE score >= t)')} AS hit_rate FROM ju, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t) GROUP BY 1")
def score_thresholds(spark, sf_dir):
    return rounded_doubles(metrics.threshold_grid(judged(spark, sf_dir), [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))


def in_swings(spark, sf_dir) -> DataFrame:
    bars = src.order_bars(spark, sf_dir)
    found = swings.zigzag(swings.with_atr(bars))
    zones = swings.zone_labels(bars, found).select("symbol", "date", "distance")
    inside = swings.containing(bars.select("symbol", "date"), found).where("direction = 'down'").select("symbol", "date", "start_date")
    return judged(spark, sf_dir).join(inside, ["symbol", "date"]).join(rounded_doubles(zones), ["symbol", "date"])


IN_SWINGS = f"{JUDGED}, js AS (SELECT ju.*, cont.start_date, round(zd.distance, 6) AS distance FROM ju JOIN cont ON cont.symbol = ju.symbol AND cont.date = ju.date AND cont.direction = 'down' JOIN zd ON zd.symbol = ju.symbol AND zd.date = ju.date)"


@query(f"WITH RECURSIVE {IN_SWINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol, start_date ORDER BY score DESC, date) AS o FROM js) SELECT symbol, start_date, date, {r('score')} AS score, distance + 0.0 AS distance FROM o WHERE o = 1")
def swing_best_row(spark, sf_dir):
    return rounded_doubles(metrics.best_per_swing(in_swings(spark, sf_dir)).select("symbol", "start_date", "date", "score", "distance"))


@query(f"WITH RECURSIVE {IN_SWINGS}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol, start_date ORDER BY other DESC, date) AS o, count(*) OVER (PARTITION BY symbol, start_date) AS m FROM js), p AS (SELECT *, row_number() OVER (PARTITION BY symbol, start_date ORDER BY score DESC, date) AS q FROM o WHERE o <= ceil(m * 0.4::DOUBLE)) SELECT symbol, start_date, date, {r('score')} AS score FROM p WHERE q = 1")
def swing_two_stage_row(spark, sf_dir):
    return rounded_doubles(metrics.two_stage_best(in_swings(spark, sf_dir), "other", "score").select("symbol", "start_date", "date", "score"))


@query(f"WITH RECURSIVE {IN_SWINGS}, per AS (SELECT symbol, start_date, max(CAST(score >= 0.6 AS INT)) AS hit, arg_min(distance, date) FILTER (WHERE score >= 0.6) AS first_at FROM js GROUP BY 1, 2) SELECT symbol, count(*) AS swings, CAST(sum(hit) AS BIGINT) AS captured, {r('avg(first_at)')} AS mean_first_distance FROM per GROUP BY 1")
def swing_capture(spark, sf_dir):
    return rounded_doubles(metrics.capture(in_swings(spark, sf_dir), c("score") >= 0.6))
