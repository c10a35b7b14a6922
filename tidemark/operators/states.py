"""State labels of a series' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import percentile_rank, series

c = F.col


def mean_of_known(*parts: Column) -> Column:
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / n)


def trend_state() -> Column:
    parts = [c(f"TS_{n}") for n in (20, 50, 200)]
    up, down = (sum((test.cast("int") for test in tests), F.lit(0)) for tests in ([p > 0 for p in parts], [p < 0 for p in parts]))
    known = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(known, F.when(up >= 2, "bullish").when(down >= 2, "bearish").otherwise("mixed"))


def states(features: DataFrame) -> DataFrame:
    """Trend, volatility, position, participation, risk and synthesis.

    Percentile ranks use the whole series, later rows included. ``features`` hold the price
    features, the probabilities ``P_CORRECTION_10D_CAL``, ``P_REBOUND_10D_CAL`` and
    ``P_SHOCK_HMM``, ``state_hmm_label`` and ``hard_risk_off_flag_safe``.
    """
    x = features.withColumns({f"rank_{n}": percentile_rank(c(n)) for n in ("atr_pct", "vol_20", "relative_volume_20", "volume_z")})
    x = x.withColumns({"vol_score": mean_of_known(c("rank_atr_pct"), c("rank_vol_20")), "part_score": mean_of_known(c("rank_relative_volume_20"), c("rank_volume_z")), "skew": c("P_REBOUND_10D_CAL") - c("P_CORRECTION_10D_CAL"), "trend_state": trend_state()})
    risk_known = c("skew").isNotNull() & c("P_SHOCK_HMM").isNotNull() & c("hard_risk_off_flag_safe").isNotNull()
    x = x.withColumns(
        {
            "vol_state": F.when(c("vol_score").isNotNull(), F.when(c("vol_score") <= 0.25, "low").when(c("vol_score") <= 0.5, "moderate").when(c("vol_score") <= 0.75, "elevated").otherwise("very_high")),
            "position_state": F.when(c("band_pos").isNotNull(), F.when(c("band_pos") <= 1 / 3, "lower_band_area").when(c("band_pos") >= 2 / 3, "upper_band_area").otherwise("mid_range")),
            "participation_state": F.when(c("part_score").isNotNull(), F.when(c("part_score") <= 0.2, "weak").when(c("part_score") >= 0.8, "strong").otherwise("normal")),
            "risk_state": F.when(
                risk_known,
                F.when(c("hard_risk_off_flag_safe") >= 0.5, "risk_off")
                .when(((c("P_SHOCK_HMM") >= 0.5) & (c("skew") <= 0)) | (c("skew") <= -0.1), "downside_risk_elevated")
                .when(c("skew") >= 0.1, "rebound_potential_elevated")
                .otherwise("balanced"),
            ),
        }
    )
    names = ["trend_state", "vol_state", "position_state", "participation_state", "risk_state"]
    known = c("state_hmm_label").isNotNull()
    for n in names:
        known = known & c(n).isNotNull()
    bullish, mixed, balanced = c("trend_state") == "bullish", c("trend_state") == "mixed", c("risk_state") == "balanced"
    regime = (
        F.when((c("risk_state") == "risk_off") | ((c("state_hmm_label") == "SHOCK") & c("vol_state").isin("elevated", "very_high")), "high_vol_stress")
        .when((c("risk_state") == "downside_risk_elevated") & (c("trend_state") == "bearish"), "downside_risk")
        .when((c("risk_state") == "rebound_potential_elevated") & (c("position_state") == "lower_band_area"), "rebound_setup")
        .when(bullish & c("participation_state").isin("normal", "strong") & balanced, "constructive_trend")
        .when(bullish, "fragile_trend")
        .when(mixed & (c("vol_state") == "low") & (c("position_state") == "mid_range"), "compressed_balance")
        .when(mixed & balanced, "neutral_balance")
        .otherwise("transitional_mix")
    )
    x = x.withColumn("market_regime", F.when(known, regime))
    return x.select("symbol", "date", *names, "market_regime", F.concat(*[y for n in names for y in (c(n), F.lit("|"))][:-1]).alias("state_compact"))


def trend_flags(features: DataFrame) -> DataFrame:
    """Seven flags, the eight-way trend state and the five-way context; all are null where an input or its percentile is missing."""
    inputs = ("TS_20", "TS_50", "TS_200", "ER_20", "ER_50", "R_14", "R_7", "LR_20")
    x = features.withColumns({f"p_{n.lower()}": percentile_rank(c(n)) for n in inputs})
    known = sum((c(n).isNull().cast("int") for n in inputs), F.lit(0)) == 0  # a known value has a rank
    x = x.withColumns(
        {
            "supportive": (c("TS_50") > 0) & (c("TS_200") > 0) & ((c("TS_20") > 0) | ((c("TS_20") > -0.08) & (c("LR_20") > 0))),
            "weak": (c("TS_50") <= 0) & (c("TS_200") <= 0),
            "clean": (c("p_er_20") >= 0.60) & (c("p_er_50") >= 0.67),
            "noisy": (c("p_er_20") <= 0.33) & (c("p_er_50") <= 0.40),
            "rebound": (c("TS_20") > 0) & (c("LR_20") > 0) & (c("R_14") <= 0),
            "extended": (c("p_r_7") >= 0.80) | (c("p_r_14") >= 0.80),
        }
    )
    x = x.withColumns({"strong": c("supportive") & (c("p_ts_50") >= 0.60) & (c("p_ts_200") >= 0.55), "pullback": c("supportive") & (c("R_7") < 0) & (c("R_14") <= 0.03), "very_extended": c("extended") & (c("TS_20") > 0) & (c("p_ts_20") >= 0.67)})
    state = (
        F.when(c("strong") & c("clean") & ~c("pullback") & ~c("very_extended"), "STRONG_CLEAN_UPTREND")
        .when(c("pullback") & (c("ER_50") > 0.10), "PULLBACK_IN_UPTREND")
        .when(c("supportive") & c("clean"), "WEAK_UPTREND")
        .when(c("supportive"), "NOISY_UPTREND")
        .when(c("weak") & c("rebound") & (c("ER_20") >= 0.18), "CLEAN_REBOUND_ATTEMPT")
        .when(c("weak"), "BEARISH_PRESSURE")
        .when((c("ER_20") <= 0.14) & (c("ER_50") <= 0.10), "CHOPPY_NEUTRAL")
        .otherwise("FAILED_BOUNCE_OR_WEAK_STRUCTURE")
    )
    context = F.when(c("pullback"), "PULLBACK").when(c("weak") & c("rebound"), "REBOUND_ATTEMPT").when(c("very_extended"), "EXTENDED").when(c("clean") & (c("R_7") > 0) & (c("R_14") > 0), "EARLY_MOVE").otherwise("CHOP")
    flags = {"supportive_structure_flag": "supportive", "weak_backdrop_flag": "weak", "clean_trend_flag": "clean", "noisy_trend_flag": "noisy", "pullback_flag": "pullback", "rebound_attempt_flag": "rebound", "extended_move_flag": "extended"}
    return x.select("symbol", "date", F.when(known, state).alias("trend_state_v1"), F.when(known, context).alias("trend_context_v1"), *[F.when(known, c(n).cast("double")).alias(name) for name, n in flags.items()])


def runs(rows: DataFrame, state: str) -> DataFrame:
    """``rows`` with ``run_id``, ``run_age`` (from 1) and ``run_length`` of equal consecutive states."""
    from pyspark.sql import Window

    changed = F.when(c(state).eqNullSafe(F.lag(state).over(series())) & (F.row_number().over(series()) > 1), 0).otherwise(1)
    x = rows.withColumn("run_id", F.sum(changed).over(series().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("symbol", "run_id")
    return x.withColumn("run_age", F.row_number().over(run.orderBy("date"))).withColumn("run_length", F.count(F.lit(1)).over(run))
