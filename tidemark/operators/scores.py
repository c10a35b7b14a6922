"""Swing scores and the rule chain that turns them into signals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, clip01, quantiles, series
from tidemark.operators.states import runs

c = F.col


def known(name: str) -> Column:
    """A number, 0 where there is none."""
    return F.coalesce(c(name), F.lit(0.0))


def weighted_known(parts: Mapping[str, float]) -> Column:
    """Weighted mean of the columns that are known."""
    total = sum((F.coalesce(c(n) * w, F.lit(0.0)) for n, w in parts.items()), F.lit(0.0))
    weight = sum((F.when(c(n).isNotNull(), w).otherwise(0.0) for n, w in parts.items()), F.lit(0.0))
    return clip01(F.when(weight > 0, total / weight))


def exhaustion(side: str) -> Column:
    """Mean of six signs that a leg is spent: direction, age, size, stretch, cooling volatility, regime."""
    buy = side == "buy"
    sign = -1 if buy else 1
    live = F.coalesce("live_swing_direction", F.lit("unknown"))
    parts = [
        F.when(live == ("down" if buy else "up"), 1.0).when(live == "unknown", 0.35).otherwise(0.0),
        clip01(known("current_swing_age_pct_of_median") / 1.25),
        clip01(known("current_swing_size_pct_of_median") / 1.25),
        0.5 * clip01(sign * known("dist_from_mean_vol_units") / 3) + 0.5 * clip01(sign * (clip01(known("band_pos")) - 0.5) / 0.5),
        clip01(1 - known("downside_semi_vol" if buy else "upside_semi_vol") / (known("ewma_vol") + 1e-9)),
        0.5 * clip01(known("P_CORRECTION_10D_CAL")) + 0.5 * clip01(known("P_REBOUND_10D_CAL" if buy else "P_SURGE_HMM")),
    ]
    return clip01(sum(parts, F.lit(0.0)) / 6)


def buy_exhaustion_weighted() -> Column:
    """Eight weighted terms: context, age, size, stretch, rejection, volatility, rebound, chain."""
    # The weights and scales of the terms.
    live = F.coalesce("live_swing_direction", F.lit("unknown"))
    cool = clip01(known("downside_semi_vol") / (known("ewma_vol") + 1e-9) / 1.5)
    close_at = clip01(known("close_in_range"))
    third = lambda n: clip01(known(n) / 3 + 0.5)
    terms = [
        (0.16, F.when(live == "down", 1.0).when(live == "unknown", 0.35).otherwise(0.0)),
        (0.14, clip01(known("current_swing_age_pct_of_median") / 1.1)),
        (0.14, clip01(known("current_swing_size_pct_of_median") / 1.1)),
        (0.18, 0.45 * clip01(-known("dist_from_mean_vol_units") / 2.5) + 0.35 * clip01((0.4 - clip01(known("band_pos"))) / 0.4) + 0.20 * clip01(-known("distance_from_last_pivot_pct") / 0.18)),
        (0.16, 0.45 * clip01(known("lower_wick_ratio")) + 0.40 * close_at + 0.15 * F.when(known("r1") > 0, 1.0).otherwise(0.0)),
        (0.10, 0.55 * cool + 0.45 * (0.5 * close_at + 0.5 * clip01(known("return_accel") / 0.08 + 0.5))),
        (0.08, 0.55 * clip01(known("P_REBOUND_10D_CAL")) + 0.25 * (1 - clip01(known("P_SHOCK_HMM"))) + 0.20 * clip01(known("P_CORRECTION_10D_CAL"))),
        (0.04, 0.45 * third("ONCHAIN_WHALE_SHARE_Z") + 0.35 * third("ONCHAIN_DOM_Z") + 0.20 * third("ONCHAIN_VOL_Z")),
    ]
    return clip01(sum((w * t for w, t in terms), F.lit(0.0)))


def timing(side: str) -> Column:
    """Phase .45, analog .30, exhaustion .25, over those known."""
    return weighted_known({f"{side}_phase": 0.45, f"{side}_analog": 0.30, f"{side}_exhaustion": 0.25})


def hybrids(phase: Column, ordinal: Column, spent: Column) -> dict[str, Column]:
    """Balanced, rank-local and two-stage mixtures."""
    return {"hybrid_balanced": clip01(0.40 * phase + 0.30 * ordinal + 0.30 * spent), "hybrid_rank_local": clip01(0.25 * phase + 0.35 * ordinal + 0.40 * spent), "hybrid_two_stage": clip01(ordinal * (0.35 + 0.65 * spent))}


def consensus(phase: Column, *scores: Column) -> Column:
    return clip01(phase * F.greatest(*scores))


# ----------------------------------------------------------- rule chain

HIGH, MODERATE, SPREAD = 0.80, 0.60, 0.10


def decisions(scored: DataFrame, fitted: Column) -> DataFrame:
    """``scored(symbol, date, buy, sell)`` with decision state, clarity, conflict, bands; cuts are quantiles of the ``fitted`` rows."""
    cuts = scored.where(fitted).groupBy("symbol").agg(quantiles(c("buy"), [MODERATE, HIGH]).alias("bq"), quantiles(c("sell"), [MODERATE, HIGH]).alias("sq"))
    x = scored.join(F.broadcast(cuts), "symbol").withColumns({"spread": c("buy") - c("sell"), "bm": c("bq")[0], "bh": c("bq")[1], "sm": c("sq")[0], "sh": c("sq")[1]})
    band = lambda v, m, h: F.when(c(v) >= c(h), "high").when(c(v) >= c(m), "moderate").otherwise("low")
    state = (
        F.when((c("buy") >= c("bh")) & (c("sell") < c("sm")) & (c("spread") >= SPREAD), "BUY_SETUP")
        .when((c("sell") >= c("sh")) & (c("buy") < c("bm")) & (c("spread") <= -SPREAD), "SELL_SETUP")
        .when((c("buy") >= c("bm")) & (c("sell") >= c("sm")), "CONFLICT_OVERLAP")
        .when((c("buy") < c("bm")) & (c("sell") < c("sm")), "NEUTRAL_NO_EDGE")
        .otherwise("TRANSITION_UNCLEAR")
    )
    x = x.withColumns(
        {
            "decision_state": state,
            "clarity": clip01(F.abs("spread") * (0.5 + 0.5 * F.greatest("buy", "sell"))),
            "conflict": clip01(F.least("buy", "sell") * F.greatest("buy", "sell")),
            "buy_dominance": c("buy") * (1 - c("sell")),
            "sell_dominance": c("sell") * (1 - c("buy")),
            "buy_band": band("buy", "bm", "bh"),
            "sell_band": band("sell", "sm", "sh"),
        }
    ).drop("bq", "sq", "bm", "bh", "sm", "sh")
    bucket = F.when((c("buy_band") == "high") & (c("sell_band") == "high"), "both_high").when(c("buy_band") == "high", "buy_high").when(c("sell_band") == "high", "sell_high").when((c("buy_band") == "low") & (c("sell_band") == "low"), "both_low").otherwise("mixed_moderate")
    return _aged(x.withColumn("interaction_bucket", bucket), "decision_state", "decision")


def _aged(rows: DataFrame, state: str, name: str) -> DataFrame:
    """Run columns of a state under the layer's name."""
    return runs(rows, state).withColumnsRenamed({"run_id": f"{name}_run_id", "run_age": f"{name}_age", "run_length": f"{name}_length"})


def playbook(decided: DataFrame) -> DataFrame:
    state, clarity, conflict = c("decision_state"), c("clarity"), c("conflict")
    clean_buy, clean_sell = (state == "BUY_SETUP") & (clarity >= 0.25) & (conflict < 0.22), (state == "SELL_SETUP") & (clarity >= 0.25) & (conflict < 0.24)
    label = F.when(clean_buy, "ACCUMULATION_WATCH").when(clean_sell, "DISTRIBUTION_WATCH").when(state == "CONFLICT_OVERLAP", "HIGH_CONFLICT").when(state == "NEUTRAL_NO_EDGE", "NO_ACTION").otherwise("TRANSITION_WATCH")
    lean = F.when(c("buy") > c("sell"), "buy_lean").otherwise("sell_lean")
    bias = (
        F.when(clean_buy, "buy_side").when(clean_sell, "sell_side").when(state == "BUY_SETUP", "buy_lean").when(state == "SELL_SETUP", "sell_lean")
        .when(state == "CONFLICT_OVERLAP", "mixed").when(state == "NEUTRAL_NO_EDGE", "neutral").when(F.abs("spread") < 0.10, "mixed").otherwise(lean)
    )
    x = decided.withColumns({"playbook_label": label, "playbook_bias": bias})
    age, length = c("decision_age"), c("decision_length")
    attention = (
        F.when(c("playbook_label").isin("ACCUMULATION_WATCH", "DISTRIBUTION_WATCH"), F.when((clarity >= 0.30) & (conflict < 0.25), "high").otherwise("medium"))
        .when(c("playbook_label") == "HIGH_CONFLICT", F.when(conflict >= 0.25, "high").otherwise("medium"))
        .when(c("playbook_label") == "NO_ACTION", F.when(age < 5, "low").otherwise("very_low"))
        .otherwise("medium")
    )
    maturity = F.when(age <= 1, "early").when((length >= 4) & (age >= F.greatest(F.lit(3), F.ceil(length * 0.65))), "mature").otherwise("developing")
    return x.withColumns({"attention": attention, "maturity": maturity})


def translation(played: DataFrame) -> DataFrame:
    """Operational state. What a row carries to the next is its own raw bias, so ``lag`` is all the memory needed."""
    label, clarity, conflict, spread = c("playbook_label"), c("clarity"), c("conflict"), c("spread")
    ready = (c("attention") == "high") & (clarity >= 0.30)
    long = (label == "ACCUMULATION_WATCH") & ready & (conflict <= 0.22) & (spread >= 0.15)
    sell = (label == "DISTRIBUTION_WATCH") & ready & (conflict <= 0.24) & (spread <= -0.15)
    forming = (clarity >= 0.20) & (conflict < 0.30)
    raw = F.when(long, "LONG_CONTEXT_ACTIVE").when(sell, "SELL_CONTEXT_ACTIVE").when(label == "HIGH_CONFLICT", "STAND_ASIDE_CONFLICT").when(label == "NO_ACTION", "STAND_ASIDE_NO_EDGE").otherwise("WAIT_CONFIRMATION")
    raw_bias = (
        F.when(long, "long_side").when(sell, "sell_side").when(label == "ACCUMULATION_WATCH", "long_lean").when(label == "DISTRIBUTION_WATCH", "sell_lean").when(label == "HIGH_CONFLICT", "mixed").when(label == "NO_ACTION", "neutral")
        .when((spread >= 0.15) & forming, "long_lean").when((spread <= -0.15) & forming, "sell_lean").otherwise("mixed")
    )
    x = played.withColumns({"raw": raw, "raw_bias": raw_bias})
    x = x.withColumn("before", F.coalesce(F.lag(F.when(c("raw").startswith("STAND_ASIDE"), "neutral").otherwise(c("raw_bias"))).over(series()), F.lit("neutral")))
    favoured = c("before").isin("long_side", "sell_side", "long_lean", "sell_lean")
    faded = favoured & c("raw").startswith("STAND_ASIDE")
    flipped = favoured & ((c("before").startswith("long") & (c("raw") == "SELL_CONTEXT_ACTIVE")) | (c("before").startswith("sell") & (c("raw") == "LONG_CONTEXT_ACTIVE")))
    one = lambda e: F.when(e, 1).otherwise(0)
    x = x.withColumns(
        {
            "operational_state": F.when(faded, "CONTEXT_INVALIDATED").otherwise(c("raw")),
            "operational_bias": F.when(faded, F.when(c("raw") == "STAND_ASIDE_CONFLICT", "mixed").otherwise("neutral")).otherwise(c("raw_bias")),
            "readiness": one(long | sell),
            "invalidated": one(faded | flipped),
            "caution": one(faded | flipped | (c("raw") == "STAND_ASIDE_CONFLICT")),
            "stand_aside": one(faded | (c("raw") == "STAND_ASIDE_CONFLICT")),
        }
    ).drop("raw", "raw_bias", "before")
    return _aged(x, "operational_state", "operational")


def rules(translated: DataFrame) -> DataFrame:
    state = c("operational_state")
    free = (c("readiness") == 1) & (c("caution") == 0) & (c("operational_age") >= 1)
    rule = (
        F.when((c("invalidated") == 1) | (state == "CONTEXT_INVALIDATED"), "INVALIDATED")
        .when((c("stand_aside") == 1) | (state == "STAND_ASIDE_CONFLICT"), "BLOCKED_BY_CONFLICT")
        .when(state == "STAND_ASIDE_NO_EDGE", "BLOCKED_NO_EDGE")
        .when((state == "LONG_CONTEXT_ACTIVE") & free & (c("operational_bias") == "long_side"), "LONG_ELIGIBLE")
        .when((state == "SELL_CONTEXT_ACTIVE") & free & (c("operational_bias") == "sell_side"), "SELL_ELIGIBLE")
        .otherwise("AWAIT_CONFIRMATION")
    )
    x = translated.withColumn("rule_state", rule)
    return x.withColumns({n: F.when(c("rule_state").isin(*s), 1).otherwise(0) for n, s in {"long_permission": ["LONG_ELIGIBLE"], "sell_permission": ["SELL_ELIGIBLE"], "confirmation_pending": ["AWAIT_CONFIRMATION"], "invalidation_active": ["INVALIDATED"], "blocked": ["INVALIDATED", "BLOCKED_BY_CONFLICT", "BLOCKED_NO_EDGE"]}.items()})


def signals(ruled: DataFrame) -> DataFrame:
    """Discrete signals. An active side is the previous row's permission; a side that was permitted before is reactivated."""
    side = F.when(c("long_permission") == 1, "long").when(c("sell_permission") == 1, "sell")
    x = ruled.withColumn("side", side)
    x = x.withColumn("held", F.lag("side").over(series()))
    earlier = series().rowsBetween(Window.unboundedPreceding, -1)
    broken = (c("invalidation_active") == 1) & c("held").isNotNull()
    new = c("side").isNotNull() & ~c("side").eqNullSafe(c("held"))
    state = F.when(broken, "SIGNAL_INVALIDATED").when(new, F.concat(F.upper("side"), F.lit("_SIGNAL_NEW"))).when(c("side").isNotNull(), F.concat(F.upper("side"), F.lit("_SIGNAL_ACTIVE"))).otherwise("NO_SIGNAL")
    one = lambda e: F.when(e, 1).otherwise(0)
    seen = F.when(c("side") == "long", F.max("long_permission").over(earlier)).when(c("side") == "sell", F.max("sell_permission").over(earlier))
    x = x.withColumns({"signal_state": state, "signal_side": F.when(broken, c("held")).otherwise(F.coalesce("side", F.lit("none"))), "signal_new": one(new), "signal_continued": one(c("side").isNotNull() & ~new), "signal_reactivated": one(new & (seen == 1)), "signal_active": one(c("side").isNotNull()), "context": F.coalesce("side", F.lit("inactive"))}).drop("held")
    x = _aged(x, "context", "context")
    x = x.withColumns({n: F.when(c("signal_active") == 1, c(n)).otherwise(0) for n in ("context_age", "context_length")}).drop("side", "context")
    return _aged(x, "signal_state", "signal")


def state_summary(rows: DataFrame, state: str, layer: str) -> DataFrame:
    """Rows, share, runs and mean run length of each state."""
    n = rows.groupBy(state).agg(F.count(F.lit(1)).alias("n"), F.count_if(c(f"{layer}_age") == 1).alias("runs"))
    return n.select(c(state).alias("state"), "n", "runs", (c("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"), (c("n") / c("runs")).alias("mean_run_length"))


__all__ = ["clip", "consensus", "decisions", "exhaustion", "hybrids", "playbook", "rules", "signals", "state_summary", "timing", "translation"]
