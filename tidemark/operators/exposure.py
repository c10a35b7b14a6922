"""Exposure targeting: rate-limited scans over regime and hazard probabilities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, clip01
from tidemark.operators import scans

c = F.col


def inputs(features: DataFrame) -> DataFrame:
    """Support, direction, conviction, hazards and the risk-off flag of each row; regime probabilities count as shares of their sum, missing hazards as .20."""
    # Thresholds of support, dominance and risk-off.
    regimes = ("P_CORE_HMM", "P_DRIFT_HMM", "P_SHOCK_HMM", "P_SURGE_HMM")
    total = sum((c(n) for n in regimes[1:]), c(regimes[0]))
    x = features.withColumns({n: F.when(total > 0, c(n) / total).when(total.isNotNull(), 0.25) for n in regimes})
    x = x.withColumns({"pos": clip01(c("P_DRIFT_HMM") + c("P_SURGE_HMM")), "p_corr": F.coalesce(clip01(c("P_CORRECTION_10D_CAL")), F.lit(0.20)), "p_reb": F.coalesce(clip01(c("P_REBOUND_10D_CAL")), F.lit(0.20))})
    x = x.withColumns({"support": clip01(c("pos") + 0.5 * c("P_CORE_HMM")), "tilt": clip(c("pos") - c("P_SHOCK_HMM"), -1.0, 1.0), "dominance": clip01((c("hmm_confidence") - 0.35) / 0.35)})
    weak = F.coalesce(c("TS_50") <= 0, F.lit(False)) | F.coalesce(c("band_pos") <= 0.35, F.lit(False)) | F.coalesce((c("state_hmm_label") == "SHOCK") & (c("hmm_confidence") >= 0.60), F.lit(False))
    off = (c("P_SHOCK_HMM") >= 0.70) & (c("pos") <= 0.30) & (c("p_corr") >= 0.65) & weak
    return x.withColumns({"conviction": clip01(c("support") * c("dominance")), "risk_off": F.coalesce(off, F.lit(False))})


def target() -> Column:
    """The safe profile's exposure before its step limit."""
    return F.when(c("risk_off"), 0.0).otherwise(0.15 + 0.85 * c("conviction") * clip01((1 - c("p_corr")) * (1 - c("p_corr"))))


#: Moves of a row: the usual limit and the one into risk-off.
LIMIT, LIMIT_OFF = 0.1, 0.5


def _safe_recursion(start: float) -> scans.Recursion:
    """State: the exposure held. A range is its map through rate-limited moves."""

    def summarise(rows: pd.DataFrame) -> list[float]:
        through = scans.Limited(0.0, 1.0)
        for goal, off in zip(rows["target"], rows["risk_off"]):
            through.move(goal, LIMIT_OFF if off else LIMIT)
        return through.numbers()

    def advance(state: list[float] | None, element: list[float]) -> list[float]:
        return [scans.limited_at(start if state is None else state[0], element)]

    def replay(rows: pd.DataFrame, state: list[float] | None) -> pd.DataFrame:
        held, out = start if state is None else state[0], []
        for goal, off in zip(rows["target"], rows["risk_off"]):
            limit = LIMIT_OFF if off else LIMIT
            now = min(1.0, max(0.0, held + min(limit, max(-limit, goal - held))))
            out.append((now, max(0.0, now - held)))
            held = now
        return rows[["symbol", "date", "risk_off"]].assign(exposure=[x for x, _ in out], entry_step=[s for _, s in out])

    return scans.Recursion(summarise, advance, replay)


def safe_exposure(features: DataFrame, start: float = 0.15, ranges: Column | None = None) -> DataFrame:
    """(symbol, date, exposure, entry_step, risk_off): each row moves toward its target by .10, or by .50 into risk-off.

    Rows without regime probabilities are left out. Ranges of days are scanned at once.
    """
    rows = inputs(features).withColumn("target", target()).where(c("target").isNotNull()).select("symbol", "date", "target", "risk_off")
    return scans.scan(rows, _safe_recursion(start), "symbol string, date date, risk_off boolean, exposure double, entry_step double", ranges)


def _aggressive_recursion(cap: float, gain: float, near: float, far: float) -> scans.Recursion:
    """State: the side last taken and the exposure held. A range has, for each side before it, the side behind it and the map of the exposure."""

    def facing(way: int, tilt: float, off: bool) -> int:
        up, down = (near, far) if way >= 0 else (far, near)
        return 0 if off else int(tilt > up) - int(tilt < -down)

    def goal_of(way: int, conviction: float, corr: float, reb: float) -> tuple[float, float]:
        hazard = corr if way >= 0 else reb
        return max(-1.0, min(1.0, way * conviction * (1 - hazard) * (1 - hazard))), hazard

    def each(rows: pd.DataFrame):
        return zip(*(rows[n] for n in ("tilt", "conviction", "pos", "p_corr", "p_reb", "risk_off")))

    def summarise(rows: pd.DataFrame) -> list[float]:
        out: list[float] = []
        for way in (-1, 0, 1):
            through = scans.Limited(-1.0, 1.0)
            for tilt, conviction, _, corr, reb, off in each(rows):
                way = facing(way, tilt, off)
                through.move(goal_of(way, conviction, corr, reb)[0], LIMIT_OFF if off else LIMIT)
            out += [way, *through.numbers()]
        return out

    def advance(state: list[float] | None, element: list[float]) -> list[float]:
        way, held = state or [0.0, 0.0]
        at = 0
        for _ in range(int(way) + 1):
            at += 2 + 2 * int(element[at + 1])
        return [element[at], scans.limited_at(held, element[at + 1 :])]

    def replay(rows: pd.DataFrame, state: list[float] | None) -> pd.DataFrame:
        way, held = (0, 0.0) if state is None else (int(state[0]), state[1])
        out = []
        for tilt, conviction, pos, corr, reb, off in each(rows):
            way = facing(way, tilt, off)
            goal, hazard = goal_of(way, conviction, corr, reb)
            limit = LIMIT_OFF if off else LIMIT
            now = max(-1.0, min(1.0, held + min(limit, max(-limit, goal - held))))
            step = max(0.0, abs(now) - abs(held)) if held == 0 or now * held > 0 else 0.0
            out.append((way, now, max(1.0, min(cap, 1 + gain * (cap - 1) * pos * conviction * (1 - hazard))), step))
            held = now
        return rows[["symbol", "date", "risk_off"]].assign(**{n: [x[i] for x in out] for i, n in enumerate(("direction", "exposure", "leverage", "entry_step"))})

    return scans.Recursion(summarise, advance, replay)


def aggressive_exposure(features: DataFrame, cap: float = 2.0, gain: float = 1.0, near: float = 0.10, far: float = 0.20, ranges: Column | None = None) -> DataFrame:
    """(symbol, date, direction, exposure, leverage, entry_step, risk_off): a signed profile.

    The direction is the tilt's sign where that passes ``near`` on the side last taken (the
    long side at first and after none), or ``far`` on the other; else, and in risk-off, it is none.
    Exposure moves toward direction x conviction x (1 - hazard)^2 by .10, or by .50 into
    risk-off. ``entry_step`` is the increase of its size unless it changes sides. Ranges of days are scanned at once.
    """
    rows = inputs(features).where(c("tilt").isNotNull() & c("conviction").isNotNull()).select("symbol", "date", "tilt", "conviction", "pos", "p_corr", "p_reb", "risk_off")
    return scans.scan(rows, _aggressive_recursion(cap, gain, near, far), "symbol string, date date, risk_off boolean, direction int, exposure double, leverage double, entry_step double", ranges)
