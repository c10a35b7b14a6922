"""The price feature surface: causal columns of one series' bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import at_least, clip01, finite, full, last_rows, series, so_far
from tidemark.operators import scans

RETURNS, TRENDS = (3, 7, 14), (20, 50, 200)
VOL, ATR, BAND, SWITCH, VOLUME, EQUILIBRIUM, EXTREMA, ADAPT, EWMA = 20, 14, 100, 50, 20, 50, 50, 730, 20

FAMILIES = {
    "trend": ["r1", *[f"R_{k}" for k in RETURNS], *[f"{f}_{n}" for n in TRENDS for f in ("TS", "LR", "ER", "RVR")]],
    "volatility": ["vol_20", "upside_semi_vol", "downside_semi_vol", "true_range", "atr", "atr_pct", "parkinson_vol", "garman_klass_vol"],
    "structure": ["band_hi", "band_lo", "band_w", "band_pos", "dist_from_mean_vol_units"],
    "candle": ["candle_body", "candle_range", "body_to_range_ratio", "upper_wick_ratio", "lower_wick_ratio", "close_in_range"],
    "volume": ["volume_log1p", "relative_volume_20", "volume_z"],
    "path": ["switch_rate_50", "run_length_up", "run_length_down", "run_magnitude_up", "run_magnitude_down", "return_accel", "time_since_local_high", "time_since_local_low"],
}


def price_features(bars: DataFrame) -> DataFrame:
    """``bars`` with all families but the EWMA volatility; one exchange and one sort by symbol and date.

    Missing columns of open, high, low or volume count as null and leave their families
    null; the band then uses the close. Values are null until their window is full.
    """
    w = series()
    absent = [c for c in ("open", "high", "low", "volume") if c not in bars.columns]
    x = bars.withColumns({c: F.lit(None).cast("double") for c in absent})
    x = x.withColumns({"lc": finite(F.ln("close")), "rn": F.row_number().over(w), "pc": F.lag("close").over(w), "hi": F.coalesce("high", "close"), "lo": F.coalesce("low", "close")})
    x = x.withColumn("r1", F.col("lc") - F.lag("lc").over(w))
    x = x.withColumns(
        {
            "sign": F.signum(F.coalesce("r1", F.lit(0.0))),
            "abs_r1": F.abs("r1"),
            "true_range": F.when(F.col("rn") == 1, F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc")))),
            "volume_log1p": finite(F.log1p("volume")),
        }
    )
    x = x.withColumn("persistent", F.coalesce(F.last(F.when(F.col("sign") != 0, F.col("sign")), ignorenulls=True).over(so_far()), F.lit(0.0)))
    earlier = F.lag("persistent").over(w)
    x = x.withColumns({"switch": F.when((F.col("persistent") != 0) & F.coalesce(earlier != 0, F.lit(True)) & ~F.col("persistent").eqNullSafe(earlier), 1.0).otherwise(0.0), "island": F.sum(F.when(F.col("sign") != F.lag("sign").over(w), 1).otherwise(0)).over(so_far())})
    x = x.withColumn("level", F.col("volume_log1p") - F.first("volume_log1p", ignorenulls=True).over(so_far()))
    x = x.withColumns(_running_sums())
    return x.select(*bars.columns, *_all_columns())


def _running_sums() -> dict[str, Column]:
    """Sums from the start of a series, whose differences are sums over any number of rows.

    Returns are near zero, so doubles lose nothing; volumes are taken relative to the first.
    Sums that weigh log prices by row number would cancel and are exact decimals.
    """
    c, w = F.col, so_far()
    fixed = c("lc").cast("decimal(18,15)")
    each = {"n_r": F.count("r1"), "s_r": F.sum("r1"), "q_r": F.sum(c("r1") * c("r1")), "a_r": F.sum("abs_r1"), "n_lc": F.count("lc"), "s_lc": F.sum(fixed), "m_lc": F.sum(fixed * c("rn").cast("decimal(10,0)")), "n_v": F.count("level"), "s_v": F.sum("level"), "q_v": F.sum(c("level") * c("level"))}
    return {k: F.coalesce(v.over(w), F.lit(0).cast("decimal(38,15)" if k in ("s_lc", "m_lc") else "double")) for k, v in each.items()}


def _all_columns() -> list[Column]:
    w = series()
    c = F.col

    def over(name: str, n: int) -> Column:
        """What a running sum has gained in the last ``n`` rows."""
        return c(name) - F.coalesce(F.lag(name, n).over(w), F.lit(0))

    def if_full(value: Column, of: str, n: int) -> Column:
        return F.when(over(of, n) == n, value)

    def deviation(n: int, of: str = "r") -> Column:
        mean = over(f"s_{of}", n) / n
        return if_full(F.sqrt(F.greatest(over(f"q_{of}", n) / n - mean * mean, F.lit(0.0))), f"n_{of}", n)

    def slope(n: int) -> Column:
        ahead = (2 * c("rn") - (n - 1)).cast("decimal(11,0)")
        return if_full((over("m_lc", n).cast("decimal(32,15)") * 2 - over("s_lc", n).cast("decimal(22,15)") * ahead).cast("double") * 6 / (n * (n * n - 1)), "n_lc", n)

    sd = {n: deviation(n) for n in {*TRENDS, VOL, EQUILIBRIUM}}
    out: dict[str, Column] = {"r1": c("r1")}
    for k in RETURNS:
        out[f"R_{k}"] = c("lc") - F.lag("lc", k).over(w)
    for n in TRENDS:
        change = c("lc") - F.lag("lc", n).over(w)
        out[f"TS_{n}"] = if_full(over("s_r", n) / n, "n_r", n) / at_least(sd[n])
        out[f"LR_{n}"] = slope(n) / at_least(sd[n])
        out[f"ER_{n}"] = F.abs(change) / at_least(if_full(over("a_r", n), "n_r", n))
        out[f"RVR_{n}"] = change / at_least(sd[n] * math.sqrt(n))
    out["vol_20"] = sd[VOL]
    for name, side in (("upside_semi_vol", c("r1")), ("downside_semi_vol", -c("r1"))):
        one_sided = F.when(c("r1").isNotNull(), F.greatest(side, F.lit(0.0)))
        out[name] = F.sqrt(full(F.avg(one_sided * one_sided), c("r1"), VOL))
    out["true_range"] = c("true_range")
    out["atr"] = full(F.avg("true_range"), c("true_range"), ATR)
    out["atr_pct"] = out["atr"] / at_least(c("close"))
    hl, co = F.ln(c("high") / c("low")), F.ln(c("close") / c("open"))
    out["parkinson_vol"] = F.sqrt(at_least(full(F.avg(hl * hl), hl, VOL) / (4 * math.log(2)), 0.0))
    out["garman_klass_vol"] = F.sqrt(at_least(full(F.avg(hl * hl * 0.5 - co * co * (2 * math.log(2) - 1)), hl, VOL), 0.0))
    high, low = full(F.max("hi"), c("hi"), BAND), full(F.min("lo"), c("lo"), BAND)
    span = at_least(high - low)
    out |= {"band_hi": high, "band_lo": low, "band_w": span / at_least(c("close")), "band_pos": clip01((c("close") - low) / span)}
    out["dist_from_mean_vol_units"] = (c("lc") - if_full(over("s_lc", EQUILIBRIUM).cast("double") / EQUILIBRIUM, "n_lc", EQUILIBRIUM)) / at_least(sd[EQUILIBRIUM] * math.sqrt(EQUILIBRIUM))
    whole = at_least(c("high") - c("low"))
    out["candle_body"], out["candle_range"] = c("close") - c("open"), whole
    out["body_to_range_ratio"] = (c("close") - c("open")) / whole
    top = F.when(c("open").isNotNull(), F.greatest("open", "close"))
    bottom = F.when(c("open").isNotNull(), F.least("open", "close"))
    out["upper_wick_ratio"], out["lower_wick_ratio"] = (c("high") - top) / whole, (bottom - c("low")) / whole
    out["close_in_range"] = clip01((c("close") - c("low")) / whole)
    v = c("volume_log1p")
    out["volume_log1p"] = v
    out["relative_volume_20"] = c("volume") / at_least(full(F.avg("volume"), c("volume"), VOLUME))
    out["volume_z"] = (c("level") - if_full(over("s_v", ADAPT) / ADAPT, "n_v", ADAPT)) / at_least(deviation(ADAPT, "v"))
    out["switch_rate_50"] = full(F.avg("switch"), c("switch"), SWITCH)
    streak = Window.partitionBy("symbol", "island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    for name, s in (("up", 1), ("down", -1)):
        on = c("sign") == s
        out[f"run_length_{name}"] = F.when(on, F.count(F.lit(1)).over(streak).cast("double")).otherwise(0.0)
        out[f"run_magnitude_{name}"] = F.when(on, F.sum("abs_r1").over(streak)).otherwise(0.0)
    out["return_accel"] = c("r1") - F.lag("r1").over(w)
    for name, col, best in (("high", "hi", F.max), ("low", "lo", F.min)):
        n = EXTREMA
        held = F.collect_list(col).over(last_rows(n))
        out[f"time_since_local_{name}"] = F.when(F.count(col).over(last_rows(n)) == n, (n - F.array_position(held, best(col).over(last_rows(n)))).cast("double"))
    return [v.alias(k) for k, v in out.items()]


def ewma_vol(bars: DataFrame, span: int = EWMA, ranges: Column | None = None) -> DataFrame:
    """(symbol, date, ewma_vol): root of the exponentially weighted mean of squared log returns, by a scan over ranges of days."""
    r1 = F.ln("close") - F.lag(F.ln("close")).over(series())
    squares = bars.select("symbol", "date", (r1 * r1).alias("_sq"))
    means = scans.scan(squares, scans.ewma(span, "_sq", "_mean"), "symbol string, date date, _sq double, _mean double", ranges)
    return means.select("symbol", "date", F.sqrt("_mean").alias("ewma_vol"))


def features(bars: DataFrame) -> DataFrame:
    return price_features(bars).join(ewma_vol(bars), ["symbol", "date"])


