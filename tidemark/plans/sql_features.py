"""ANSI SQL for the series queries, as DuckDB runs it."""

from __future__ import annotations

EPS = "1e-8"

BARS = """
stats AS (SELECT o_orderpriority AS symbol, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd FROM orders GROUP BY 1),
moves AS (SELECT o.o_orderpriority AS symbol, CAST(o.o_orderdate AS DATE) AS date, o.o_orderkey AS key, (o.o_totalprice - s.mean) / s.sd * 0.01 AS move
          FROM orders o JOIN stats s ON s.symbol = o.o_orderpriority),
totals AS (SELECT symbol, date, sum(move) AS total FROM moves GROUP BY 1, 2),
priors AS (SELECT symbol, date, coalesce(sum(total) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prior FROM totals),
ticks AS (SELECT m.symbol, m.date, m.key, round(100 * exp(p.prior + sum(m.move) OVER (PARTITION BY m.symbol, m.date ORDER BY m.key ROWS UNBOUNDED PRECEDING)), 4) AS px
          FROM moves m JOIN priors p USING (symbol, date)),
bars AS (SELECT symbol, date, arg_min(px, key) AS open, max(px) AS high, min(px) AS low, arg_max(px, key) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)"""


def full(value: str, of: str, n: int) -> str:
    return f"(CASE WHEN count({of}) OVER w{n} = {n} THEN {value} OVER w{n} END)"


def floor(x: str, low: str = EPS) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({x}, {low}) END)"


def clip01(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0.0), 1.0) END)"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def price_expressions() -> dict[str, str]:
    sd = lambda n: full("stddev_pop(r1)", "r1", n)
    out = {"r1": "r1"} | {f"R_{k}": f"lc - lag(lc, {k}) OVER w" for k in (3, 7, 14)}
    for n in (20, 50, 200):
        change = f"(lc - lag(lc, {n}) OVER w)"
        out |= {
            f"TS_{n}": f"{full('avg(r1)', 'r1', n)} / {floor(sd(n))}",
            f"LR_{n}": f"{full('regr_slope(lc, rn)', 'lc', n)} / {floor(sd(n))}",
            f"ER_{n}": f"abs{change} / {floor(full('sum(abs(r1))', 'r1', n))}",
            f"RVR_{n}": f"{change} / {floor(f'({sd(n)} * sqrt({n}))')}",
        }
    out |= {
        "vol_20": sd(20),
        "upside_semi_vol": f"sqrt({full('avg(greatest(r1, 0.0) * greatest(r1, 0.0) + 0 * r1)', 'r1', 20)})",
        "downside_semi_vol": f"sqrt({full('avg(greatest(-r1, 0.0) * greatest(-r1, 0.0) + 0 * r1)', 'r1', 20)})",
        "true_range": "tr",
        "atr": full("avg(tr)", "tr", 14),
        "atr_pct": f"{full('avg(tr)', 'tr', 14)} / greatest(close, {EPS})",
        "parkinson_vol": f"sqrt(greatest({full('avg(ln(high / low) * ln(high / low))', 'high', 20)} / (4 * ln(2)), 0.0) + 0 * {full('avg(r1)', 'high', 20)})",
        "garman_klass_vol": f"sqrt(greatest({full('avg(0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open))', 'high', 20)}, 0.0) + 0 * {full('avg(r1)', 'high', 20)})",
        "band_hi": full("max(high)", "high", 100),
        "band_lo": full("min(low)", "low", 100),
    }
    span = floor(f"({out['band_hi']} - {out['band_lo']})")
    wide = f"greatest(high - low, {EPS})"
    lv = "ln(1 + volume)"
    out |= {
        "band_w": f"{span} / greatest(close, {EPS})",
        "band_pos": clip01(f"((close - {out['band_lo']}) / {span})"),
        "dist_from_mean_vol_units": f"(lc - {full('avg(lc)', 'lc', 50)}) / {floor(f'({sd(50)} * sqrt(50))')}",
        "candle_body": "close - open",
        "candle_range": wide,
        "body_to_range_ratio": f"(close - open) / {wide}",
        "upper_wick_ratio": f"(high - greatest(open, close)) / {wide}",
        "lower_wick_ratio": f"(least(open, close) - low) / {wide}",
        "close_in_range": clip01(f"((close - low) / {wide})"),
        "volume_log1p": lv,
        "relative_volume_20": f"volume / {floor(full('avg(volume)', 'volume', 20))}",
        "volume_z": f"({lv} - {full(f'avg({lv})', 'volume', 730)}) / {floor(full(f'stddev_pop({lv})', 'volume', 730))}",
        "switch_rate_50": full("avg(switch)", "switch", 50),
        "run_length_up": "CASE WHEN sgn > 0 THEN CAST(count(*) OVER streak AS DOUBLE) ELSE 0.0 END",
        "run_length_down": "CASE WHEN sgn < 0 THEN CAST(count(*) OVER streak AS DOUBLE) ELSE 0.0 END",
        "run_magnitude_up": "CASE WHEN sgn > 0 THEN sum(abs(r1)) OVER streak ELSE 0.0 END",
        "run_magnitude_down": "CASE WHEN sgn < 0 THEN sum(abs(r1)) OVER streak ELSE 0.0 END",
        "return_accel": "r1 - lag(r1) OVER w",
        "time_since_local_high": f"CAST(CASE WHEN count(*) OVER w50 = 50 THEN 50 - list_position(list(high) OVER w50, max(high) OVER w50) END AS DOUBLE)",
        "time_since_local_low": f"CAST(CASE WHEN count(*) OVER w50 = 50 THEN 50 - list_position(list(low) OVER w50, min(low) OVER w50) END AS DOUBLE)",
    }
    return out


WINDOWS = "WINDOW w AS (PARTITION BY symbol ORDER BY date), streak AS (PARTITION BY symbol, island ORDER BY date ROWS UNBOUNDED PRECEDING), " + ", ".join(
    f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (10, 14, 20, 50, 100, 200, 365, 730)
)

STEPS = """
f0 AS (SELECT *, ln(close) AS lc, row_number() OVER w AS rn, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
f1 AS (SELECT *, lc - lag(lc) OVER w AS r1, CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM f0 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
f2 AS (SELECT *, sign(coalesce(r1, 0)) AS sgn FROM f1),
f3 AS (SELECT *, coalesce(last_value(nullif(sgn, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS pers,
              CASE WHEN sgn <> lag(sgn) OVER (PARTITION BY symbol ORDER BY date) THEN 1 ELSE 0 END AS turn FROM f2),
f4 AS (SELECT *, CASE WHEN pers <> 0 AND coalesce(lag(pers) OVER w <> 0, true) AND pers IS DISTINCT FROM lag(pers) OVER w THEN 1.0 ELSE 0.0 END AS switch,
              sum(turn) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM f3 WINDOW w AS (PARTITION BY symbol ORDER BY date))"""

EWMA = """
sq AS (SELECT symbol, date, rn - 1 AS k, r1 * r1 AS x FROM f1 WHERE r1 IS NOT NULL),
ew AS (SELECT symbol, date, k, x AS e FROM sq WHERE k = 1
       UNION ALL SELECT s.symbol, s.date, s.k, ew.e + (s.x - ew.e) * 2.0 / 21 FROM ew JOIN sq s ON s.symbol = ew.symbol AND s.k = ew.k + 1)"""


def features_cte() -> str:
    """CTEs up to ``feats``, bars with every price feature, and ``store``, the same with eight decimals."""
    kept = ", ".join(f"round({k}, 8) + 0.0 AS {k}" for k in ("open", "high", "low", "close", "volume", *price_expressions()))
    each = ",\n".join(f"{e} AS {k}" for k, e in price_expressions().items())
    return f"{BARS},{STEPS},\nfeats AS (SELECT symbol, date, open, high, low, close, volume, rn, {each} FROM f4 {WINDOWS}),\nstore AS (SELECT symbol, date, rn, {kept} FROM feats)"


def family(names: list[str]) -> str:
    return f"WITH {features_cte()} SELECT symbol, date, {', '.join(f'{r(n)} AS {n}' for n in names)} FROM feats"
