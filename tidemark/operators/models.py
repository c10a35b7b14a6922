"""Regime and event models: a Gaussian hidden Markov model, calibrated logistic models and score combiners."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import complete, quantiles
from tidemark.operators import scans
from tidemark.operators.scans import log_sum
from tidemark.sources.storage import stored

c = F.col

# Model inputs and settings.
HMM_INPUTS = ("r1", "TS_50", "ER_20", "atr_pct", "band_pos", "relative_volume_20")
HAZARD_INPUTS = ("TS_20", "TS_50", "TS_200", "ER_20", "vol_20", "atr_pct", "band_pos", "band_w", "dist_from_mean_vol_units", "relative_volume_20", "return_accel")
STATES, ROUNDS, TOLERANCE, STICKY, FLOOR, LEAST_ROWS = 4, 80, 1e-4, 0.85, 1e-4, 250
LABELS = ("CORE", "DRIFT", "SHOCK", "SURGE")
SIGNATURE = ("r1", "TS_20", "TS_50", "ER_20", "vol_20", "atr_pct", "ewma_vol", "band_w", "band_pos", "dist_from_mean_vol_units", "relative_volume_20")


def _log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None] - mean[None]) ** 2 / var[None]).sum(axis=2)


def _seeded(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cluster of each row: k-means with far-apart seeds."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum() if d.sum() > 0 else None)]])
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[own == j].mean(axis=0) if (own == j).any() else x[rng.integers(len(x))] for j in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return own


def signatures(values: dict[str, np.ndarray], posterior: np.ndarray, move: np.ndarray) -> dict[str, np.ndarray]:
    """For each state the posterior-weighted means of the known values, its occupancy and its chance to stay."""
    out = {}
    for name, x in values.items():
        known = np.isfinite(x)
        weight = posterior[known].sum(axis=0)
        with np.errstate(invalid="ignore"):
            out[name] = np.where(weight > 0, posterior[known].T @ x[known] / weight, np.nan)
    return out | {"occupancy": posterior.mean(axis=0), "self_transition": np.diag(move)}


def name_states(found: dict[str, np.ndarray]) -> list[int]:
    """The state of each of ``LABELS``: of all assignments the one of highest score on z-scored signatures; the first of equals."""

    def z(name: str) -> np.ndarray:
        x = found.get(name)
        if x is None:
            return np.zeros(len(found["occupancy"]))
        sd = np.nanstd(x)
        return (x - np.nanmean(x)) / sd if np.isfinite(sd) and sd > 0 else np.zeros(len(x))

    # What speaks for each name.
    direction = z("r1") + 0.35 * z("TS_20") + 0.45 * z("TS_50") + 0.20 * z("band_pos")
    quality = 0.45 * np.abs(z("TS_20")) + 0.35 * np.abs(z("TS_50")) + 0.55 * z("ER_20")
    volatility = z("vol_20") + 0.75 * z("atr_pct") + 0.50 * z("ewma_vol") + 0.40 * z("band_w")
    stretch = np.abs(z("dist_from_mean_vol_units"))
    claim = {
        "CORE": -1.10 * volatility - 0.90 * np.abs(direction) - 0.50 * stretch + 0.40 * z("occupancy") + 0.35 * z("self_transition"),
        "DRIFT": 0.95 * direction + 0.80 * quality - 0.55 * volatility + 0.40 * z("self_transition") - 0.20 * stretch,
        "SHOCK": -1.00 * direction + 1.05 * volatility - 0.30 * quality + 0.20 * stretch - 0.10 * z("band_pos"),
        "SURGE": 1.10 * direction + 0.65 * quality + 0.80 * volatility + 0.20 * z("band_pos") + 0.10 * stretch,
    }
    names = max(itertools.permutations(LABELS), key=lambda order: sum(claim[n][s] for s, n in enumerate(order)))
    return [names.index(n) for n in LABELS]


def smoothed(z: np.ndarray, start: np.ndarray, move: np.ndarray, mu: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(posteriors given all rows, expected transitions, log likelihood) of standardised rows in order."""
    b, la = _log_density(z, mu, var), np.log(move + 1e-12)
    alpha, beta = np.empty_like(b), np.zeros_like(b)
    alpha[0] = np.log(start + 1e-12) + b[0]
    for t in range(1, len(z)):
        alpha[t] = b[t] + log_sum(alpha[t - 1][:, None] + la, 0)
    for t in range(len(z) - 2, -1, -1):
        beta[t] = log_sum(la + (b[t + 1] + beta[t + 1])[None], 1)
    total = float(log_sum(alpha[-1], 0))
    gamma = np.exp(alpha + beta - total)
    pair = np.exp(alpha[:-1, :, None] + la[None] + (b[1:] + beta[1:])[:, None, :] - total).sum(axis=0)
    return gamma / gamma.sum(axis=1, keepdims=True), pair, total


def initial_parameters(size: np.ndarray, sums: np.ndarray, squares: np.ndarray, overall: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, transitions, means and variances of clusters of standardised rows: from their sizes, sums and sums of squares."""
    k = len(size)
    n = np.maximum(size, 1)[:, None]
    mu = np.where(size[:, None] > 0, sums / n, overall[0])
    var = np.where(size[:, None] > 1, np.maximum(squares / n - (sums / n) ** 2, FLOOR), overall[1] + FLOOR)
    move = np.full((k, k), (1 - STICKY) / (k - 1))
    np.fill_diagonal(move, STICKY)
    return (size + 1.0) / (size + 1.0).sum(), move, mu, var


def reestimated(first: np.ndarray, weight: np.ndarray, pair: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The M step: start, transitions, means and variances from expected counts, sums and sums of squares of the rows."""
    w = (weight + 1e-12)[:, None]
    move = np.clip(pair / (pair.sum(axis=1, keepdims=True) + 1e-12), 1e-8, 1.0)
    mu = sums / w
    var = np.maximum((squares - 2 * mu * sums + mu * mu * weight[:, None]) / w, FLOOR)
    return first / first.sum(), move / move.sum(axis=1, keepdims=True), mu, var


def fitted_pack(mean: np.ndarray, sd: np.ndarray, params: tuple, total: float, rows: int, states: list[int]) -> dict:
    start, move, mu, var = params
    k, d = mu.shape
    free = (k - 1) + k * (k - 1) + 2 * k * d
    return {"mean": mean.tolist(), "sd": sd.tolist(), "start": start.tolist(), "move": move.tolist(), "mu": mu.tolist(), "var": var.tolist(), "states": states, "log_likelihood": total, "aic": 2 * free - 2 * total, "bic": free * np.log(rows) - 2 * total, "inputs": list(HMM_INPUTS)}


def fit_hmm(x: np.ndarray, described: dict[str, np.ndarray] | None = None, k: int = STATES, seed: int = 42, own: np.ndarray | None = None, rounds: int = ROUNDS) -> dict:
    """Baum-Welch on standardised rows in order; ``states`` holds the state of each of ``LABELS``, named by the signatures of ``described``. ``own``: each row's first cluster."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1.0
    z = (x - mean) / sd
    own = _seeded(z, k, np.random.default_rng(seed)) if own is None else own
    member = (own[:, None] == np.arange(k)).astype(float)
    params = initial_parameters(member.sum(axis=0), member.T @ z, member.T @ (z * z), np.array([z.mean(axis=0), z.var(axis=0)]))
    last, total = -np.inf, -np.inf
    for turn in range(rounds):
        gamma, pair, total = smoothed(z, *params)
        params = reestimated(gamma[0], gamma.sum(axis=0), pair, gamma.T @ z, gamma.T @ (z * z))
        if turn > 2 and abs(total - last) < TOLERANCE * (1 + abs(last)):
            break
        last = total
    posterior, _, _ = smoothed(z, *params)
    found = signatures(described or dict(zip(HMM_INPUTS, x.T, strict=True)), posterior, params[1])
    return fitted_pack(mean, sd, params, total, len(z), name_states(found) if k == len(LABELS) else list(range(k)))


# ------------------------------------------------------------------ one long series


#: Ranges whose messages are sent to every executor; beyond that they are joined.
BROADCAST_RANGES = 100_000


def _range_messages(z: np.ndarray, before: np.ndarray | None, after: np.ndarray, params: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of a range's rows and its expected transitions, the one into it included, from the log messages at its ends."""
    start, move, mu, var = params
    b, la = _log_density(z, mu, var), np.log(move + 1e-12)
    alpha, beta = np.empty_like(b), np.empty_like(b)
    a = before
    for t in range(len(z)):
        a = b[t] + (np.log(start + 1e-12) if a is None else log_sum(a[:, None] + la, 0))
        a = a - log_sum(a, 0)
        alpha[t] = a
    back = after
    for t in range(len(z) - 1, -1, -1):
        beta[t] = back
        back = log_sum(la + (b[t] + back)[None], 1)
        back = back - log_sum(back, 0)
    gamma = alpha + beta
    gamma = np.exp(gamma - log_sum(gamma, 1)[:, None])
    previous = np.vstack([np.zeros((0, len(mu))) if before is None else before[None], alpha[:-1]])
    pair = previous[:, :, None] + la[None] + (b + beta)[len(b) - len(previous) :, None, :]
    pair = np.exp(pair - log_sum(log_sum(pair, 2), 1)[:, None, None])
    return gamma, pair.sum(axis=0)


def _summed(parts: DataFrame, lengths: dict[str, int]) -> dict[str, np.ndarray]:
    """Sums of array columns, one number of an array a row: partial sums leave each task."""
    x = parts.select(F.posexplode(F.concat(*lengths)).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(sum(lengths.values()))
    for r in x:
        flat[r["at"]] = r["v"]
    out, at = {}, 0
    for name, n in lengths.items():
        out[name], at = flat[at : at + n], at + n
    return out


def fit_hmm_ranges(rows: DataFrame, ranges: Column | None = None, order: str = "date", k: int = STATES, own: str | None = None, rounds: int = ROUNDS, seed: int = 42) -> dict:
    """``fit_hmm`` of one series too long for one task.

    The rows are cut into ranges (of days by default; a range bounds what a task holds), whose
    log matrices are multiplied in order for the messages at the seams. With those each
    range has its own posteriors; tasks hand on sums, from which the driver makes the
    next parameters. First clusters come from distributed k-means with oversampled seeds, or from column ``own``.
    """
    spark, inputs = rows.sparkSession, list(HMM_INPUTS)
    d = len(inputs)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m_{n}") for n in inputs], *[F.stddev_pop(n).alias(f"s_{n}") for n in inputs]).first()
    mean, sd = (np.array([stats[f"{p}_{n}"] for n in inputs]) for p in "ms")
    sd[sd == 0] = 1.0
    scaled = F.array(*[(c(n) - F.lit(float(m))) / F.lit(float(s)) for n, m, s in zip(inputs, mean, sd)])
    placed = rows.select((scans.days_of(order) if ranges is None else ranges).cast("long").alias("_range"), c(order).alias("_at"), scaled.alias("z"), *([c(own).alias("_own")] if own else []))
    if own is None:
        placed = _clustered(placed, k, seed)
    member = [c("_own") == j for j in range(k)]

    def of_members(value) -> Column:
        return F.flatten(F.array(*[F.when(m, F.transform("z", value)).otherwise(F.array_repeat(F.lit(0.0), d)) for m in member]))

    first = _summed(placed.select(F.array(*[m.cast("double") for m in member]).alias("size"), of_members(lambda v: v).alias("sums"), of_members(lambda v: v * v).alias("squares")), {"size": k, "sums": k * d, "squares": k * d})
    sums, squares = first["sums"].reshape(k, d), first["squares"].reshape(k, d)
    overall = np.array([sums.sum(axis=0), squares.sum(axis=0)]) / stats["n"]
    params = initial_parameters(first["size"], sums, squares, np.array([overall[0], overall[1] - overall[0] ** 2]))
    chunks = stored(placed.groupBy("_range").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "z"))), lambda x: x["z"])).alias("z")), "hmm-ranges")
    few = chunks.count() <= BROADCAST_RANGES
    last, total = -np.inf, -np.inf
    for turn in range(rounds):
        counted, total = _expected(chunks, params, few, d)
        params = reestimated(counted["first"], counted["weight"], counted["pair"].reshape(k, k), counted["sums"].reshape(k, d), counted["squares"].reshape(k, d))
        if turn > 2 and abs(total - last) < TOLERANCE * (1 + abs(last)):
            break
        last = total
    counted, _ = _expected(chunks, params, few, d)
    found = {n: counted["sums"].reshape(k, d)[:, i] / (counted["weight"] + 1e-12) * sd[i] + mean[i] for i, n in enumerate(inputs)}
    found |= {"occupancy": counted["weight"] / stats["n"], "self_transition": np.diag(params[1])}
    return fitted_pack(mean, sd, params, total, stats["n"], name_states(found) if k == len(LABELS) else list(range(k)))


def _clustered(placed: DataFrame, k: int, seed: int) -> DataFrame:
    """Rows with the cluster of a distributed k-means, its seeds oversampled over all rows in a few rounds."""
    vectors = placed.withColumn("_v", array_to_vector("z"))
    model = KMeans(k=k, initMode="k-means||", initSteps=2, maxIter=12, seed=seed, featuresCol="_v", predictionCol="_own").fit(vectors)
    return model.transform(vectors).drop("_v")


def _expected(chunks: DataFrame, params: tuple, few: bool, d: int) -> tuple[dict[str, np.ndarray], float]:
    """The E step over stored ranges: expected counts and sums, and the log likelihood."""
    start, move, mu, var = params
    k = len(start)
    la, ls = np.log(move + 1e-12), np.log(start + 1e-12)

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, z in zip(batch["_range"], batch["z"]):
                head, rest = scans.chain_element(_log_density(np.asarray(z).reshape(-1, d), mu, var), la)
                out.append((at, head.tolist(), np.maximum(rest, -1e300).ravel().tolist()))
            yield pd.DataFrame(out, columns=["_range", "head", "rest"])

    def seams(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("_range")
        parts = [(np.array(h), np.array(r).reshape(k, k)) for h, r in zip(found["head"], found["rest"])]
        before, a, total = [], None, 0.0
        for head, rest in parts:
            before.append(None if a is None else a.tolist())
            a = scans.chain_step(a, head, rest, ls, la)
            size = log_sum(a, 0)
            a, total = a - size, total + float(size)
        after, back = [], np.zeros(k)
        for head, rest in reversed(parts):
            after.append(back.tolist())
            back = log_sum(la + (head + log_sum(rest + back[None], 1))[None], 1)
            back = back - log_sum(back, 0)
        return pd.DataFrame({"_range": found["_range"].to_numpy(), "before": before, "after": after[::-1], "total": total})

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {"first": np.zeros(k), "weight": np.zeros(k), "pair": np.zeros(k * k), "sums": np.zeros(k * d), "squares": np.zeros(k * d), "total": np.zeros(2)}
        for batch in batches:
            for z, before, after, total in zip(batch["z"], batch["before"], batch["after"], batch["total"]):
                z = np.asarray(z).reshape(-1, d)
                gamma, pair = _range_messages(z, None if before is None else np.asarray(before), np.asarray(after), params)
                if before is None:
                    held["first"] += gamma[0]
                    held["total"] += (total, 1)
                held["weight"] += gamma.sum(axis=0)
                held["pair"] += pair.ravel()
                held["sums"] += (gamma.T @ z).ravel()
                held["squares"] += (gamma.T @ (z * z)).ravel()
        yield pd.DataFrame({n: [v.tolist()] for n, v in held.items()})

    found = chunks.mapInPandas(elements, "_range long, head array<double>, rest array<double>")
    messages = found.groupBy(F.lit(0).alias("all")).applyInPandas(lambda one: seams(one), "_range long, before array<double>, after array<double>, total double")
    joined = chunks.join(F.broadcast(messages) if few else messages, "_range")
    lengths = {"first": k, "weight": k, "pair": k * k, "sums": k * d, "squares": k * d, "total": 2}
    counted = _summed(joined.select("z", "before", "after", "total").mapInPandas(sums, ", ".join(f"{n} array<double>" for n in lengths)), lengths)
    return counted, float(counted["total"][0])


def filtered_regimes(rows: DataFrame, pack: dict, ranges: Column | None = None) -> DataFrame:
    """``rows`` (symbol, date and inputs) with the probability of each of ``LABELS`` given the rows so far, by a scan over ranges of days."""
    inputs = list(pack["inputs"])
    mean, sd, mu, var = (np.array(pack[n]) for n in ("mean", "sd", "mu", "var"))
    names = [f"P_{n}_HMM" for n in LABELS]
    by_state = [names[pack["states"].index(i)] for i in range(len(pack["start"]))]
    recursion = scans.markov_filter(inputs, lambda x: _log_density((x - mean) / sd, mu, var), np.log(np.array(pack["start"]) + 1e-12), np.log(np.array(pack["move"]) + 1e-12), by_state)
    kept = rows.select("symbol", "date", *inputs).na.drop(subset=inputs)
    kinds = ", ".join(f"{n} {kept.schema[n].dataType.simpleString()}" for n in kept.columns)
    return scans.scan(kept, recursion, kinds + "".join(f", {n} double" for n in by_state), ranges).select("symbol", "date", *names)


def hmm_regimes(features: DataFrame) -> DataFrame:
    """(symbol, date, P_*_HMM, state_hmm_label, hmm_confidence): filtered probabilities, from a model fitted to each series.

    Rows with a missing input are left out; a series with fewer than ``LEAST_ROWS`` has none.
    A series has one row a day, which bounds its group.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        columns = ["symbol", "date", *[f"P_{n}_HMM" for n in LABELS], "state_hmm_label", "hmm_confidence"]
        if len(rows) < LEAST_ROWS:
            return pd.DataFrame(columns=columns)
        x = rows[list(HMM_INPUTS)].to_numpy(dtype=float)
        pack = fit_hmm(x, {n: rows[n].to_numpy(dtype=float) for n in SIGNATURE if n in rows})
        p = apply_hmm(pack, x)[:, pack["states"]]
        out = pd.DataFrame(p, columns=columns[2:6])
        return out.assign(symbol=rows["symbol"].to_numpy(), date=rows["date"].to_numpy(), state_hmm_label=[LABELS[i] for i in p.argmax(axis=1)], hmm_confidence=p.max(axis=1))[columns]

    schema = "symbol string, date date, " + ", ".join(f"P_{n}_HMM double" for n in LABELS) + ", state_hmm_label string, hmm_confidence double"
    described = [n for n in SIGNATURE if n in features.columns and n not in HMM_INPUTS]
    return features.select("symbol", "date", *HMM_INPUTS, *described).na.drop(subset=list(HMM_INPUTS)).groupBy("symbol").applyInPandas(run, schema)


def apply_hmm(pack: dict, x: np.ndarray, before: Sequence[float] | None = None) -> np.ndarray:
    """State probabilities given the rows so far; ``before``: those of the row before the first."""
    z = (x - np.array(pack["mean"])) / np.array(pack["sd"])
    b, la = _log_density(z, np.array(pack["mu"]), np.array(pack["var"])), np.log(np.array(pack["move"]) + 1e-12)
    out = np.empty_like(b)
    a = None if before is None else np.log(np.array(before) + 1e-300)
    for t in range(len(z)):
        a = b[t] + (np.log(np.array(pack["start"]) + 1e-12) if a is None else log_sum(a[:, None] + la, 0))
        a = a - log_sum(a, 0)
        out[t] = np.exp(a)
    return out


def save_pack(spark, pack: dict, path: str) -> None:
    """Write a pack as a line of JSON where Spark can read it."""
    spark.createDataFrame([(json.dumps(pack),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_pack(spark, path: str, inputs: Sequence[str]) -> dict:
    pack = json.loads(spark.read.text(path).first()["value"])
    if pack["inputs"] != list(inputs):
        raise ValueError("the pack was fitted on other inputs")
    return pack


def fit_logistic(rows: DataFrame, inputs: Sequence[str], label: str, balanced: bool = True, strength: float = 1.0, classes: int = 2):
    """A Spark ML logistic model on standardised inputs, and its scaling: missing values take the median, the objective is the summed loss with ``strength``."""
    stats = rows.agg(*[quantiles(c(n), [0.5])[0].alias(f"m_{n}") for n in inputs], F.count(F.lit(1)).alias("n"), *[F.count_if(c(label) == k).alias(f"k_{k}") for k in range(classes)]).first()
    filled = rows.select("*", *[F.coalesce(c(n), F.lit(stats[f"m_{n}"]), F.lit(0.0)).alias(f"x_{n}") for n in inputs])
    scale = filled.agg(*[F.avg(f"x_{n}").alias(f"a_{n}") for n in inputs], *[F.stddev_pop(f"x_{n}").alias(f"s_{n}") for n in inputs]).first()
    pack = {"inputs": list(inputs), "median": [stats[f"m_{n}"] or 0.0 for n in inputs], "mean": [scale[f"a_{n}"] for n in inputs], "sd": [scale[f"s_{n}"] or 1.0 for n in inputs]}
    weight = F.lit(1.0)
    if balanced:
        weight = sum((F.when(c(label) == k, stats["n"] / (classes * max(1, stats[f"k_{k}"]))).otherwise(0.0) for k in range(classes)), F.lit(0.0))
    prepared = scaled(rows.withColumn("_w", weight), pack)
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1.0 / (strength * max(1, stats["n"])), standardization=False, maxIter=200, tol=1e-9, family="multinomial" if classes > 2 else "binomial").fit(prepared)
    return model, pack


def scaled(rows: DataFrame, pack: dict) -> DataFrame:
    """``rows`` with the model's input vector ``_x``."""
    each = {f"_x_{n}": (F.coalesce(c(n), F.lit(m)) - a) / s for n, m, a, s in zip(pack["inputs"], pack["median"], pack["mean"], pack["sd"], strict=True)}
    return VectorAssembler(inputCols=list(each), outputCol="_x").transform(rows.withColumns(each)).drop(*each)


def predict(model, pack: dict, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the last class's probability in ``name`` and its margin in ``name_margin``."""
    done = model.transform(scaled(rows, pack))
    return done.withColumns({name: F.element_at(vector_to_array("probability"), -1), f"{name}_margin": F.element_at(vector_to_array("rawPrediction"), -1)}).drop("_x", "rawPrediction", "probability", "prediction")


def coefficients(model, pack: dict, spark) -> DataFrame:
    """(feature, coefficient, rank) by size."""
    rows = sorted(zip(pack["inputs"], model.coefficients.toArray().tolist(), strict=True), key=lambda x: -abs(x[1]))
    return spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(rows)], "feature string, coefficient double, rank int")


def hazard_labels(bars: DataFrame, fitted: DataFrame, horizon: int = 10, at: float = 0.70) -> DataFrame:
    """(symbol, date, fall, rise, correction, rebound): forward extremes, and whether they pass the fitted rows' quantile."""
    moves = bars.select("symbol", "date", (-(complete(F.min("low"), c("low"), horizon) / c("close") - 1)).alias("fall"), (complete(F.max("high"), c("high"), horizon) / c("close") - 1).alias("rise")).where(c("fall").isNotNull())
    cuts = moves.join(fitted.select("symbol", "date"), ["symbol", "date"]).agg(quantiles(c("fall"), [at])[0].alias("fc"), quantiles(c("rise"), [at])[0].alias("rc"))
    return moves.crossJoin(F.broadcast(cuts)).withColumns({"correction": (c("fall") > c("fc")).cast("int"), "rebound": (c("rise") > c("rc")).cast("int")}).drop("fc", "rc")


def calibrated(rows: DataFrame, inputs: Sequence[str], label: str, name: str) -> DataFrame:
    """``rows`` (with ``split``) and a probability: fitted on train, its margin calibrated on validation, clipped."""
    model, pack = fit_logistic(rows.where("split = 'train'"), inputs, label)
    marked = predict(model, pack, rows, "_p")
    calibrator, cpack = fit_logistic(marked.where("split = 'validation'"), ["_p_margin"], label, balanced=False)
    return predict(calibrator, cpack, marked, name).withColumn(name, F.least(F.greatest(c(name), F.lit(1e-6)), F.lit(1 - 1e-6))).drop("_p", "_p_margin", f"{name}_margin")


def combined(rows: DataFrame, inputs: Sequence[str], label: str, name: str) -> DataFrame:
    """``rows`` (with ``split``) and a score from a balanced logistic model of a few scores, fitted on train and validation."""
    model, pack = fit_logistic(rows.where(c("split").isin("train", "validation") & c(label).isNotNull()), inputs, label)
    return predict(model, pack, rows, name).drop(f"{name}_margin")
