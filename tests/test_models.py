"""Regime models against plain sums over all paths, names, packs, joins that must not multiply, and online states."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import exposure, models, selection, similarity, swings


def test_smoothing_is_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    z, k = rng.normal(size=(5, 2)), 3
    start, move = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k)
    mu, var = rng.normal(size=(k, 2)), rng.uniform(0.5, 2, size=(k, 2))
    density = np.exp(models._log_density(z, mu, var))
    weight = {p: start[p[0]] * np.prod([density[t, s] for t, s in enumerate(p)]) * np.prod([move[a, b] for a, b in itertools.pairwise(p)]) for p in itertools.product(range(k), repeat=5)}
    total = sum(weight.values())
    gamma, pair, loglik = models.smoothed(z, start, move, mu, var)
    assert loglik == pytest.approx(np.log(total))
    assert gamma == pytest.approx(np.array([[sum(w for p, w in weight.items() if p[t] == s) / total for s in range(k)] for t in range(5)]))
    assert pair == pytest.approx(np.array([[sum(w * sum(x == (a, b) for x in itertools.pairwise(p)) for p, w in weight.items()) / total for b in range(k)] for a in range(k)]))
    pack = {"mean": [0.0, 0.0], "sd": [1.0, 1.0], "start": start, "move": move, "mu": mu, "var": var}
    whole = models.apply_hmm(pack, z)
    assert whole[-1] == pytest.approx(gamma[-1])  # the last row has no future
    assert np.vstack([models.apply_hmm(pack, z[:2]), models.apply_hmm(pack, z[2:], models.apply_hmm(pack, z[:2])[-1])]) == pytest.approx(whole)


def test_states_are_named_by_what_they_are():
    """Four plain regimes: calm, rising, falling and wild, rising and wild."""
    found = {"r1": [0.0, 0.004, -0.02, 0.02], "TS_20": [0.0, 0.5, -0.8, 0.9], "TS_50": [0.0, 0.5, -0.7, 0.6], "ER_20": [0.1, 0.4, 0.2, 0.5], "vol_20": [0.01, 0.012, 0.06, 0.05], "band_w": [0.05, 0.06, 0.2, 0.2], "band_pos": [0.5, 0.7, 0.1, 0.95], "dist_from_mean_vol_units": [0.0, 0.5, -2.0, 2.0], "occupancy": [0.5, 0.3, 0.1, 0.1], "self_transition": [0.97, 0.95, 0.85, 0.8]}
    for order in ([0, 1, 2, 3], [2, 0, 3, 1]):
        turned = {n: np.array(x)[order] for n, x in found.items()}
        assert models.name_states(turned) == [order.index(i) for i in range(4)]
    posterior = np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]])
    got = models.signatures({"r1": np.array([1.0, np.nan, 3.0])}, posterior, np.eye(2))
    assert got["r1"] == pytest.approx([(0.9 + 1.5) / 1.4, (0.1 + 1.5) / 0.6]) and got["occupancy"] == pytest.approx([1.6 / 3, 1.4 / 3])


def test_packs(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.3, size=(150, 6)), rng.normal(3, 1, size=(150, 6))])
    pack = models.fit_hmm(x)
    models.save_pack(spark, pack, str(tmp_path / "pack"))
    assert models.load_pack(spark, str(tmp_path / "pack"), models.HMM_INPUTS) == pack
    with pytest.raises(ValueError, match="other inputs"):
        models.load_pack(spark, str(tmp_path / "pack"), ["a"])
    view = selection.pack_view(pack)
    assert [sum(r) for r in view["move"]] == pytest.approx([1.0] * 4) and sorted(view["name_to_state"]) == sorted(models.LABELS)
    with pytest.raises(ValueError):
        selection.pack_view(pack | {"states": [0, 0, 1, 2]})
    with pytest.raises(ValueError):
        selection.pack_view(pack | {"move": [[1.0], [1.0]]})


def test_a_repeated_key_fails_the_join(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    two = spark.createDataFrame([(1, "c"), (3, "d")], "k int, y string")
    assert selection.one_to_one(one, two, ["k"]).collect() == [(1, "a", "c")]
    with pytest.raises(Exception, match="repeated key"):
        selection.one_to_one(one.unionByName(one), two, ["k"]).collect()
    with pytest.raises(ValueError, match="causal"):
        selection.causal_columns(["date", "next_close", "buy_zone_5pct"])
    with pytest.raises(ValueError, match="lack"):
        swings.overlay(one)


def test_fitted_regimes_drive_exposure(spark):
    """Features to regimes to exposure on a fitted model, held against a plain loop."""
    rng = np.random.default_rng(4)
    days = pd.date_range("2020-01-01", periods=400)
    wild = (np.arange(400) // 100) % 2 == 1
    data = {n: rng.normal(0, np.where(wild, 2.0, 0.5)) for n in models.HMM_INPUTS}
    frame = pd.DataFrame({"symbol": "s", "date": days.date, **data})
    features = spark.createDataFrame(frame).withColumn("P_CORRECTION_10D_CAL", F.lit(0.4)).withColumn("P_REBOUND_10D_CAL", F.lit(0.1))
    regimes = models.hmm_regimes(features)
    rows = features.drop("state_hmm_label").join(regimes, ["symbol", "date"]).cache()
    got = exposure.aggressive_exposure(rows).orderBy("date").collect()
    way, held, clip = 0, 0.0, lambda x, a, b: min(max(x, a), b)
    for r, x in zip(rows.orderBy("date").collect(), got, strict=True):
        core, drift, shock, surge = (r[f"P_{n}_HMM"] for n in models.LABELS)
        pos = clip(drift + surge, 0, 1)
        d, dominance = clip(pos - shock, -1, 1), clip((r["hmm_confidence"] - 0.35) / 0.35, 0, 1)
        conviction = clip(clip(pos + 0.5 * core, 0, 1) * dominance, 0, 1)
        if way >= 0:
            way = 1 if d > 0.1 else -1 if d < -0.2 else 0
        else:
            way = -1 if d < -0.1 else 1 if d > 0.2 else 0
        hazard = 0.4 if way >= 0 else 0.1
        now = clip(held + clip(way * conviction * (1 - hazard) ** 2 - held, -0.1, 0.1), -1, 1)
        step = max(0.0, abs(now) - abs(held)) if held == 0 or np.sign(now) == np.sign(held) else 0.0
        assert (x["direction"], x["exposure"], x["entry_step"]) == (way, pytest.approx(now), pytest.approx(step))
        held = now
    assert {r["direction"] for r in got} >= {0, 1} or len({r["direction"] for r in got}) > 1


def test_mahalanobis_distances(spark):
    rng = np.random.default_rng(3)
    rows = [("s", d.date(), float(a), float(b)) for d, (a, b) in zip(pd.date_range("2020-01-01", periods=80), rng.normal(size=(80, 2)), strict=True)]
    windows = similarity.sequences(spark.createDataFrame(rows, "symbol string, date date, a double, b double"), ["a", "b"], 3)
    got = {r["start_row"]: r["distance"] for r in similarity.similar_intervals(windows, "s", 40, 3, "mahalanobis").collect()}
    x = np.array([[v for r in rows[i : i + 3] for v in r[2:]] for i in range(78)])
    keep = [i for i in range(78) if abs(i + 1 - 40) >= 3]
    scaled = (x - x[keep].mean(axis=0)) / x[keep].std(axis=0)
    precision = np.linalg.inv(np.cov(scaled[keep].T) + 1e-6 * np.eye(6))
    for i in keep:
        d = scaled[i] - scaled[39]
        assert got[i + 1] == pytest.approx(np.sqrt(d @ precision @ d), rel=1e-6)
