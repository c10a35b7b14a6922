"""A series cut into ranges gives what a loop over the whole series gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import exposure, models, price_features, scans

DAYS = 320


@pytest.fixture(scope="module")
def days():
    return pd.date_range("2020-01-01", periods=DAYS).date


def ranges(n):
    """Ranges of ``DAYS // n`` days."""
    return F.floor(F.datediff("date", F.lit("2020-01-01").cast("date")) / (DAYS // n))


def rows_of(df):
    return df.orderBy("symbol", "date").toPandas()


def same(a, b):
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for n in a.columns:
        if a[n].dtype.kind == "f":
            assert np.allclose(a[n], b[n].astype(float), rtol=0, atol=1e-12, equal_nan=True), n
        else:
            assert list(a[n]) == list(b[n]), n


def test_weighted_means_over_gaps_and_ranges(spark, days):
    rng = np.random.default_rng(0)
    close = {"a": np.exp(rng.normal(size=DAYS).cumsum() / 50), "b": np.full(DAYS, np.nan)}
    close["a"][[0, 9, 10, 11, 100, 319]] = np.nan
    close["a"][40:95] = np.nan
    frame = pd.concat([pd.DataFrame({"symbol": s, "date": days, "close": x}) for s, x in close.items()])
    bars = spark.createDataFrame(frame).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    r1 = np.log(pd.Series(close["a"])).diff()
    want = np.sqrt((r1**2).ewm(span=20, adjust=False, min_periods=20).mean())
    for n in (1, 5, 64, DAYS):
        got = rows_of(price_features.ewma_vol(bars, ranges=ranges(n)))
        assert np.allclose(got[got["symbol"] == "a"]["ewma_vol"].astype(float), want, rtol=1e-12, equal_nan=True) and got[got["symbol"] == "b"]["ewma_vol"].isna().all()


@pytest.fixture(scope="module")
def features(spark, days):
    rng = np.random.default_rng(3)
    frames = []
    for s, wild in (("a", 0.4), ("b", 2.0)):
        p = np.exp(wild * rng.normal(size=(DAYS, 4)).cumsum(axis=0) / 3)
        p /= p.sum(axis=1, keepdims=True)
        frame = pd.DataFrame(p, columns=[f"P_{n}_HMM" for n in models.LABELS]).assign(symbol=s, date=days, hmm_confidence=p.max(axis=1), state_hmm_label="SHOCK", TS_50=rng.normal(size=DAYS), band_pos=rng.random(DAYS))
        frames.append(frame.assign(P_CORRECTION_10D_CAL=rng.random(DAYS), P_REBOUND_10D_CAL=rng.random(DAYS)))
    return spark.createDataFrame(pd.concat(frames)).cache()


@pytest.mark.parametrize("profile", [exposure.safe_exposure, exposure.aggressive_exposure])
def test_exposures_over_ranges(features, profile):
    whole = rows_of(profile(features, ranges=F.lit(0)))
    assert whole["exposure"].nunique() > 100
    for n in (4, 64):
        same(rows_of(profile(features, ranges=ranges(n))), whole)
    same(rows_of(profile(features)), whole)


def test_maps_of_limited_moves_stay_small():
    rng = np.random.default_rng(1)
    for low, high in ((0.0, 1.0), (-1.0, 1.0)):
        for trial in range(40):
            through, steps = scans.Limited(low, high), []
            for _ in range(int(rng.integers(1, 60))):
                steps.append((rng.uniform(low, high), 0.5 if rng.random() < 0.1 else rng.choice([0.1, 0.02])))
                through.move(*steps[-1])
            assert len(through.at) < 120
            for x in rng.uniform(low, high, 20):
                held = x
                for goal, limit in steps:
                    held = min(high, max(low, held + min(limit, max(-limit, goal - held))))
                assert scans.limited_at(x, through.numbers()) == pytest.approx(held, abs=1e-12), trial
    usual = scans.Limited(-1.0, 1.0)
    for _ in range(5000):
        usual.move(rng.uniform(-1, 1), 0.1)
    assert len(usual.at) <= 24


@pytest.fixture(scope="module")
def regimes(days):
    rng = np.random.default_rng(7)
    state = np.repeat(rng.integers(4, size=DAYS // 8), 8)
    return state, rng.normal(state[:, None] * 1.5 * np.array([1, -1, 0.5, 1, 2, -0.5]), 0.7 + 0.3 * state[:, None])


def test_filtered_probabilities_over_ranges(spark, days, regimes):
    _, x = regimes
    pack = models.fit_hmm(x)
    frame = pd.concat([pd.DataFrame(y, columns=models.HMM_INPUTS).assign(symbol=s, date=days) for s, y in (("a", x), ("b", x[::-1]))])
    rows = spark.createDataFrame(frame)
    for n in (1, 64):
        got = rows_of(models.filtered_regimes(rows, pack, ranges(n)))
        for s, y in (("a", x), ("b", x[::-1])):
            assert np.allclose(got[got["symbol"] == s][[f"P_{n}_HMM" for n in models.LABELS]], models.apply_hmm(pack, y)[:, pack["states"]], atol=1e-12)


def test_fit_over_ranges_equals_the_fit_of_a_whole_series(spark, days, regimes):
    state, x = regimes
    own = (state + (np.arange(DAYS) % 11 == 0)) % 4
    rows = spark.createDataFrame(pd.DataFrame(x, columns=models.HMM_INPUTS).assign(date=days, own=own))
    want = models.fit_hmm(x, own=own, rounds=6)
    for n in (1, 64):
        got = models.fit_hmm_ranges(rows, ranges(n), own="own", rounds=6)
        for name in ("mean", "sd", "start", "move", "mu", "var", "log_likelihood", "aic", "bic"):
            assert np.allclose(got[name], want[name], rtol=1e-8, atol=1e-8), (n, name)
        assert got["states"] == want["states"]


def test_oversampled_seeds_are_as_good_as_local_ones(spark, days, regimes):
    _, x = regimes
    z = (x - x.mean(axis=0)) / x.std(axis=0)

    def cost(own):
        return sum(((z[own == j] - z[own == j].mean(axis=0)) ** 2).sum() for j in range(4) if (own == j).any())

    placed = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(z)], "_at long, z array<double>")
    found = [cost(np.array([r["_own"] for r in models._clustered(placed, 4, seed).orderBy("_at").collect()])) for seed in (1, 2, 3)]
    local = [cost(models._seeded(z, 4, np.random.default_rng(seed))) for seed in range(10)]
    assert max(found) <= 1.05 * max(local) and min(found) <= 1.05 * min(local)
    rows = spark.createDataFrame(pd.DataFrame(x, columns=models.HMM_INPUTS).assign(date=days))
    whole = [models.fit_hmm(x, seed=seed)["log_likelihood"] for seed in range(8)]
    assert models.fit_hmm_ranges(rows, ranges(8), rounds=30)["log_likelihood"] >= min(whole) - 0.02 * abs(min(whole))
