"""Blocked analog searches and whitened distances against plain loops."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import similarity

N = 130


@pytest.fixture(scope="module")
def series_rows():
    rng = np.random.default_rng(2)
    out = []
    for symbol in ("a", "b", "c"):
        for i in range(N if symbol != "c" else 1):
            v = None if rng.random() < 0.1 else [0.0] * 3 if rng.random() < 0.05 else rng.integers(-2, 3, 3).astype(float).tolist()  # many ties
            day = datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
            out.append((symbol, day, v, str(rng.choice(["down", "up"])), *(None if rng.random() < 0.1 else float(rng.integers(2)) for _ in range(2)), None if rng.random() < 0.3 else float(rng.integers(1, 6))))
    return out


def brute(rows, k, embargo, allowed):
    """For each row the places of its best earlier rows, with similarities."""
    found = {}
    for i, r in enumerate(rows):
        if r[2] is None or not np.any(r[2]):
            continue
        prior = [j for j in range(i) if j < i - embargo and rows[j][2] is not None and np.any(rows[j][2]) and allowed(rows[j])]
        s = [round(float(np.dot(r[2], rows[j][2]) / (np.linalg.norm(r[2]) * np.linalg.norm(rows[j][2]) + 1e-12)), 12) for j in prior]
        best = sorted(zip(s, prior), key=lambda x: (-x[0], -x[1]))[:k]
        if best:
            found[i] = best
    return found


@pytest.mark.parametrize(("block", "embargo"), [(17, 0), (64, 5), (1000, 0)])
def test_analogs_in_blocks(spark, series_rows, block, embargo):
    df = spark.createDataFrame(series_rows, "symbol string, date date, vector array<double>, way string, hit_5 double, hit_3 double, days double")
    got = {(r["symbol"], r["date"]): r for r in similarity.analogs(df, k=9, embargo=embargo, block=block).collect()}
    seen = 0
    for symbol in ("a", "b", "c"):
        rows = [r for r in series_rows if r[0] == symbol]
        want = brute(rows, 9, embargo, lambda r: r[3] == "down" and r[4] is not None)
        seen += len(want)
        for i, best in want.items():
            w = np.exp((np.array([s for s, _ in best]) - best[0][0]) / 0.15)
            r = got[symbol, rows[i][1]]
            assert r["matches"] == len(best) and r["analog_hit_5"] == pytest.approx(w @ [rows[j][4] for _, j in best] / w.sum())
            days = sorted((rows[j][6], x) for (_, j), x in zip(best, w) if rows[j][6] is not None)
            run = np.cumsum([x for _, x in days])
            assert r["analog_days"] == (days[int(np.searchsorted(run, 0.5 * run[-1]))][0] if days else None)
    assert seen == len(got) > 150


def test_memory_in_blocks(spark, series_rows):
    df = spark.createDataFrame(series_rows, "symbol string, date date, vector array<double>, way string, hit_5 double, hit_3 double, days double").withColumn("candidate", F.when(F.col("way") == "up", True))
    shares = {"hit_5": 0.75, "hit_3": 0.25}
    got = {(r["symbol"], r["date"]): r["score"] for r in similarity.memory_scores(df, shares, k=6, block=11).collect()}
    assert got == {(r["symbol"], r["date"]): pytest.approx(r["score"]) for r in similarity.memory_scores(df, shares, k=6, block=5000).collect()}
    rows = [r for r in series_rows if r[0] == "a"]
    for i, best in brute(rows, 6, 0, lambda r: r[3] == "up").items():
        w = np.exp((np.array([s for s, _ in best]) - best[0][0]) / 0.08)
        value = {}
        for at, share in ((4, 0.75), (5, 0.25)):
            known = [(x, rows[j][at]) for (_, j), x in zip(best, w) if rows[j][at] is not None]
            if known:
                value[share] = sum(x * y for x, y in known) / sum(x for x, _ in known)
        if value:
            assert got["a", rows[i][1]] == pytest.approx(sum(s * v for s, v in value.items()) / sum(value))


def test_wide_windows_are_whitened(spark):
    rng = np.random.default_rng(4)
    d = 600
    x = rng.normal(size=(90, d)) @ rng.normal(size=(d, d)) / 20
    x[:, 17] = 3.0  # constant
    rows = [("a", i * 10, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), datetime.date(2020, 1, 1) + datetime.timedelta(days=i + 9), v.tolist()) for i, v in enumerate(x)]
    windows = spark.createDataFrame(rows, "symbol string, start_row int, start_date date, end_date date, vector array<double>")
    got = {r["start_row"]: r["distance"] for r in similarity.similar_intervals(windows, "a", 300, 10, "mahalanobis").collect()}
    others = np.delete(x, 30, axis=0)
    sd = others.std(axis=0)
    sd[sd == 0] = 1
    z, q = (others - others.mean(axis=0)) / sd, (x[30] - others.mean(axis=0)) / sd
    inverse = np.linalg.inv(np.cov(z.T) + 1e-6 * np.eye(d))
    want = np.sqrt(np.einsum("ni,ij,nj->n", z - q, inverse, z - q))
    assert [got[i * 10] for i in range(90) if i != 30] == pytest.approx(want.tolist(), rel=1e-6)
