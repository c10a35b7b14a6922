"""Two-phase ranks and what is made of them, against plain versions; no window sees a whole group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, metrics, ranks


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    n = 900
    frame = pd.DataFrame({"g": np.where(np.arange(n) < 700, "big", "small"), "symbol": rng.choice(list("ab"), n), "date": pd.date_range("2020-01-01", periods=n).date, "score": np.round(rng.normal(size=n), 1), "y": np.round(rng.normal(size=n), 1)})
    frame.loc[::3, "score"] = 0.0  # one value holds a third of the rows
    frame.loc[5::50, "score"] = np.nan
    frame.loc[7::60, "y"] = np.nan
    frame["label"] = (rng.random(n) < 1 / (1 + np.exp(-2 * frame["score"].fillna(0)))).astype(int)
    return frame


@pytest.fixture(scope="module")
def rows(spark, table):
    clean = [F.when(~F.isnan(n), F.col(n)).alias(n) for n in ("score", "y")]
    return spark.createDataFrame(table.sample(frac=1, random_state=2)).select("g", "symbol", "date", *clean, "label").repartition(5)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_row_numbers_and_running_sums(rows, table, parts):
    got = ranks.running_sums(rows, ["g"], [F.desc_nulls_last("score"), "date"], {"rn": F.lit(1), "hits": F.col("label")}, parts).toPandas()
    want = table.assign(a=-table["score"].fillna(-np.inf)).sort_values(["a", "date"])
    want["rn"], want["hits"] = want.groupby("g").cumcount() + 1, want.groupby("g")["label"].cumsum()
    both = got.merge(want, on=["g", "date"], suffixes=("", "_w"))
    assert len(both) == 900 and (both["rn"] == both["rn_w"]).all() and (both["hits"] == both["hits_w"]).all()
    assert (both["rn_all"] == both.groupby("g")["rn_w"].transform("max")).all() and (both["hits_all"] == both.groupby("g")["label"].transform("sum")).all()


def test_mean_ranks_of_ties(rows, table):
    got = {(r["g"], r["score"]): r["r"] for r in ranks.average_ranks(rows, ["g"], "score", "r", parts=7).collect()}
    want = table.dropna(subset=["score"]).assign(r=lambda t: t.groupby("g")["score"].rank())
    assert got == {(g, s): r for g, s, r in zip(want["g"], want["score"], want["r"])}


def test_correlations(rows, table):
    got = {r["g"]: r for r in audit.spearman(rows, ["g"], "score", "y").collect()}
    for g, part in table.groupby("g"):
        ranked = pd.DataFrame({"a": part["score"].rank(), "b": part["y"].rank()}).dropna()
        assert got[g]["pearson"] == pytest.approx(part["score"].corr(part["y"])) and got[g]["spearman"] == pytest.approx(ranked["a"].corr(ranked["b"]))
    flat = audit.spearman(rows.withColumn("y", F.lit(2.0)), ["g"], "score", "y").collect()
    assert all(r["pearson"] is None and r["spearman"] is None for r in flat)


def test_areas_over_ranges(spark, rows, table):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r["g"]: r for r in metrics.classification(rows, ["g"]).collect()}
            for g, part in table.dropna(subset=["score"]).groupby("g"):
                pos, neg = part[part["label"] == 1]["score"].to_numpy(), part[part["label"] == 0]["score"].to_numpy()
                wins = (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2
                steps = [((part["score"] == s) & (part["label"] == 1)).sum() * (part[part["score"] >= s]["label"].mean()) for s in part["score"].unique()]
                assert got[g]["roc_auc"] == pytest.approx(wins) and got[g]["average_precision"] == pytest.approx(sum(steps) / len(pos)) and got[g]["n"] == len(part)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_top_rows_and_buckets(rows, table):
    top = metrics.top_share(rows, ["g"], 0.1).toPandas()
    want = table.assign(a=-table["score"].fillna(-np.inf)).sort_values(["a", "symbol", "date"]).groupby("g").head(10**6)
    want = pd.concat([part.head(int(np.ceil(len(part) * 0.1))) for _, part in want.groupby("g")])
    assert sorted(top["date"]) == sorted(want["date"])
    got = audit.bucketed(rows, ["score"], ["y"]).toPandas()
    known = table.dropna(subset=["score", "y"]).sort_values(["score", "date", "symbol"]).reset_index(drop=True)
    known["bucket"] = pd.qcut(known.index.to_series() + 1, 5, labels=False).to_numpy()
    both = got.merge(known, on="date", suffixes=("", "_w"))
    assert len(both) == len(known) and (both["bucket"] == both["bucket_w"]).all()
