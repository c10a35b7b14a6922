"""The classifier pipeline against Newton's method on a hand-made matrix."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import classifier


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(0)
    n = 300
    frame = pd.DataFrame({"a": rng.normal(3, 2, n), "b": rng.integers(0, 9, n).astype(float), "flat": 4.0, "none": np.nan, "kind": rng.choice(["it's", "x", "yy"], n, p=[0.5, 0.3, 0.2]), "way": rng.choice(["down", "up"], n)})
    p = 1 / (1 + np.exp(-(0.6 * (frame["a"] - 3) + (frame["kind"] == "x") - 1.5)))
    frame["label"] = (rng.random(n) < p).astype(int)
    frame.loc[::7, "a"], frame.loc[3::11, "b"] = np.nan, np.nan
    frame.loc[2::13, "kind"] = None
    return frame.astype({"kind": object})


def plain(train, rows):
    """Probabilities by Newton's method."""
    x_train, x_rows = [], []
    for n in ("a", "b", "flat"):
        middle = np.nanmedian(train[n])
        filled = train[n].fillna(middle)
        sd = filled.std(ddof=0) or 1.0
        for part, out in ((train, x_train), (rows, x_rows)):
            out.append((part[n].fillna(middle) - filled.mean()) / sd)
    for n in ("kind", "way"):
        common = train[n].dropna().value_counts().sort_index().idxmax()
        for level in sorted(train[n].dropna().unique()):
            for part, out in ((train, x_train), (rows, x_rows)):
                out.append((part[n].where(part[n].notna(), common) == level).astype(float))
    x, z = np.column_stack([*x_train, np.ones(len(train))]), np.column_stack([*x_rows, np.ones(len(rows))])
    y = train["label"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (w * (p - y)) + ridge @ beta)
    return 1 / (1 + np.exp(-z @ beta))


def test_probabilities_and_a_saved_pipeline(spark, table, tmp_path):
    columns = ["a", "b", "flat", "none", "kind", "way"]
    clean = [F.when(~F.isnan(n), F.col(n)).alias(n) if n in ("a", "b", "flat", "none") else F.col(n) for n in [*columns, "label"]]
    train = table.iloc[:220]
    model = classifier.fit_classifier(spark.createDataFrame(train).select(*clean), columns, "label")
    odd = table.iloc[220:].copy()
    odd.loc[odd.index[:10], "kind"] = "never seen"
    odd.loc[odd.index[20:24], "way"] = None
    rows = spark.createDataFrame(odd.assign(i=range(len(odd))).drop(columns="label")).coalesce(1)
    got = [r["score"] for r in classifier.classify(model, rows).orderBy("i").collect()]
    assert got == pytest.approx(plain(train, odd).tolist(), abs=1e-6)
    classifier.save(model, str(tmp_path / "model"))
    again = classifier.classify(classifier.load(str(tmp_path / "model")), rows.drop("none"))
    assert [r["score"] for r in again.orderBy("i").collect()] == got and again.columns == [*[c for c in rows.columns if c != "none"], "score"]
    vector = model.transform(rows).orderBy("i").first()["_features"].toArray()
    assert vector[3:6].tolist() == [0.0, 0.0, 0.0]  # an unknown category has no place


def test_unusable_inputs_fail(spark, table):
    df = spark.createDataFrame(table[["none", "label"]])
    with pytest.raises(ValueError, match="usable"):
        classifier.fit_classifier(df, ["none"], "label")
    with pytest.raises(ValueError, match="both classes"):
        classifier.fit_classifier(df.withColumn("a", F.col("label") * 1.0).where("label = 1"), ["a"], "label")
