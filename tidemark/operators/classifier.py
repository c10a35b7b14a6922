"""A classifier over numbers and categories, kept as one Spark ML pipeline that can be saved and loaded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import quantiles

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def column_kinds(rows: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns among ``columns``; those without any known value are left out."""
    known = rows.agg(*[F.count(F.nanvl(F.col(n), F.lit(None)) if rows.schema[n].dataType.simpleString() in ("float", "double") else F.col(n)).alias(n) for n in columns]).first()
    kinds = {n: rows.schema[n].dataType.simpleString() for n in columns if known[n]}
    found = [n for n, k in kinds.items() if k in NUMERIC or k.startswith("decimal")], [n for n, k in kinds.items() if k == "string"]
    if not found[0] and not found[1]:
        raise ValueError("no usable columns")
    return found


def preparation(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Stages up to the vector ``_features``.

    Numbers: missing ones take the exact median of ``train``, then all are standardised by
    its population deviation (1 where it is 0). Categories: missing ones take the most frequent,
    the least of equals; each known category has a place, an unknown one has none of them.
    """
    value = {n: F.nanvl(F.col(n).cast("double"), F.lit(None)) for n in numeric}
    columns, fills = [], []
    if numeric:
        medians = train.agg(*[quantiles(v, [0.5])[0].alias(n) for n, v in value.items()]).first()
        filled = train.select(*[F.coalesce(v, F.lit(medians[n])).alias(n) for n, v in value.items()])
        moments = filled.agg(*[F.avg(n).alias(f"m_{n}") for n in numeric], *[F.stddev_pop(n).alias(f"s_{n}") for n in numeric]).first()
        for n in numeric:
            known = f"coalesce(nanvl(CAST(`{n}` AS DOUBLE), NULL), {medians[n]!r}D)"
            fills.append(f"({known} - {moments[f'm_{n}']!r}D) / {moments[f's_{n}'] or 1.0!r}D AS `_n_{n}`")
            columns.append(f"_n_{n}")
    for n in categorical:
        common = train.where(F.col(n).isNotNull()).groupBy(n).count().orderBy(F.desc("count"), n).first()[0]
        quoted = common.replace("\\", "\\\\").replace("'", "\\'")
        fills.append(f"coalesce(`{n}`, '{quoted}') AS `_c_{n}`")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__")]
    if categorical:
        stages.append(StringIndexer(inputCols=[f"_c_{n}" for n in categorical], outputCols=[f"_i_{n}" for n in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"_i_{n}" for n in categorical], outputCols=[f"_h_{n}" for n in categorical], dropLast=True))
        columns += [f"_h_{n}" for n in categorical]
    return [*stages, VectorAssembler(inputCols=columns, outputCol="_features")]


def fit_classifier(train: DataFrame, columns: Sequence[str], label: str, strength: float = 1.0) -> PipelineModel:
    """A logistic model of ``label`` (0 or 1) with balanced classes: summed weighted loss times ``strength``, plus half the squared coefficients."""
    rows = train.where(F.col(label).isNotNull())
    numeric, categorical = column_kinds(rows, columns)
    n = {r[0]: r["count"] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
    if set(n) != {0, 1}:
        raise ValueError(f"{label} must hold both classes")
    total = sum(n.values())
    weighted = rows.withColumn("_weight", F.when(F.col(label) == 1, total / (2 * n[1])).otherwise(total / (2 * n[0])))
    model = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", probabilityCol="_probability", rawPredictionCol="_margin", predictionCol="_prediction", regParam=1.0 / (strength * total), standardization=False, maxIter=2000, tol=1e-12)
    return Pipeline(stages=[*preparation(rows, numeric, categorical), model]).fit(weighted)


def classify(model: PipelineModel, rows: DataFrame, name: str = "score") -> DataFrame:
    """``rows`` with the probability of class 1."""
    return model.transform(rows).withColumn(name, vector_to_array("_probability")[1]).select(*[c for c in rows.columns if c != name], name)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
