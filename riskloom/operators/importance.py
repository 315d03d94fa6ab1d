"""Feature ranking."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.small import local_frame
from . import packs

IMPORTANCE_SCHEMA = "feature string, importance double, position int, rank int"


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


def importance_rows(features: list[str], values) -> list[tuple]:
    """(feature, importance, position, rank); equal importances rank by name."""
    found = [(f, float(v), i) for i, (f, v) in enumerate(zip(features, values))]
    found.sort(key=lambda r: (-r[1], r[0]))
    return [(f, v, i, rank) for rank, (f, v, i) in enumerate(found, 1)]


def importance_table(spark: SparkSession, features: list[str], values) -> DataFrame:
    return local_frame(spark, importance_rows(features, values), IMPORTANCE_SCHEMA)


def rf_importance(
    df: DataFrame, features: list[str], label: str, numTrees: int = 100, seed: int = 42, maxDepth: int = 5, **params
) -> DataFrame:
    """(feature, importance, position, rank) of a random forest; importances sum to 1."""
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=numTrees, featureSubsetStrategy="sqrt",
        seed=seed, maxDepth=maxDepth, **params,
    )
    data = assemble(df, features).select("features", F.col(label).cast("double").alias(label))
    model = packs.fit(forest, data)
    return importance_table(df.sparkSession, features, model.featureImportances.toArray())


def select_top_fraction(importance: DataFrame, fraction: float = 0.85) -> DataFrame:
    """The int(fraction * n) most important features, most important first.

    One row per feature, so ordering it is a small job.
    """
    n = int(importance.count() * fraction)
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def selected_names(importance: DataFrame, fraction: float = 0.85) -> list[str]:
    return [r.feature for r in select_top_fraction(importance, fraction).collect()]
