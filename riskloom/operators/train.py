"""Tree models, cross-validation and parameter search on MLlib."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import is_numeric, quoted
from ..plans.durable import materialise, use_shared_checkpoints
from ..plans.small import local_frame
from . import packs
from .evaluate import best_threshold, classification_report, combined, select_best, threshold_sweep
from .importance import assemble, importance_table

# The search ranges (name, kind, low, high).
SEARCH_SPACE = (
    ("maxIter", "int", 500, 1200),
    ("maxDepth", "int", 5, 12),
    ("stepSize", "log", 0.005, 0.1),
    ("subsamplingRate", "float", 0.7, 1.0),
    ("featureSubsetStrategy", "float", 0.7, 1.0),
    ("minInstancesPerNode", "int", 1, 10),
    # the gain is measured on another scale here, hence the smaller upper end
    ("minInfoGain", "float", 0.0, 0.005),
)


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """One row (n_negative, n_positive, weight); weight = negatives per positive, null without positives."""
    y = quoted(label).cast("double")
    return df.agg(F.count_if(y == 0.0).alias("n_negative"), F.count_if(y == 1.0).alias("n_positive")).withColumn(
        "weight", F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive").cast("double"))
    )


def gbt(label: str, params: dict | None = None, seed: int = 42, weight: str | None = None) -> GBTClassifier:
    """Boosted trees with log loss."""
    known = dict(params or {})
    if isinstance(known.get("featureSubsetStrategy"), float):
        known["featureSubsetStrategy"] = str(known["featureSubsetStrategy"])
    if weight:
        known["weightCol"] = weight
    return GBTClassifier(labelCol=label, featuresCol="features", lossType="logistic", seed=seed, **known)


def forest(label: str, params: dict | None = None, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed, **(params or {}))


def training_frame(df: DataFrame, features: list[str], label: str, *keep: str) -> DataFrame:
    cols = [quoted(c) for c in keep]
    return assemble(df, features).select("features", quoted(label).cast("double").alias(label), *cols)


def fit_gbt(df: DataFrame, features: list[str], label: str, params: dict | None = None, seed: int = 42, weight: str | None = None):
    """Fit boosted trees; only the searched parameters and the seed are set."""
    use_shared_checkpoints(df.sparkSession)
    keep = [weight] if weight else []
    plain = None
    if all(is_numeric(df.schema[c].dataType) for c in features):
        x = F.array(*[quoted(c).cast("double") for c in features]).alias("features")
        plain = df.select(x, quoted(label).cast("double").alias(label), *[quoted(c) for c in keep])
    return packs.fit(gbt(label, params, seed, weight), training_frame(df, features, label, *keep), plain)


def predict_proba(model, df: DataFrame, features: list[str], out: str = "probability_1") -> DataFrame:
    """Add the probability of the positive class."""
    scored = model.transform(assemble(df, features, "features"))
    return scored.select(*[quoted(c) for c in df.columns], vector_to_array(F.col("probability"))[1].alias(out))


def cv_score(
    estimator: Estimator, df: DataFrame, fold: str, label: str, k: int = 5, metric: str = "accuracy", parallelism: int = 2
) -> DataFrame:
    """(fold, score) of fitting on the other folds; `df` holds features, label and fold."""
    use_shared_checkpoints(df.sparkSession)
    found = packs.pack(df, [estimator], fold)
    scores = _fold_scores([estimator], df, found, fold, label, k, metric, parallelism)[0]
    return local_frame(df.sparkSession, list(enumerate(scores)), "fold int, score double")


def _fold_scores(
    estimators: list[Estimator], df: DataFrame, found: packs.Packs | None, fold: str, label: str, k: int, metric: str, parallelism: int
) -> list[list[float]]:
    """For each estimator the scores of all folds; on packs, the held-out rows are counted as often as they occur."""
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    if found is not None:
        judge.setWeightCol(packs.COUNT)

    def one(task: tuple[int, int]) -> float:
        estimator, f = estimators[task[0]], task[1]
        if found is None:
            model, held = estimator.fit(df.where(F.col(fold) != f)), df.where(F.col(fold) == f)
        else:
            model, held = found.fit(estimator, F.col(fold) != f), found.points(F.col(fold) == f)
        return float(judge.evaluate(model.transform(held)))

    tasks = [(e, f) for e in range(len(estimators)) for f in range(k)]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        scores = pool.map(inheritable_thread_target(df.sparkSession)(one), tasks, chunksize=1)
    return [scores[e * k : (e + 1) * k] for e in range(len(estimators))]


def mean_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("mean_score"))


def draw_trials(n_trials: int, seed: int = 42, space=SEARCH_SPACE) -> list[dict]:
    """Seeded draws from the space; parameters only, no data involved."""
    rng = np.random.default_rng(seed)
    trials = []
    for _ in range(n_trials):
        one = {}
        for name, kind, low, high in space:
            if kind == "int":
                one[name] = int(rng.integers(low, high + 1))
            elif kind == "log":
                one[name] = float(math.exp(rng.uniform(math.log(low), math.log(high))))
            else:
                one[name] = float(rng.uniform(low, high))
        trials.append(one)
    return trials


def search(
    df: DataFrame,
    label: str,
    fold: str,
    n_trials: int = 50,
    seed: int = 42,
    space=SEARCH_SPACE,
    k: int = 5,
    parallelism: int = 2,
):
    """(trial table, best parameters, model fitted with them on all rows).

    Each trial is scored by its mean accuracy over the folds; the first of
    equal trials wins. `df` holds features, label and an integer fold column.
    The trials run `parallelism` fits at a time and the winner is fitted again,
    on packs (`packs.py`) of a large table, otherwise by one CrossValidator call.
    """
    use_shared_checkpoints(df.sparkSession)
    trials = draw_trials(n_trials, seed, space)
    base = gbt(label, seed=seed)
    maps = []
    for t in trials:
        maps.append({base.getParam(n): str(v) if n == "featureSubsetStrategy" else v for n, v in t.items()})
    estimators = [base.copy(m) for m in maps]
    packed = packs.pack(df, estimators, fold)
    if packed is not None:
        scores = [float(np.mean(s)) for s in _fold_scores(estimators, df, packed, fold, label, k, "accuracy", parallelism)]
        best = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return _trial_table(df, trials, scores), trials[best], packed.fit(estimators[best])
    validator = CrossValidator(
        estimator=base,
        estimatorParamMaps=maps,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
        numFolds=k,
        foldCol=fold,
        parallelism=parallelism,
        seed=seed,
    )
    found = validator.fit(df)
    scores = [float(s) for s in found.avgMetrics]
    best = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return _trial_table(df, trials, scores), trials[best], found.bestModel


def _trial_table(df: DataFrame, trials: list[dict], scores: list[float]) -> DataFrame:
    rows = [(i, {n: float(v) for n, v in t.items()}, s) for i, (t, s) in enumerate(zip(trials, scores))]
    return local_frame(df.sparkSession, rows, "trial int, params map<string,double>, score double")


def model_importance(model, features: list[str], n: int | None = 10, spark=None) -> DataFrame:
    """(feature, importance, position, rank) of a fitted tree model, the `n` largest."""
    from pyspark.sql import SparkSession

    table = importance_table(spark or SparkSession.active(), features, model.featureImportances.toArray())
    return table.orderBy("rank") if n is None else table.orderBy("rank").limit(n)


def importance_map(model, features: list[str]) -> dict[str, float]:
    return {f: float(v) for f, v in zip(features, model.featureImportances.toArray())}


def fit_families(
    families: dict[str, Estimator], train: DataFrame, test: DataFrame, features: list[str], label: str
) -> tuple[DataFrame, dict, DataFrame]:
    """Fit every model family, tune its threshold on `test` and report.

    Returns (results with one row per family, fitted models, test rows with one
    probability column p_<name> per family).
    """
    use_shared_checkpoints(train.sparkSession)
    ready = training_frame(train, features, label)
    models, reports, scored = {}, [], test
    for name, est in families.items():
        models[name] = packs.fit(est, ready)
        scored = predict_proba(models[name], scored, features, f"p_{name}")
    probabilities = materialise(scored.select(quoted(label), *[quoted(f"p_{n}") for n in families]), "families")
    for name in families:
        t = best_threshold(threshold_sweep(probabilities, f"p_{name}", label)).first()["t"]
        reports.append((name, *classification_report(probabilities, label, f"p_{name}", t).first()))
    fields = classification_report(probabilities, label, f"p_{name}", 0.5).schema
    schema = "model string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    results = local_frame(train.sparkSession, reports, schema)
    return results.withColumn("score", combined(F.col("accuracy"), F.col("f1"))), models, probabilities


__all__ = [
    "SEARCH_SPACE", "cv_score", "draw_trials", "fit_families", "fit_gbt", "forest", "gbt", "importance_map",
    "mean_score", "model_importance", "positive_weight", "predict_proba", "search", "select_best", "training_frame",
]
