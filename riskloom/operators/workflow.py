"""The training run: clean, derive, split, balance, rank, scale, search, fit, tune, report.

The few tables that several steps read (cleaned rows, balanced rows, scaled
training rows, scored test rows) are written once to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise, widen
from ..sources.bundles import Bundle
from .balance import smote
from .boost import BOOST_SPACE
from .clean import clean_table
from .evaluate import best_threshold, classification_report, select_best, threshold_sweep
from .features import Derived, derive, finite_or_zero
from .importance import rf_importance, selected_names
from .profile import numeric_columns
from .scale import RobustScale
from .score import align_features
from .split import assign_folds, stratified_split
from .tpe import guided_search
from .train import fit_families, predict_proba, search, training_frame


@dataclass
class TrainingRun:
    bundle: Bundle
    importance: DataFrame
    trials: DataFrame
    sweep: DataFrame
    report: DataFrame
    scored_test: DataFrame
    families: DataFrame  # one report per model family, the searched one included


def train(
    df: DataFrame,
    label: str,
    specs: list[Derived] = (),
    key: str | None = None,
    test: float = 0.4,
    seed: int = 42,
    k_neighbors: int = 3,
    fraction: float = 0.85,
    n_trials: int = 50,
    folds: int = 5,
    space=BOOST_SPACE,
    forest_trees: int = 100,
    forest_depth: int = 5,
    method: str = "exact",
    skip_zero_iqr: bool = False,
    parallelism: int = 2,
    model_name: str = "gbt",
    families: dict[str, Estimator] | None = None,
    probes: int | None = None,
    trials_at_once: int = 10,
) -> TrainingRun:
    """Run all steps. Any failing step raises; nothing is swallowed.

    With a `space` that has n_estimators, as the default one, second-order
    boosted trees are searched by guided trials, `trials_at_once` and all their
    folds in the same jobs. Any other space names parameters of MLlib's boosted
    trees, whose trials are drawn evenly.

    `families` names further tree estimators (label and features columns set),
    fitted on the same rows; the bundle takes the one with the best report on
    the test part. With `probes` the balancing step looks for neighbours in
    that many cells only, instead of exactly.
    """
    # clipping can make different rows equal, so their key comes from the distinct rows before it
    clean = clean_table(df, label, method, skip_zero_iqr, keep=(key,) if key else (), row_key=None if key else "row_key")
    key = key or "row_key"
    engineered = derive(clean, list(specs))
    features = numeric_columns(engineered, (label, key))
    ready = materialise(
        widen(engineered.select(key, quoted(label).cast("double").alias(label), *[quoted(f) for f in features])), "clean"
    )

    parts = materialise(stratified_split(ready, label, key, test, seed), "parts")  # the balancing step reads it many times
    fit_part, test_part = parts.where(~F.col("is_test")), parts.where("is_test")
    balanced = materialise(widen(smote(fit_part, label, key, features, k_neighbors, seed, probes=probes).drop("synthetic")), "balanced")

    importance = rf_importance(balanced, features, label, forest_trees, seed, forest_depth)
    selected = selected_names(importance, fraction)
    scaler = RobustScale.fit(balanced, selected, method)
    scaled = scaler.transform(balanced.select(key, label, *[quoted(f) for f in selected]))
    if any(name == "n_estimators" for name, *_ in space):
        dealt = assign_folds(scaled, label, key, folds, seed)
        trials, params, model = guided_search(dealt, selected, label, "fold", n_trials, seed, space, folds, trials_at_once, key)
    else:
        dealt = assign_folds(training_frame(scaled, selected, label, key), label, key, folds, seed)
        trials, params, model = search(
            materialise(dealt.select("features", label, "fold"), "scaled"),
            label, "fold", n_trials, seed, space, folds, parallelism,
        )

    aligned = finite_or_zero(align_features(test_part, selected, specs, keep=[label]), selected)
    tested = scaler.transform(aligned)
    scored = materialise(predict_proba(model, tested, selected, "probability").select(label, "probability"), "scored")

    def judged(rows: DataFrame):
        sweep = threshold_sweep(rows, "probability", label)
        best = best_threshold(sweep).first()
        return sweep, best, classification_report(rows, label, "probability", best.t)

    sweep, best, report = judged(scored)
    results = report.withColumn("model", F.lit(model_name))
    if families:
        if model_name in families:
            raise ValueError(f"two families are named {model_name!r}")
        others, models, probabilities = fit_families(families, scaled, tested, selected, label)
        results = results.unionByName(others.select(*results.columns))
        chosen = select_best(results).first()
        if chosen is not None and chosen.model != model_name:
            model_name, params = chosen.model, {}
            model = models[model_name]
            scored = probabilities.select(quoted(label), quoted(f"p_{model_name}").alias("probability"))
            sweep, best, report = judged(scored)
    metadata = {
        "best_model_name": model_name,
        "optimal_threshold": best.t,
        "best_score": best.combined,
        "accuracy": best.acc,
        "f1_score": best.f1,
        "selected_features_count": len(selected),
        "total_features_count": len(features),
    }
    rows = [tuple(r) for r in importance.orderBy("rank").collect()]
    bundle = Bundle(model, scaler, selected, rows, metadata, {**params, "model_type": type(model).__name__})
    return TrainingRun(bundle, importance, trials, sweep, report, scored, results)


__all__ = ["TrainingRun", "train"]
