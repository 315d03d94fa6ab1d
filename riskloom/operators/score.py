"""Scoring of tables and streams: one lazy projection chain, no action."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import grouped_number_or_null, is_numeric, quoted
from ..plans.small import local_frame
from ..sources.bundles import Bundle
from .features import Derived, align_features, derive, finite_or_zero
from .rules import Rule, apply_rules


def coerce_raw(df: DataFrame, cols: list[str]) -> DataFrame:
    """Raw fields to numbers: absent, empty or unparsable becomes 0."""
    def one(c: str):
        x = quoted(c)
        number = x.cast("double") if is_numeric(df.schema[c].dataType) else grouped_number_or_null(x.cast("string"))
        return F.coalesce(number, F.lit(0.0)).alias(c)

    return df.select(*[one(c) if c in cols else quoted(c) for c in df.columns])


def decide(df: DataFrame, probability: str, threshold: float) -> DataFrame:
    """Add prediction (p >= threshold) and confidence, the distance of p from one half, doubled."""
    p = quoted(probability)
    return df.withColumns(
        {
            "prediction": F.when(p >= F.lit(float(threshold)), F.lit(1)).otherwise(F.lit(0)),
            "confidence": F.abs(p - F.lit(0.5)) * F.lit(2.0),
        }
    )


def check_features(count: int, bundle: Bundle) -> None:
    want = bundle.model_features()
    if count != want:
        raise ValueError(f"feature count mismatch: the model expects {want}, got {count}")


def score(df: DataFrame, bundle: Bundle, specs: list[Derived] = ()) -> DataFrame:
    """Add prediction, probability and confidence. The input columns stay as they are, but for earlier scores, which are replaced."""
    # the input travels under names of its own, column by column, so that unused columns are still pruned
    keep = {f"_in{i}": c for i, c in enumerate(df.columns) if c not in ("prediction", "probability", "confidence")}
    staged = df.withColumns({k: quoted(c) for k, c in keep.items()})
    aligned = align_features(staged, bundle.selected, specs, keep=list(keep))
    check_features(len([c for c in aligned.columns if c not in keep]), bundle)
    scaled = bundle.scaler.transform(finite_or_zero(aligned, bundle.selected))
    ready = scaled.select(*keep, array_to_vector(F.array(*[quoted(c) for c in bundle.selected])).alias("features"))
    scored = bundle.model.transform(ready).select(
        *[F.col(k).alias(c) for k, c in keep.items()], vector_to_array(F.col("probability"))[1].alias("probability")
    )
    return decide(scored, "probability", bundle.threshold)


def label_result(df: DataFrame, mapping: dict[int, str], out: str = "result_text") -> DataFrame:
    """Add the text of the prediction."""
    return df.withColumn(out, F.when(F.col("prediction") == 1, F.lit(mapping[1])).otherwise(F.lit(mapping[0])))


NO_DATA = "no data"


def reject_empty(df: DataFrame, answers: list[str], has_data: str = "has_data", out: str = "error") -> DataFrame:
    """Add `out`: why a record gets no answer, else null. Empty and malformed records lose all `answers`."""
    ok = F.coalesce(quoted(has_data), F.lit(False))
    nulled = df.withColumns({c: F.when(ok, quoted(c)) for c in answers if c in df.columns})
    return nulled.withColumn(out, F.when(~ok, F.lit(NO_DATA)))


ANSWERS = ["prediction", "probability", "confidence", "result_text", "recommendations", "feature_importance"]


def score_report(
    df: DataFrame,
    bundle: Bundle,
    rules: list[Rule],
    fallback: str,
    texts: dict[int, str],
    specs: list[Derived] = (),
    raw: list[str] | None = None,
    present: str | None = None,
    has_data: str = "has_data",
) -> DataFrame:
    """The full answer per record: raw fields to numbers, derived fields, score, text, advice, importances.

    `raw` lists the fields of a record; all other columns pass through. Where
    the input has the column `has_data`, as records read from JSON do, empty and
    malformed records get null answers and a text in `error`.
    """
    raw = [c for c in df.columns if c not in (present, has_data)] if raw is None else raw
    numbers = derive(coerce_raw(df, raw), list(specs), overwrite=True, on_missing="omit", present=present)
    scored = score(numbers, bundle, specs)
    told = apply_rules(label_result(scored, texts), rules, fallback)
    pairs = [x for f, v in bundle.importances().items() for x in (F.lit(f), F.lit(v))]
    answered = told.withColumn("feature_importance", F.create_map(*pairs))
    return reject_empty(answered, ANSWERS, has_data) if has_data in df.columns else answered


def model_info(spark, bundle: Bundle) -> DataFrame:
    """One row describing the model; absent metadata take their defaults."""
    m = bundle.metadata
    row = (
        m.get("best_model_name", "Unknown"), float(m.get("accuracy", 0)), float(m.get("f1_score", 0)),
        float(m.get("optimal_threshold", 0.5)), list(bundle.selected),
        int(m.get("total_features_count", 0)), int(m.get("selected_features_count", 0)),
    )
    return local_frame(
        spark, [row],
        "model_name string, accuracy double, f1_score double, optimal_threshold double, "
        "selected_features array<string>, total_features int, selected_features_count int",
    )
