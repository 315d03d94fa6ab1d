"""Threshold tuning and evaluation, each in one pass over the scored rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import quoted, ratio
from ..plans.ranking import running_totals
from ..plans.small import local_frame

ACCURACY_WEIGHT, F1_WEIGHT = 0.7, 0.3


def default_grid() -> list[float]:
    """80 thresholds from 0.1 in steps of 0.01, 0.9 excluded."""
    return [float(t) for t in np.arange(0.1, 0.9, 0.01)]


def _score(p: str) -> Column:
    # a row without a usable score is below every threshold
    c = quoted(p).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(float("-inf"))).otherwise(c)


def _positive(label: str) -> Column:
    return F.coalesce(quoted(label).cast("double") == 1.0, F.lit(False))


def accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return ratio(tp + tn, tp + fp + fn + tn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def combined(acc: Column, f: Column) -> Column:
    return F.lit(ACCURACY_WEIGHT) * acc + F.lit(F1_WEIGHT) * f


def threshold_sweep(df: DataFrame, p: str, label: str, grid: list[float] | None = None) -> DataFrame:
    """(idx, t, tp, fp, fn, tn, acc, f1, combined) for every threshold, prediction = p >= t.

    Rows are counted once per (threshold interval, label); the counts at or
    above each threshold are suffix sums over len(grid) + 1 rows.
    """
    grid = sorted(default_grid() if grid is None else grid)
    cut = Bucketizer(splits=[float("-inf"), *grid, float("inf")], inputCol="_p", outputCol="_bucket")
    counts = (
        cut.transform(df.select(_score(p).alias("_p"), _positive(label).alias("_pos")))
        # never null, so the join below adds no null filter that would cut the scores twice
        .groupBy(F.coalesce(F.col("_bucket").cast("int"), F.lit(0)).alias("_bucket"))
        .agg(F.count_if("_pos").alias("_p1"), F.count_if(~F.col("_pos")).alias("_p0"))
    )
    steps = local_frame(
        df.sparkSession, [(0, None)] + [(i + 1, t) for i, t in enumerate(grid)], "bucket int, t double"
    )
    table = steps.join(counts, F.col("bucket") == F.col("_bucket"), "left").na.fill(0, ["_p1", "_p0"])
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = table.select(
        (F.col("bucket") - 1).alias("idx"),
        "t",
        F.sum("_p1").over(above).alias("tp"),
        F.sum("_p0").over(above).alias("fp"),
        (F.sum("_p1").over(whole) - F.sum("_p1").over(above)).alias("fn"),
        (F.sum("_p0").over(whole) - F.sum("_p0").over(above)).alias("tn"),
    ).where(F.col("idx") >= 0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return full.withColumns({"acc": accuracy(tp, fp, fn, tn), "f1": f1(tp, fp, fn)}).withColumn(
        "combined", combined(F.col("acc"), F.col("f1"))
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep row with the largest combined value, the first of equals."""
    return sweep.orderBy(F.desc("combined"), "idx").limit(1)


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row (tn, fp, fn, tp)."""
    y = _positive(label)
    z = F.coalesce(quoted(pred).cast("double") == 1.0, F.lit(False))
    return df.agg(
        F.count_if(~y & ~z).alias("tn"),
        F.count_if(~y & z).alias("fp"),
        F.count_if(y & ~z).alias("fn"),
        F.count_if(y & z).alias("tp"),
    )


def _score_table(df: DataFrame, label: str, p: str) -> DataFrame:
    """Distinct scores with their positives and negatives, and the negatives below."""
    scored = df.select(_score(p).alias("score"), _positive(label).alias("_pos"))
    rows = scored.agg(F.approx_count_distinct("score")).first()[0]
    by_score = scored.groupBy("score").agg(F.count_if("_pos").alias("pos"), F.count_if(~F.col("_pos")).alias("neg"))
    return running_totals(by_score, "score", ["neg"], rows)


def _auc() -> Column:
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    # as doubles, because pos * neg can exceed a long
    return F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def roc_auc(df: DataFrame, label: str, p: str) -> DataFrame:
    """One row (positives, negatives, roc_auc); ties count half; null if a class is absent."""
    table = _score_table(df, label, p)
    return table.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), _auc().alias("roc_auc"))


def classification_report(df: DataFrame, label: str, p: str, t: float) -> DataFrame:
    """One row of counts and ratios at threshold `t`; undefined ratios are 0.

    The confusion counts and the AUC come from the same table of distinct scores.
    """
    hit = F.col("score") >= F.lit(float(t))
    zero = F.lit(0)
    counts = _score_table(df, label, p).agg(
        F.sum(F.when(hit, zero).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.when(hit, F.col("neg")).otherwise(zero)).alias("fp"),
        F.sum(F.when(hit, zero).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, F.col("pos")).otherwise(zero)).alias("tp"),
        _auc().alias("roc_auc"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        F.lit(float(t)).alias("threshold"),
        "tn",
        "fp",
        "fn",
        "tp",
        accuracy(tp, fp, fn, tn).alias("accuracy"),
        f1(tp, fp, fn).alias("f1"),
        "roc_auc",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
    )


def select_best(results: DataFrame, model: str = "model", acc: str = "accuracy", f: str = "f1") -> DataFrame:
    """The row with the highest combined score, which must exceed 0; equals go by name."""
    scored = results.withColumn("best_score", combined(quoted(acc), quoted(f)))
    return scored.where(F.col("best_score") > 0).orderBy(F.desc("best_score"), model).limit(1)


def weighted_ensemble(df: DataFrame, accuracies: dict[str, float], out: str = "ensemble") -> DataFrame:
    """Mean of probability columns weighted by accuracy squared."""
    total = sum(a**2 for a in accuracies.values())
    blend = F.lit(0.0)
    for c, a in accuracies.items():
        blend = blend + quoted(c) * F.lit(a**2)
    return df.withColumn(out, blend / F.lit(total))
