"""The descriptive report, on raw rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import as_double, double_of, is_numeric, nan_free, quoted
from ..plans.quantiles import quantiles
from ..plans.small import local_frame


@dataclass(frozen=True)
class ReportConfig:
    label: str
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    top: int = 10


def label_summary(df: DataFrame, label: str) -> DataFrame:
    """One row (total, positives, rate in percent)."""
    return df.agg(
        F.count("*").alias("total"), F.coalesce(F.sum(as_double(quoted(label))), F.lit(0.0)).alias("positives")
    ).withColumn("rate", F.try_divide("positives", F.col("total").cast("double")) * 100)


SUMMARY_SCHEMA = "feature string, mean double, median double, std double, min double, max double"


def numeric_summary(df: DataFrame, cols: list[str], method: str = "exact") -> DataFrame:
    """(feature, mean, median, std, min, max) of the listed columns that exist; nulls skipped.

    The moments ride along with the first pass of the median search.
    """
    cols = [c for c in cols if c in df.columns]
    extra = {}
    for i, c in enumerate(cols):
        x = double_of(df, c)
        extra |= {f"_mean{i}": F.avg(x), f"_std{i}": F.stddev_samp(x)}
    med, head = quantiles(df, cols, [0.5], method, extra=extra)
    rows = [
        (c, head[f"_mean{i}"], med[c][0], head[f"_std{i}"], head[f"_c{i}_min"], head[f"_c{i}_max"])
        for i, c in enumerate(cols)
    ]
    return local_frame(df.sparkSession, rows, SUMMARY_SCHEMA)


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, n) of the listed columns that exist; nulls dropped, value as text.

    All columns share one shuffle, and frequent values are combined before it.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return local_frame(df.sparkSession, [], "feature string, value string, n bigint")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), quoted(c).cast("string").alias("value")) for c in cols]
    )
    long = nan_free(df).select(F.inline(pairs)).where(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.count("*").alias("n"))


def value_shares(counts: DataFrame) -> DataFrame:
    """Add the share of each value within its feature, in percent with one decimal.

    The totals have one row per counted column, so they are broadcast and no
    feature has to fit one task.
    """
    totals = counts.groupBy(F.col("feature").alias("_feature")).agg(F.sum("n").alias("_total"))
    joined = counts.join(F.broadcast(totals), F.col("feature") == F.col("_feature"))
    return joined.select(*counts.columns, F.round(F.col("n") / F.col("_total") * 100, 1).alias("share"))


def label_correlations(df: DataFrame, label: str, top: int = 10) -> DataFrame:
    """(feature, correlation, percent): absolute Pearson correlation with the label, largest first.

    Each pair uses the rows where both values are present. The label itself
    takes one of the `top` places and is then left out, so at most top - 1 rows
    come back. A constant column has no correlation and sorts last. Text
    columns are an error.
    """
    text = [f.name for f in df.schema.fields if not is_numeric(f.dataType)]
    if text:
        raise TypeError(f"correlations need numeric columns, got {text}")
    y = double_of(df, label)
    others = [c for c in df.columns if c != label]
    aggs = [F.stddev_pop(y).alias("_label")]
    for i, c in enumerate(others):
        x = double_of(df, c)
        paired = F.when(y.isNotNull(), x)
        # r squared skips incomplete pairs and is null for a constant label;
        # for a constant column it would be 1, hence the extremes
        aggs += [F.regr_r2(x, y).alias(f"_r{i}"), F.min(paired).alias(f"_a{i}"), F.max(paired).alias(f"_b{i}")]
    one = df.agg(*aggs)

    def corr(i: int):
        return F.when(F.col(f"_a{i}") < F.col(f"_b{i}"), F.sqrt(F.col(f"_r{i}")))

    entries = [F.struct(F.lit(c).alias("feature"), corr(i).alias("correlation")) for i, c in enumerate(others)]
    own = F.when(F.col("_label") > 0, F.lit(1.0))
    entries.append(F.struct(F.lit(label).alias("feature"), own.alias("correlation")))
    ranked = one.select(F.inline(F.array(*entries))).orderBy(
        F.desc_nulls_last("correlation"), F.col("feature") != label, "feature"
    )
    return ranked.limit(top).where(F.col("feature") != label).select(
        "feature", "correlation", F.round(F.col("correlation") * 100, 1).alias("percent")
    )


def analyze(df: DataFrame, config: ReportConfig, method: str = "exact", keep: bool = False) -> dict[str, DataFrame]:
    """All parts of the report. keep=True persists the needed columns across the parts."""
    wanted = {config.label, *config.numeric, *config.categorical}
    if keep:
        df = df.select(*[quoted(c) for c in df.columns if c in wanted or is_numeric(df.schema[c].dataType)])
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    counts = value_counts(df, config.categorical)
    return {
        "label": label_summary(df, config.label),
        "numeric": numeric_summary(df, config.numeric, method),
        "values": value_shares(counts),
        "correlations": label_correlations(df, config.label, config.top),
    }


def as_long_report(parts: dict[str, DataFrame]) -> DataFrame:
    """The report as one table (section, feature, item, value)."""
    lab = parts["label"].select(
        F.lit("label").alias("section"), F.lit("").alias("feature"),
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in ("total", "positives", "rate")
        ])),
    )
    num = parts["numeric"].select(
        F.lit("numeric").alias("section"), "feature",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in ("mean", "median", "std", "min", "max")
        ])),
    )
    val = parts["values"].select(
        F.lit("values").alias("section"), "feature", F.col("value").alias("item"), F.col("n").cast("double").alias("value")
    )
    cor = parts["correlations"].select(
        F.lit("correlations").alias("section"), "feature", F.lit("correlation").alias("item"), F.col("correlation").alias("value")
    )
    return lab.unionByName(num).unionByName(val).unionByName(cor)
