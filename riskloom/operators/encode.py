"""Categories as numbers: statistics of the label that a row's own label never enters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import digest
from ..functions.numbers import quoted
from ..plans.ranking import prefix_digits
from ..plans.small import pin_small

#: Sums of earlier buckets that are broadcast at most.
PINNED_SUMS = 1_000_000


def _statistic(positives: Column, n: Column, prior: float, weight: float) -> Column:
    return (F.coalesce(positives, F.lit(0.0)) + prior * weight) / (F.coalesce(n, F.lit(0)) + weight)


def ordered_statistics(df: DataFrame, columns: list[str], label: str, key: str, prior: float = 0.5, weight: float = 1.0, seed: int = 42,
                       suffix: str = "_stat") -> DataFrame:
    """Add `<column><suffix>`: the mean label of the earlier rows of the same category, drawn towards `prior` by `weight` rows.

    Rows are ordered by the md5 of `key`, then by `key`, which must be distinct
    to tell rows apart. Null is a category. A row without a label adds nothing
    to later ones but has statistics. A category may hold any share of the
    rows: prefix sums run over hash buckets, and rows are ordered only inside
    a bucket of a category. All columns share one shuffle of the rows; a column
    with more than PINNED_SUMS sums (categories times buckets) takes one more.
    """
    taken = [c + suffix for c in columns if c + suffix in df.columns]
    if taken:
        raise ValueError(f"columns exist already: {taken}")
    digits = prefix_digits(df.count())
    out = df.withColumns({"_y": quoted(label).cast("double"), "_h": digest(seed, quoted(key))})
    out = out.withColumns({"_b": F.substring("_h", 1, digits), "_h": F.unhex("_h")})  # 16 bytes in the shuffle, in the same order
    upto = Window.partitionBy("_tc").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    before = []
    for c in columns:  # categories times buckets; each reads its own column, label and key only
        buckets = out.groupBy(quoted(c).alias("_tc"), F.col("_b").alias("_tb")).agg(F.sum("_y").alias("s"), F.count("_y").alias("n"))
        before.append(pin_small(buckets.select("_tc", "_tb", F.sum("s").over(upto).alias("_s"), F.sum("n").over(upto).alias("_n")), PINNED_SUMS))
    # a bucket's rows of all categories lie together, so the windows of all columns need no other shuffle
    out = out.repartition("_b")
    for c, sums in zip(columns, before):
        own = out.withColumn("_c", quoted(c))
        earlier = Window.partitionBy("_c", "_b").orderBy("_h", quoted(key)).rowsBetween(Window.unboundedPreceding, -1)
        positives = F.coalesce(F.col("_s"), F.lit(0.0)) + F.coalesce(F.sum("_y").over(earlier), F.lit(0.0))
        n = F.coalesce(F.col("_n"), F.lit(0)) + F.count("_y").over(earlier)
        out = own.join(sums, F.col("_c").eqNullSafe(F.col("_tc")) & (F.col("_b") == F.col("_tb"))).withColumn(
            c + suffix, _statistic(positives, n, prior, weight)).drop("_c", "_tc", "_tb", "_s", "_n")
    return out.drop("_y", "_h", "_b")


def category_statistics(df: DataFrame, column: str, label: str) -> DataFrame:
    """(value, positives, n): what new rows are encoded by, from all rows that have a label."""
    return df.where(quoted(label).isNotNull()).groupBy(quoted(column).alias("value")).agg(
        F.sum(quoted(label).cast("double")).alias("positives"), F.count(quoted(label)).alias("n"))


def encode_by(df: DataFrame, statistics: DataFrame, column: str, prior: float = 0.5, weight: float = 1.0, suffix: str = "_stat") -> DataFrame:
    """Add `<column><suffix>` to new rows; a value never seen gets `prior`."""
    known = statistics.select(F.col("value").alias("_value"), F.col("positives").alias("_p"), F.col("n").alias("_n"))
    return df.join(known, quoted(column).eqNullSafe(F.col("_value")), "left").withColumn(
        column + suffix, _statistic(F.col("_p"), F.col("_n"), prior, weight)).drop("_value", "_p", "_n")


__all__ = ["category_statistics", "encode_by", "ordered_statistics"]
