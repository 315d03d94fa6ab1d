"""Exact ranks in hash order, and running totals, without one giant task.

Rows are cut into many buckets by a hash prefix (or by score quantiles), the
buckets are counted, and only then are rows ordered inside one bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.draws import digest
from .small import local_frame, pin_small

BUCKET_ROWS = 250_000
MAX_BUCKETS = 16_384
MAX_CLASSES = 10_000


def prefix_digits(rows: int) -> int:
    """Hex digits so that a bucket of the largest class holds about BUCKET_ROWS rows."""
    digits = 1
    while digits < 6 and rows / 16**digits > BUCKET_ROWS:
        digits += 1
    return digits


def class_counts(df: DataFrame, label: str) -> list[tuple]:
    """(label value, rows), ordered by label; the label must have few values."""
    got = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(got) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values, so it is not a class label")
    return sorted(((r[0], r[1]) for r in got), key=lambda x: (x[0] is None, x[0]))


def hash_cutoffs(df: DataFrame, label: str, key: str, wanted: list[tuple], seed: int, largest: int) -> DataFrame:
    """The (hash, key) found at given ranks of each class in hash order.

    `wanted` holds (label value, slot, rank) with rank >= 1. Only the bucket in
    which a wanted rank falls is ever sorted, so the input itself is not
    shuffled. Returns (label, slot, h, key) with one row per wanted rank.
    """
    digits = prefix_digits(largest)
    keyed = df.select(F.col(label).alias("_g"), F.col(key).alias("_k"), digest(seed, F.col(key)).alias("_h"))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, digits))
    label_type = df.schema[label].dataType.simpleString()
    targets = local_frame(df.sparkSession, wanted, f"_tg {label_type}, slot int, _rank bigint")
    w = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = keyed.groupBy("_g", "_b").count().withColumn("_upto", F.sum("count").over(w))
    edges = pin_small(
        totals.join(F.broadcast(targets), F.col("_g").eqNullSafe(F.col("_tg")))
        .where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("count")))
        .select("_tg", F.col("_b").alias("_tb"), "slot", (F.col("_rank") - F.col("_upto") + F.col("count")).alias("_need")),
        len(wanted),
    )
    spots = edges.groupBy("_tg", "_tb").agg(F.collect_list(F.struct("_need", "slot")).alias("_needs"))
    inside = keyed.join(
        F.broadcast(spots), F.col("_g").eqNullSafe(F.col("_tg")) & (F.col("_b") == F.col("_tb"))
    ).withColumn("_rn", F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", "_k")))
    hits = inside.withColumn("_hit", F.explode(F.filter("_needs", lambda x: x["_need"] == F.col("_rn"))))
    return pin_small(hits.select(F.col("_g").alias(label), F.col("_hit.slot").alias("slot"), "_h", "_k"), len(wanted))


def slot_by_cutoff(df: DataFrame, label: str, key: str, cutoffs: DataFrame, slots: int, seed: int, out: str) -> DataFrame:
    """Add `out`: how many of the cutoffs 0..slots-1 of its class lie strictly before the row. No shuffle."""
    cut = F.struct("_h", "_k")
    wide = cutoffs.groupBy(F.col(label).alias("_cg")).agg(
        *[F.max(F.when(F.col("slot") == i, cut)).alias(f"_cut{i}") for i in range(slots)]
    )
    me = F.struct(digest(seed, F.col(key)).alias("_h"), F.col(key).alias("_k"))
    joined = df.withColumn("_me", me).join(F.broadcast(wide), F.col(label).eqNullSafe(F.col("_cg")), "left")
    n = F.lit(0)
    for i in range(slots):
        n = n + F.coalesce((F.col(f"_cut{i}") < F.col("_me")).cast("int"), F.lit(0))
    return joined.select(*df.columns, n.alias(out))


def dense_index(df: DataFrame, within: str, key: str, seed: int, largest: int, out: str = "idx") -> DataFrame:
    """Add `out`: the 0-based rank of each row inside its class in hash order.

    Equals row_number() over (partition by within order by md5, key) - 1, but
    the window is partitioned by (class, hash prefix).
    """
    digits = prefix_digits(largest)
    tagged = df.withColumn("_h", digest(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, digits))
    w = Window.partitionBy("_og").orderBy("_ob").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = pin_small(
        tagged.groupBy(F.col(within).alias("_og"), F.col("_b").alias("_ob"))
        .count()
        .withColumn("_before", F.sum("count").over(w) - F.col("count"))
        .drop("count"),
        1_000_000,
    )
    in_bucket = Window.partitionBy(within, "_b").orderBy("_h", key)
    return (
        tagged.withColumn("_rn", F.row_number().over(in_bucket))
        .join(offsets, F.col(within).eqNullSafe(F.col("_og")) & (F.col("_b") == F.col("_ob")))
        .select(*df.columns, (F.col("_before") + F.col("_rn") - 1).cast("long").alias(out))
    )


def running_totals(df: DataFrame, order: str, sums: list[str], rows: int) -> DataFrame:
    """Add `<s>_before` for each of `sums`: its total over all rows with a smaller `order`.

    `order` must be a distinct, non-null double. Buckets follow the quantiles
    of `order`, so they stay even however the values cluster.
    """
    buckets = min(MAX_BUCKETS, max(1, rows // BUCKET_ROWS))
    if buckets == 1:
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[(F.sum(s).over(w) - F.col(s)).alias(f"{s}_before") for s in sums])
    cuts = df.agg(
        F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10 * buckets)
    ).first()[0]
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(edges) < 3:
        edges = [float("-inf"), 0.0, float("inf")]
    cut = Bucketizer(splits=edges, inputCol=order, outputCol="_b").transform(df)
    by_bucket = cut.groupBy(F.col("_b").alias("_ob")).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    # at most MAX_BUCKETS rows: one ordered task is enough
    upto = Window.orderBy("_ob").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = F.broadcast(
        by_bucket.select("_ob", *[(F.sum(f"_t_{s}").over(upto) - F.col(f"_t_{s}")).alias(f"_o_{s}") for s in sums])
    )
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.join(offsets, F.col("_b") == F.col("_ob"))
    return out.select(
        *df.columns,
        *[(F.col(f"_o_{s}") + F.sum(s).over(w) - F.col(s)).alias(f"{s}_before") for s in sums],
    )
