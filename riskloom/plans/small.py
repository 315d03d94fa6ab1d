"""Size-checked small tables, and joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
import pyarrow as pa

SMALL_ROWS = 100_000


def local_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A driver-side table as a LocalRelation, so the planner knows its real size."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    cols = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(cols, schema=arrow), schema)


def pin_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast `df` if it is proven to have at most `max_rows` rows.

    The check fetches max_rows + 1 rows. A larger table comes back as it is,
    without a hint, and its joins are shuffled.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality on several column pairs."""
    cond = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    total: int,
    how: str = "inner",
    hot_share: float = 0.001,
    sample_rows: int = 200_000,
    min_rows: int = 1_000_000,
) -> DataFrame:
    """Equi-join where `small` has one row per key and some keys are hot in `big`.

    A sample of `big` finds the keys that hold about `hot_share` of its `total`
    rows or more; there are at most 2 / hot_share of them, so their list is
    broadcast. Their big-side rows get a salt, and their small-side row one
    copy per salt value. The sample only steers the salting: every row is
    joined whether or not its key was found to be hot. Below `min_rows` the
    plain join is used.
    """
    if total < min_rows:
        return big.join(small, on, how)
    rate = min(1.0, sample_rows / total)
    cut = max(1.0, hot_share * total)
    names = [f"_hot{i}" for i in range(len(on))]
    hot = pin_small(
        big.select(*[F.col(c).alias(n) for c, n in zip(on, names)])
        .sample(rate, seed=7)
        .groupBy(*names)
        .count()
        .where(F.col("count") / F.lit(rate) > cut / 2)
        .select(*names, F.ceil(F.col("count") / F.lit(rate) / F.lit(cut)).cast("int").alias("_salts")),
        int(4 / hot_share),
    )

    def tag(df: DataFrame) -> DataFrame:
        return df.join(hot, [F.col(c) == F.col(n) for c, n in zip(on, names)], "left").drop(*names)

    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.coalesce("_salts", F.lit(1))).cast("int")
    left = tag(big).withColumn("_salt", spread).drop("_salts")
    copies = tag(small).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return left.join(copies, [*on, "_salt"], how).drop("_salt")
