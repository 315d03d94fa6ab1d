"""Nearest neighbours by several tables of p-stable projections with bounded buckets.

In a table each vector has a row of numbers floor((a.x + b) / w) with normal a
and w a share of the data's own spread. A bucket is made of the vectors that
agree on the first few of them: of as few as keep it within `block_rows`, so
buckets follow the density of the data and a class that fits one block is
searched exactly. Vectors that agree on all numbers of a table and are still too
many are dealt out by hash. Each bucket is searched by one task, and a vector's
candidates of all tables are put together. A visit to a table costs a vector at
most `block_rows` distances, so the work grows with the rows and not with their
square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.durable import materialise
from ..plans.shipping import ship
from ..plans.small import pin_small
from .neighbors import _nearest, _stack, collapse_copies, neighbour_lists, vectors_of


def hashed_lists(
    df: DataFrame,
    key: str,
    features: list[str] | str,
    k: int,
    within: str | None = None,
    with_vectors: bool = False,
    tables: int = 16,
    functions: int = 12,
    width: float = 0.5,
    block_rows: int = 2048,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame, int]:
    """(rows, lists, n) like `neighbour_lists`, by hashed buckets.

    Distances are exact, but a neighbour that shares no bucket with a vector is
    missed. Vectors that meet fewer than k others while their class has more are
    searched exactly. An empty table, null classes and null features are refused.
    """
    ship(df.sparkSession)
    base = vectors_of(df, key, features, within)
    total, nulls = base.agg(F.count("*"), F.count_if(F.col("g").isNull())).first()
    if not total:
        raise ValueError("no rows to search")
    if nulls:
        raise ValueError(f"{within} has null classes")
    want = k + 1
    distinct = materialise(collapse_copies(base, want).withColumn("vid", F.monotonically_increasing_id()), "vectors")
    d = len(distinct.select("vec").first()[0])
    # a.x of a normal a varies as the sum of the components' variances says
    single = F.bool_and(F.forall("vec", lambda v: v.cast("float").cast("double") == v))
    *variances, floats = distinct.agg(*[F.var_pop(F.col("vec")[i]) for i in range(d)], single).first()
    spread = float(np.sqrt(sum(v or 0.0 for v in variances))) or 1.0
    draw = np.random.default_rng(seed)
    normals, shift = draw.normal(size=(tables * functions, d)) / (width * spread), draw.uniform(size=tables * functions)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                codes = np.floor(_stack(pdf["vec"]) @ normals.T + shift).astype(np.int32)
                yield pd.DataFrame({"vid": pdf["vid"], "g": pdf["g"], "codes": list(codes)})

    g_type = base.schema["g"].dataType
    ids = [T.StructField("vid", T.LongType()), T.StructField("g", g_type)]
    # small numbers, written once; their prefixes are many times as large and are made twice instead
    codes = materialise(distinct.select("vid", "g", "vec").mapInPandas(project, T.StructType([*ids, T.StructField("codes", T.ArrayType(T.IntegerType()))])), "codes")
    # one row for each table and number of functions; none at all is the whole class, the same bucket in all tables
    starts = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(n).alias("n_codes")) for t in range(tables) for n in range(functions + 1)])
    prefixes = codes.select("vid", "g", "codes", F.explode(starts).alias("s")).select(
        "vid", "g", "s.*",
        F.xxhash64("g", F.when(F.col("s.n_codes") > 0, F.col("s.table")), "s.n_codes", F.slice("codes", F.col("s.table") * functions + 1, F.col("s.n_codes"))).alias("bucket"),
    )
    once = F.when(F.col("n_codes") > 0, F.lit(1)).otherwise((F.col("table") == 0).cast("int"))
    large = pin_small(prefixes.groupBy("g", "bucket").agg(F.sum(once).alias("n")).where(F.col("n") > block_rows), 1_000_000)
    own = prefixes.join(large, ["g", "bucket"], "left").groupBy("vid", "table").agg(
        F.min(F.when(F.col("n").isNull(), F.struct("n_codes", "bucket"))).alias("fits"), F.max(F.struct("n_codes", "bucket", "n")).alias("last"))
    placed = own.where("table = 0 OR fits IS NULL OR fits.n_codes > 0").select(
        "vid", F.coalesce("fits.bucket", "last.bucket").alias("bucket"),
        F.when(F.col("fits").isNull(), F.pmod(F.xxhash64("vid", "table"), F.ceil(F.col("last.n") / F.lit(block_rows)))).otherwise(F.lit(0)).alias("slot"))

    key_type = base.schema["key"].dataType
    answer = T.StructType([
        ids[0], T.StructField("dists", T.ArrayType(T.DoubleType())),
        T.StructField("names", T.ArrayType(key_type)), T.StructField("vecs", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def one_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        dists, names, vecs, _ = _nearest(_stack(pdf["vec"]), pdf, want, with_vectors)
        return pd.DataFrame({"vid": pdf["vid"], "dists": dists, "names": names, "vecs": vecs})

    # a copy for each table: in single precision where that loses nothing; candidates travel without the vector they are for
    copies = distinct.withColumn("vec", F.col("vec").cast("array<float>")) if floats else distinct
    met = copies.join(placed, "vid").groupBy("g", "bucket", "slot").applyInPandas(one_bucket, answer)
    entry = lambda e: F.struct(
        e["dists"].alias("dist"), e["names"].alias("key"), (e["vecs"] if with_vectors else F.lit(None).cast("array<double>")).alias("vec"))
    zipped = F.arrays_zip("dists", "names", "vecs") if with_vectors else F.arrays_zip("dists", "names")
    candidates = met.select("vid", F.explode(F.transform(zipped, entry)).alias("e")).repartition("vid")
    unique = candidates.groupBy("vid", F.col("e.key").alias("k")).agg(F.min("e").alias("e"))
    near = unique.groupBy("vid").agg(F.slice(F.sort_array(F.collect_list("e")), 1, want).alias("near"))
    lists = materialise(distinct.select("vid", "g", "vec").join(near, "vid").drop("vid"), "hashed-lists")

    sizes = pin_small(base.groupBy("g").agg(F.least(F.count("*"), F.lit(want)).alias("most")), 1_000_000)
    short = materialise(lists.join(sizes, "g").where(F.size("near") < F.col("most")).select("g", "vec"), "short-lists")
    if not short.isEmpty():
        _, exact, _ = neighbour_lists(df, key, features, k, within, None, with_vectors, block_rows, seed=seed)
        lists = lists.join(short, ["g", "vec"], "left_anti").unionByName(exact.join(short, ["g", "vec"], "left_semi").select("g", "vec", "near"))
    return base, lists, total


__all__ = ["hashed_lists"]
