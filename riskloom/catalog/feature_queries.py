"""Features, splitting, balancing, ranking and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, features, importance, neighbors, report, scale, split
from ..operators.features import Derived
from . import frames as fr
from .frames import LINE, r, sql_digest, sql_hex, sql_unit

SPECS = [
    Derived("size_price", "product", ("p_size", "p_retailprice")),
    Derived("size_weight", "product", ("p_size", "p_weight")),
    Derived("key_plus_size", "sum", ("p_partkey", "p_size")),
    Derived("key_plus_weight", "sum", ("p_partkey", "p_weight")),
    Derived("size_squared", "square", ("p_size",), "omit"),
    Derived("weight_squared", "square", ("p_weight",), "omit"),
]


def _split_label(spark, sf):
    x, _ = features.split_label(fr.returned(fr.lineitem(spark, sf)), "returned")
    return x


def _label_only(spark, sf):
    _, y = features.split_label(fr.returned(fr.lineitem(spark, sf)), "returned")
    return y.groupBy("returned").agg(F.count("*").alias("n"))


def _derive(spark, sf):
    return fr.rounded(features.derive(fr.table(spark, sf, "part").drop("p_name"), SPECS))


DERIVE_SQL = f"""
SELECT p_partkey, p_brand, p_type, p_size, {r('p_retailprice', 'p_retailprice')}, {r('p_size * p_retailprice', 'size_price')},
       0.0::DOUBLE AS size_weight, CAST(p_partkey + p_size AS DOUBLE) AS key_plus_size, 0.0::DOUBLE AS key_plus_weight,
       CAST(p_size * p_size AS DOUBLE) AS size_squared
FROM part
"""


def _derive_overwrite(spark, sf):
    df = fr.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").withColumns(
        {"size_squared": F.lit(-1.0), "size_weight": F.lit(-2.0)}
    )
    return fr.rounded(features.derive(df, SPECS, overwrite=True, on_missing="omit"))


OVERWRITE_SQL = f"""
SELECT p_partkey, p_size, {r('p_retailprice', 'p_retailprice')}, CAST(p_size * p_size AS DOUBLE) AS size_squared,
       -2.0::DOUBLE AS size_weight, {r('p_size * p_retailprice', 'size_price')},
       CAST(p_partkey + p_size AS DOUBLE) AS key_plus_size
FROM part
"""


def _align(spark, sf):
    df = fr.table(spark, sf, "part").withColumn("size_price", F.lit(7.0))
    wanted = ["size_squared", "p_retailprice", "size_price", "key_plus_weight", "unheard_of", "p_size"]
    return fr.rounded(features.align_features(df, wanted, SPECS, keep=["p_partkey"]))


ALIGN_SQL = f"""
SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS size_squared, {r('p_retailprice', 'p_retailprice')},
       7.0::DOUBLE AS size_price, 0.0::DOUBLE AS key_plus_weight, 0.0::DOUBLE AS unheard_of, CAST(p_size AS DOUBLE) AS p_size
FROM part
"""


def _finite(spark, sf):
    d = fr.dirty(spark, sf).select("event_id", F.col("k").try_cast("double").alias("k"), "value")
    d = d.withColumn("value", F.when(F.col("value") < 20, F.lit(float("-inf"))).otherwise(F.col("value")))
    return fr.rounded(features.finite_or_zero(d, ["k", "value"]))


FINITE_SQL = f"""
WITH d AS ({fr.DIRTY_SQL})
SELECT event_id,
       {r("CASE WHEN trim(k) IN ('', 'abc', 'inf', 'nan') THEN 0.0 WHEN k = '1d' THEN 1.0 ELSE CAST(trim(k) AS DOUBLE) END", 'k')},
       {r('CASE WHEN value < 20 THEN 0.0 ELSE value END', 'value')}
FROM d
"""


def _orders(spark, sf):
    return fr.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")


def _split(spark, sf):
    return split.stratified_split(_orders(spark, sf), "o_orderstatus", "o_orderkey", 0.4, fr.SEED)


_RANKED = f"""SELECT o_orderkey, o_orderstatus,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_digest('o_orderkey')}, o_orderkey) AS rn FROM orders"""
_CLASSES = "SELECT o_orderstatus AS g, count(*) AS c FROM orders GROUP BY 1"
SPLIT_SQL = f"""
WITH ranked AS ({_RANKED}), c AS ({_CLASSES}),
t AS (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(ceil(0.4::DOUBLE * CAST(sum(c) AS DOUBLE)) AS BIGINT) AS m FROM c),
q AS (SELECT g, c * m // n AS base, c * m % n AS rest, m FROM c, t),
l AS (SELECT g, base, row_number() OVER (ORDER BY rest DESC, g) AS place, m - sum(base) OVER () AS extra FROM q)
SELECT o_orderkey, o_orderstatus, rn <= base + CASE WHEN place <= extra THEN 1 ELSE 0 END AS is_test
FROM ranked JOIN l ON o_orderstatus = g
"""


def _split_hash(spark, sf):
    return split.stratified_split(_orders(spark, sf), "o_orderstatus", "o_orderkey", 0.4, fr.SEED, exact=False)


SPLIT_HASH_SQL = f"SELECT o_orderkey, o_orderstatus, {sql_unit(sql_digest('o_orderkey'))} < 0.4::DOUBLE AS is_test FROM orders"


def _folds(spark, sf):
    return split.assign_folds(_orders(spark, sf), "o_orderstatus", "o_orderkey", 5, fr.SEED)


FOLDS_SQL = f"""
WITH ranked AS ({_RANKED}), c AS ({_CLASSES}),
s AS (SELECT g, c, CAST((sum(c) OVER (ORDER BY g) - c) % 5 AS BIGINT) AS start FROM c),
z AS (SELECT g, f, (c - ((f - start) % 5 + 5) % 5 + 4) // 5 AS size FROM s, (SELECT unnest([0, 1, 2, 3, 4]) AS f)),
u AS (SELECT g, f, sum(size) OVER (PARTITION BY g ORDER BY f) AS upto, sum(size) OVER (PARTITION BY g ORDER BY f) - size AS lo FROM z)
SELECT o_orderkey, o_orderstatus, CAST(f AS INTEGER) AS fold
FROM ranked JOIN u ON o_orderstatus = g AND rn > lo AND rn <= upto
"""


def _deficit(spark, sf):
    return balance.class_deficit(fr.table(spark, sf, "orders"), "o_orderstatus")


DEFICIT_SQL = """
WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderstatus, n, max(n) OVER () - n AS deficit FROM c
"""


def _knn(spark, sf):
    e = fr.table(spark, sf, "embeddings")
    return fr.rounded(neighbors.knn(e, "vec_id", "embedding", 3, "label"))


def _knn_cells(spark, sf):
    """Small blocks, so that the search has to visit other cells."""
    e = fr.table(spark, sf, "embeddings")
    return fr.rounded(neighbors.knn(e, "vec_id", "embedding", 3, block_rows=64))


RECALL = 0.9


def _knn_probe(spark, sf):
    """How many of all exact neighbours a search of a few cells finds."""
    e = fr.table(spark, sf, "embeddings")
    exact = neighbors.knn(e, "vec_id", "embedding", 3, "label").select("vec_id", "neighbour")
    probed = neighbors.knn(e, "vec_id", "embedding", 3, "label", method="probe", probes=4, block_rows=64)
    found = exact.join(probed.select("vec_id", "neighbour", F.lit(1).alias("hit")), ["vec_id", "neighbour"], "left")
    return found.agg(F.count("*").alias("wanted"), (F.count("hit") >= RECALL * F.count("*")).alias("recall_reached"))


def _knn_hashed(spark, sf):
    """How many of all exact neighbours hashed buckets find; the buckets are small, so that even a small table does not fit one."""
    e = fr.table(spark, sf, "embeddings")
    exact = neighbors.knn(e, "vec_id", "embedding", 3).select("vec_id", "neighbour")
    hashed = neighbors.knn(e, "vec_id", "embedding", 3, method="lsh", tables=48, block_rows=128)
    found = exact.join(hashed.select("vec_id", "neighbour", F.lit(1).alias("hit")), ["vec_id", "neighbour"], "left")
    return found.agg(F.count("*").alias("wanted"), (F.count("hit") >= RECALL * F.count("*")).alias("recall_reached"))


HASHED_SQL = "SELECT CAST(sum(least(3, n - 1) * n) AS BIGINT) AS wanted, true AS recall_reached FROM (SELECT count(*) AS n FROM embeddings)"


PROBE_SQL = """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT CAST(sum(n * least(3, n - 1)) AS BIGINT) AS wanted, true AS recall_reached FROM c
"""


def _knn_sql(vec: str, within: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, label, {vec} AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id {within}),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, {r('dist', 'dist')} FROM k WHERE rank <= 3
"""


def _smote(spark, sf):
    return fr.rounded(balance.smote(fr.vec_minority(spark, sf), "y", "vec_id", fr.EMBEDDED, 3, fr.SEED))


_H = sql_digest("'synthetic'", "1", "s")
SMOTE_SQL = f"""
WITH v AS ({fr.VEC_SQL}), m AS (SELECT *, [{', '.join(fr.EMBEDDED)}] AS x FROM v WHERE y = 1),
i AS (SELECT *, row_number() OVER (ORDER BY {sql_digest('vec_id')}, vec_id) - 1 AS idx, count(*) OVER () AS n FROM m),
d AS (SELECT a.vec_id, b.x AS bx, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) - 1 AS pick
      FROM m a JOIN m b ON a.vec_id <> b.vec_id),
s AS (SELECT unnest(range((SELECT count(*) FILTER (y = 0) - count(*) FILTER (y = 1) FROM v))) AS s),
h AS (SELECT s, {_H} AS h FROM s),
w AS (SELECT s, {sql_hex('h', 1, 12)} % (SELECT max(n) FROM i) AS idx, {sql_hex('h', 13, 6)} % 3 AS pick, {sql_unit('h', 19)} AS u FROM h)
SELECT CAST(vec_id AS VARCHAR) AS vec_id, y, {', '.join(r(f, f) for f in fr.EMBEDDED)}, false AS synthetic FROM v
UNION ALL
SELECT '1#' || CAST(s AS VARCHAR), 1, {', '.join(r(f'x[{k + 1}] + u * (bx[{k + 1}] - x[{k + 1}])') for k in range(len(fr.EMBEDDED)))}, true
FROM w JOIN i USING (idx) JOIN d ON d.vec_id = i.vec_id AND d.pick = w.pick
"""


def ranking_facts(ranked):
    """What is known beforehand of a ranking on planted rows: its names, its sum, and the price in front."""
    return ranked.agg(
        F.concat_ws(",", F.array_sort(F.collect_list("feature"))).alias("features"),  # one row per feature
        F.round(F.sum("importance"), 6).alias("total"), F.min_by("feature", "rank").alias("first"),
    )


def ranking_sql(names: list[str]) -> str:
    return f"""SELECT '{','.join(sorted(names))}' AS features, 1.0::DOUBLE AS total, arg_max(feature, importance) AS first
FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS importance FROM ({fr.PLANTED_SQL})" for c in names)})"""


def _rf_importance(spark, sf):
    return ranking_facts(importance.rf_importance(fr.prepared(fr.planted(spark, sf)), fr.PLANTED_FEATURES, "y"))


def _select_top(spark, sf):
    """Ranking by correlation instead of a forest, so that the choice can be checked."""
    df = fr.returned(fr.lineitem(spark, sf)).select(*LINE, "returned")
    ranked = report.label_correlations(df, "returned", 100).select("feature", F.col("correlation").alias("importance"))
    return fr.rounded(importance.select_top_fraction(ranked, 0.85))


SELECT_SQL = f"""
WITH f AS ({fr.RETURNED_SQL}), e AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, abs(corr({c}, returned)) AS importance FROM f" for c in LINE)})
SELECT feature, {r('importance', 'importance')} FROM e ORDER BY importance DESC, feature LIMIT {int(len(LINE) * 0.85)}
"""

SCALED = ["l_quantity", "l_extendedprice", "rare", "const"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _robust(spark, sf):
    df = fr.rare(spark, sf).select(*KEYS, *SCALED)
    return fr.rounded(scale.RobustScale.fit(df, SCALED).transform(df))


def _standard(spark, sf):
    df = fr.rare(spark, sf).select(*KEYS, *SCALED)
    return fr.rounded(scale.StandardScale.fit(df, SCALED).transform(df))


ROBUST_SQL = f"""
WITH f AS ({fr.RARE_SQL}),
q AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}' for c in SCALED)} FROM f)
SELECT {', '.join(KEYS)}, {', '.join(r(f'({c} - m_{c}) / CASE WHEN b_{c} = a_{c} THEN 1.0 ELSE b_{c} - a_{c} END', c) for c in SCALED)} FROM f, q
"""
STANDARD_SQL = f"""
WITH f AS ({fr.RARE_SQL}),
q AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in SCALED)} FROM f)
SELECT {', '.join(KEYS)}, {', '.join(r(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END', c) for c in SCALED)} FROM f, q
"""

QUERIES = {
    "feature_columns": (_split_label, f"SELECT * EXCLUDE (returned) FROM ({fr.RETURNED_SQL})"),
    "label_column": (_label_only, f"SELECT returned, count(*) AS n FROM ({fr.RETURNED_SQL}) GROUP BY 1"),
    "derive_features": (_derive, DERIVE_SQL),
    "derive_overwrite": (_derive_overwrite, OVERWRITE_SQL),
    "align_features": (_align, ALIGN_SQL),
    "finite_or_zero": (_finite, FINITE_SQL),
    "stratified_split": (_split, SPLIT_SQL),
    "stratified_split_hash": (_split_hash, SPLIT_HASH_SQL),
    "assign_folds": (_folds, FOLDS_SQL),
    "class_deficit": (_deficit, DEFICIT_SQL),
    "knn": (_knn, _knn_sql("CAST(embedding AS DOUBLE[])", "AND a.label = b.label")),
    "knn_hashed": (_knn_hashed, HASHED_SQL),
    "knn_many_cells": (_knn_cells, _knn_sql("CAST(embedding AS DOUBLE[])", "")),
    "knn_probe": (_knn_probe, PROBE_SQL),
    "smote": (_smote, SMOTE_SQL),
    "rf_importance": (_rf_importance, ranking_sql(fr.PLANTED_FEATURES)),
    "select_top_fraction": (_select_top, SELECT_SQL),
    "robust_scale": (_robust, ROBUST_SQL),
    "standard_scale": (_standard, STANDARD_SQL),
}
