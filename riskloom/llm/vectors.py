"""Near-duplicate vectors by product quantisation, with exact reranking.

Coarse centroids give inverted lists; a vector's residual is coded in
subspaces. A vector probes every list that can hold a partner: a vector whose
nearest centroid is c lies beyond the bisector of c and the prober's own
centroid, so a list is left out only if that bisector is farther away than the
link distance. In a list the asymmetric table-lookup distance, less the stored
quantisation error, is a lower bound of the true distance; what it leaves is
reranked by exact cosine. Both tests are bounds, so no link is lost.

Centroids and codebooks are fitted on at most `SAMPLE` vectors; every vector is
indexed. Equal vectors of a label are one class with a size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise
from .common import arrow_of, ship
from .components import components
from .tokens import batch_of

COSINE = 0.98
SAMPLE = 32_768
MOST_LISTS = 1024
SUBSPACES = 8
CODES = 64
BLOCK = 512
SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * x @ centres.T + (centres * centres).sum(1)[None, :], 0.0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=int)


class Index:
    """Centroids and residual codebooks for unit vectors of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres = kmeans(sample, lists, rng)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], CODES, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        self.between = np.sqrt(squared(self.centres, self.centres))

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes, and the distance between each vector and its coded form."""
        rest = x - self.centres[lists]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)], axis=1)
        coded = np.hstack([book[codes[:, i]] for i, book in enumerate(self.books)])
        return codes.astype(np.uint8), np.sqrt(((rest - coded) ** 2).sum(1))

    def tables(self, x: np.ndarray, one: int) -> list[np.ndarray]:
        """Squared distances of each vector's residual to every code of every subspace."""
        rest = x - self.centres[one]
        return [squared(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)]

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The own list of each vector, and the lists from it upwards that may hold partners."""
        own, found = np.zeros(len(x), dtype=np.int64), []
        for i in range(0, len(x), 2048):
            d = squared(x[i : i + 2048], self.centres)
            at = d.argmin(1)
            own[i : i + 2048] = at
            gap = d - d.min(1)[:, None]
            near = gap <= 2.0 * (reach + SLACK) * self.between[at] + SLACK
            near &= np.arange(len(self.centres))[None, :] >= at[:, None]
            found += [np.flatnonzero(row) for row in near]
        return own, found


def _rows(raw: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> list[int]:
    """Places of the pairs (x, y) that make a spanning forest of n nodes."""
    top, keep = list(range(n)), []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        if a != b:
            top[a] = b
            keep.append(k)
    return keep


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    Two vectors are linked when their labels are equal and not null and their
    cosine, in double precision, is `cosine` or more. Vectors that are null,
    empty, zero, or hold a null or non-finite component, and rows without a
    label or an id, are linked with nothing; vectors of different lengths are
    never linked. Every row counts in n_links, also one that repeats an id. A
    row with a null id has a null component and is kept.
    """
    spark = vectors.sparkSession
    ship(spark)
    double = "double" in vectors.schema[vector_col].dataType.simpleString()
    dtype, kind = ("<f8", "double") if double else ("<f4", "float")
    v = quoted(vector_col)
    # one row per vector; `key` names equal vectors of a label
    fine = (
        quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    )
    clean = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(label_col).cast("string").alias("label"),
                           F.when(fine, F.transform(v, lambda x: x + F.lit(0.0).cast(kind))).alias("v"))  # -0 becomes 0
    rows = clean.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws("|", "label", F.transform("v", lambda x: x.cast("string"))), 256)))
    keyed = materialise(rows.select("vec_id", "key"), "vector-keys")
    classes = materialise(
        rows.where("key IS NOT NULL").groupBy("key").agg(
            F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
        .withColumn("dims", F.size("v")),
        "vector-classes",
    )
    totals = {r.dims: r.n for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    reach = math.sqrt(2.0 - 2.0 * cosine)
    indexes = {}
    for dims, n in sorted(totals.items()):
        drawn = classes.where(F.col("dims") == dims).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
        sample = _units(np.asarray(drawn.flatten()).astype(np.float64).reshape(-1, dims))
        indexes[dims] = Index(sample, min(MOST_LISTS, max(1, math.isqrt(n))))
    shared = spark.sparkContext.broadcast(indexes)  # at most MOST_LISTS centroids for each length

    ddl = "label string, dims int, list int, own boolean, node long, size long, raw binary, codes binary, error double"
    out = arrow_of(ddl)

    def place(batches):
        for batch in batches:
            node, size, label, vs, dims = (batch.column(i) for i in range(5))
            lengths = np.asarray(dims)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                raw = np.asarray(vs.take(at).flatten()).reshape(len(at), d)
                index, x = shared.value[d], _units(raw.astype(np.float64))
                own, probes = index.probes(x, reach)
                codes, error = index.code(x, own)
                pick = np.repeat(np.arange(len(at)), [len(p) for p in probes])
                lists = np.concatenate(probes)
                mine = lists == own[pick]
                bytes_of = [r.astype(dtype).tobytes() for r in raw]
                code_of = [c.tobytes() for c in codes]
                yield batch_of(
                    out, label=label.take(at[pick]), dims=np.full(len(pick), d), list=lists, own=mine, node=node.take(at[pick]),
                    size=size.take(at[pick]), raw=[bytes_of[i] for i in pick], codes=[code_of[i] if m else None for i, m in zip(pick, mine)],
                    error=error[pick],
                )

    placed = materialise(classes.select("node", "size", "label", "v", "dims").mapInArrow(place, ddl), "vector-lists")
    place_key = ["label", "dims", "list"]
    sizes = materialise(placed.groupBy(*place_key).agg(F.count_if("own").alias("residents"), F.count(F.lit(1)).alias("all")).where("residents > 0"), "list-sizes")
    members = placed.join(sizes, place_key)

    def packed(rows: DataFrame, n: str, name: str, *cols: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / F.lit(BLOCK)))
        return rows.groupBy(*place_key, block.alias(name + "block")).agg(*[F.collect_list(c).alias(name + c) for c in cols])

    residents = materialise(packed(members.where("own"), "residents", "r_", "node", "size", "raw", "codes", "error"), "residents")
    visitors = materialise(packed(members, "all", "v_", "node", "size", "raw", "own"), "visitors")
    ddl2 = "a long, b long, n long"
    out2 = arrow_of(ddl2)

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dims, one, vn, vs, vr, vo, rn, rs, rr, rc, re = (batch.column(k)[i].as_py() for k in range(11))
                index = shared.value[dims]
                vx, rx = _rows(vr, dtype), _rows(rr, dtype)
                vn, rn, vs, rs = (np.array(t, dtype=np.int64) for t in (vn, rn, vs, rs))
                codes = np.frombuffer(b"".join(rc), dtype=np.uint8).reshape(len(rc), -1)
                far = sum(t[:, codes[:, j]] for j, t in enumerate(index.tables(_units(vx), one)))
                near = np.sqrt(far) - np.array(re)[None, :] <= reach + SLACK
                # two residents meet once, from the smaller node
                near &= ~np.array(vo)[:, None] | (vn[:, None] < rn[None, :])
                x, y = np.nonzero(near)
                if not len(x):
                    continue
                vl, rl = np.sqrt((vx * vx).sum(1)), np.sqrt((rx * rx).sum(1))
                hit = np.concatenate([
                    (vx[x[k : k + 65536]] * rx[y[k : k + 65536]]).sum(1) / (vl[x[k : k + 65536]] * rl[y[k : k + 65536]]) >= cosine
                    for k in range(0, len(x), 65536)
                ])
                x, y = x[hit], y[hit]
                left = np.bincount(x, weights=rs[y], minlength=len(vn)).astype(np.int64)
                right = np.bincount(y, weights=vs[x], minlength=len(rn)).astype(np.int64)
                tree = _forest(x, y + len(vn), len(vn) + len(rn))
                l, r = np.flatnonzero(left), np.flatnonzero(right)
                yield batch_of(
                    out2, a=np.concatenate([vn[x[tree]], vn[l], rn[r]]),
                    b=[*rn[y[tree]].tolist(), *[None] * (len(l) + len(r))],
                    n=[*[None] * len(tree), *left[l].tolist(), *right[r].tolist()],
                )

    met = visitors.join(residents, place_key).select(
        "dims", "list", "v_node", "v_size", "v_raw", "v_own", "r_node", "r_size", "r_raw", "r_codes", "r_error")
    found = materialise(met.mapInArrow(meet, ddl2), "vector-links")
    parts = components(found.where("b IS NOT NULL"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of_key = materialise(
        classes.select("key", "node", "size").join(links, "node", "left").join(parts, "node", "left")
        .select("key", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "vector-answers",
    )
    answer = keyed.join(of_key, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    answer = answer.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return answer.withColumnRenamed("vec_id", id_col)


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a AS n, b AS c FROM pairs UNION SELECT r.n, p.b FROM reach r JOIN pairs p ON r.c = p.a
), low AS (SELECT n, min(c) AS c FROM reach GROUP BY n), deg AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, least(e.vec_id, coalesce(low.c, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(low.c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN deg ON deg.a = e.vec_id LEFT JOIN low ON low.n = e.vec_id
"""
