"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Equal shingle sets collapse into one class before anything else. Classes meet
in the buckets of banded signatures. In each bucket one leader is compared with
all others; where that leaves several components, the rest is compared in
packed blocks of bounded size, but never two members of one component. A comparison looks at the
signatures in batches: after each, the number of agreeing hashes gives a
posterior of the similarity, and the pair is pruned once the posterior chance
of reaching the threshold is below `miss`. Every survivor is verified exactly
on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..plans.durable import materialise
from .common import arrow_of, give_back, renamed, text_rows
from .components import components
from .shingles import WORDS, shingle_sets
from .tokens import batch_of

HASHES = 128
BATCH = 16
MISS = 1e-6
THRESHOLD = (85, 100)
#: A packed block holds about so many documents and bytes of shingle sets; more than that only for a single long document.
BLOCK, BLOCK_BYTES = 256, 1_000_000
BROADCAST_ROWS = 500_000

_rng = np.random.default_rng(7)
_FACTOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def banding(threshold: float, miss: float = MISS, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, hashes in each): the longest bands that miss a pair right at `threshold` with a chance of at most `miss`."""
    for rows in range(hashes, 0, -1):
        if (1 - threshold**rows) ** (hashes // rows) <= miss:
            return hashes // rows, rows
    raise ValueError(f"{hashes} hashes miss pairs at a similarity of {threshold} with a chance above {miss}")


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions over a set of 64-bit shingle hashes."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(h), 1024):
        least = np.minimum(least, (_FACTOR[:, None] * h[None, a : a + 1024] + _SHIFT[:, None]).min(axis=1))
    return least


def matches_needed(threshold: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, agreeing hashes needed) after each batch.

    With a uniform prior the similarity after m of n agreeing hashes follows
    Beta(m + 1, n - m + 1); a pair goes on while the chance of `threshold` or
    more is at least `miss`.
    """
    def chance(m: int, n: int) -> float:
        return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return [(n, next(m for m in range(n + 1) if chance(m, n) >= miss)) for n in range(batch, hashes + 1, batch)]


def surviving(left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of two signature matrices that no batch prunes."""
    alive, agree, done = np.arange(len(left)), np.zeros(len(left), dtype=np.int64), 0
    for n, least in needed:
        agree = agree + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        alive, agree, done = alive[agree >= least], agree[agree >= least], n
    return alive


def _matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype="<u4").reshape(len(signatures), HASHES)


def sketches(docs: DataFrame, id_col: str, text_col: str, n_words: int = WORDS) -> DataFrame:
    ddl = "doc_id long, n_shingles long, set_key binary, signature binary"
    out = arrow_of(ddl)

    def run(batches):
        for batch in batches:
            sets = ((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s).tobytes()) if len(s) else (0, None, None)
                    for s in shingle_sets(batch.column(1).to_pylist(), n_words))
            n, keys, signatures = zip(*sets)
            yield batch_of(out, doc_id=batch.column(0), n_shingles=n, set_key=keys, signature=signatures)

    return text_rows(docs, id_col, text_col).mapInArrow(run, ddl)


def _bayes_pairs(pairs: DataFrame, nodes: DataFrame, needed) -> DataFrame:
    """The pairs (a, b) of classes that the signatures do not prune."""
    ddl = "a long, b long"
    out = arrow_of(ddl)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                alive = surviving(_matrix(batch.column(2).to_pylist()), _matrix(batch.column(3).to_pylist()), needed)
                yield batch_of(out, a=batch.column(0).take(alive), b=batch.column(1).take(alive))

    own = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    other = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(own, "a").join(other, "b").select("a", "b", "sa", "sb").mapInArrow(run, ddl).distinct()


def _shingled(texts: DataFrame, n_words: int) -> DataFrame:
    """(node, shingles): the sorted shingle hashes of each text."""
    ddl = "node long, shingles binary"
    out = arrow_of(ddl)

    def run(batches):
        for batch in batches:
            yield batch_of(out, node=batch.column(0), shingles=[s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), n_words)])

    return texts.mapInArrow(run, ddl)


def _block_links(members: DataFrame, needed, threshold: tuple[int, int]) -> DataFrame:
    """Links between different components that meet in one group.

    members: (grp, node, component, signature, shingles). What lies outside a
    group's largest component meets all of the group in packed blocks, so the
    rows of the join are blocks, not pairs. A block pair prunes by signature,
    verifies on the full sets, and passes over components that it has joined.
    """
    sizes = members.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("shingles")).alias("bytes"))
    largest = materialise(sizes.groupBy("grp").agg(
        F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("total"),
        (F.sum("count") - F.max("count")).alias("others"), F.sum("bytes").alias("total_bytes"),
        (F.sum("bytes") - F.max_by("bytes", F.struct("count", "component"))).alias("others_bytes"),
    ), "groups")
    known = materialise(members.join(largest, "grp"), "members")

    def packed(rows: DataFrame, n: str, name: str) -> DataFrame:
        blocks = F.greatest(F.ceil(F.col(n) / F.lit(BLOCK)), F.ceil(F.col(n + "_bytes") / F.lit(BLOCK_BYTES)))
        return rows.groupBy("grp", F.pmod(F.xxhash64("node"), blocks).alias("block")).agg(
            *[F.collect_list(c).alias(name + c) for c in ("node", "component", "signature", "shingles")]
        ).drop("block")

    left = materialise(packed(known.where("component != main"), "others", "l_"), "blocks")
    right = materialise(packed(known, "total", "r_"), "blocks")
    ddl = "a long, b long"
    out = arrow_of(ddl)
    part, whole = threshold

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ln, lp, ls, rn, rp, rs = (batch.column(k)[i].as_py() for k in (0, 1, 2, 4, 5, 6))
                lt, rt = ([np.frombuffer(t.as_buffer(), dtype=np.uint64) for t in batch.column(k)[i].values] for k in (3, 7))  # not copied
                top: dict[int, int] = {}

                def root(c: int) -> int:
                    while (up := top.get(c, c)) != c:
                        c = up
                    return c

                x, y = np.nonzero(np.array(lp, dtype=np.int64)[:, None] != np.array(rp, dtype=np.int64)[None, :])
                ls, rs = _matrix(ls), _matrix(rs)
                a, b = [], []
                for k in range(0, len(x), 65536):
                    p, q = x[k : k + 65536], y[k : k + 65536]
                    for j in surviving(ls[p], rs[q], needed).tolist():
                        u, v = int(p[j]), int(q[j])
                        one, two = root(lp[u]), root(rp[v])
                        if one == two:
                            continue
                        both = len(np.intersect1d(lt[u], rt[v], assume_unique=True))
                        if both and whole * both >= part * (len(lt[u]) + len(rt[v]) - both):
                            top[one] = two
                            a.append(ln[u])
                            b.append(rn[v])
                yield batch_of(out, a=a, b=b)
            give_back()

    met = left.join(right, "grp")
    return met.select(*[side + c for side in ("l_", "r_") for c in ("node", "component", "signature", "shingles")]).mapInArrow(run, ddl)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. sets: (node, shingles) of all ids in pairs."""
    ddl = "a long, b long"
    out = arrow_of(ddl)
    part, whole = threshold

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.uint64) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and whole * both >= part * (len(x) + len(y) - both):
                    keep.append(i)
            at = np.array(keep, dtype=np.int64)
            yield batch_of(out, a=batch.column(0).take(at), b=batch.column(1).take(at))

    own = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    return pairs.join(own, "a").join(other, "b").select("a", "b", "xa", "xb").mapInArrow(run, ddl)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD,
                    n_words: int = WORDS, miss: float = MISS) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, kept).

    Two documents are linked when their shingle sets have a Jaccard similarity
    of threshold[0] / threshold[1] or more; component_id is the smallest id
    reachable by links. A text without words, empty or null is linked with
    nothing. Rows that repeat an id are one document, linked if any of its
    texts is; a row with a null id is linked with nothing, has a null
    component_id and is kept. An empty table gives an empty one.

    Bands follow the threshold: they miss a pair right at it with a chance of at
    most `miss` (25 of 5 hashes and 4e-7 at 0.85, 32 of 4 and 5e-8 at 0.8), and
    the pruning with about `miss`. Thresholds too low for that are refused.
    """
    needed = matches_needed(threshold[0] / threshold[1], miss)
    n_bands, band_rows = banding(threshold[0] / threshold[1], miss)
    rows = materialise(sketches(docs, id_col, text_col, n_words), "sketches")
    nodes = materialise(
        rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")),
        "classes",
    )
    bands = nodes.select("node", F.explode(F.array(*[
        F.xxhash64(F.lit(b), F.substring("signature", 4 * band_rows * b + 1, 4 * band_rows)) for b in range(n_bands)
    ])).alias("bucket"))
    # a bucket's leader is drawn, so that a document meets another leader in each of its buckets
    draw = F.struct(F.xxhash64("bucket", "node"), "node")
    shared = materialise(bands.groupBy("bucket").agg(F.min(draw)["node"].alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "buckets")
    members = materialise(bands.join(shared, "bucket"), "members")
    # the full sets of all documents that meet another one, written once and read by both verifying steps
    ids = materialise(members.select(F.col("node").alias("doc_id")).distinct(), "ids")
    small = ids.count() <= BROADCAST_ROWS
    meeting = text_rows(docs, id_col, text_col).join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    sets = materialise(_shingled(meeting, n_words), "sets")
    star = members.where("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    first = materialise(_bayes_pairs(star, nodes, needed), "pairs")

    links = materialise(_verified(first, sets, threshold), "links")
    found = components(links)

    label = F.coalesce("component", "node").alias("component")
    labelled = members.select("bucket", "node").join(found, "node", "left").select("bucket", "node", label)
    # buckets with several components; those with the same largest one are looked at together
    sizes = labelled.groupBy("bucket", "component").count()
    mixed = materialise(sizes.groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("grp"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "mixed")
    in_groups = materialise(labelled.join(mixed, "bucket").select("grp", "node", "component").distinct(), "open")
    full = in_groups.join(nodes.select("node", "signature"), "node").join(sets, "node")
    found = components(links.unionByName(_block_links(full, needed, threshold)))

    of_class = nodes.select("set_key", "node").join(found, "node", "left").select("set_key", label)
    answer = rows.select("doc_id", "n_shingles", "set_key").join(materialise(of_class, "labels"), "set_key", "left")
    by_id = answer.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return renamed(by_id.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows that `near_duplicates` keeps, with all their columns: of each component the document with the smallest id."""
    found = near_duplicates(docs, id_col, text_col, threshold)
    dropped = materialise(found.where("NOT kept").select(F.col(id_col).alias("_dropped")).distinct(), "dropped")
    small = dropped.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if small else dropped, docs[id_col] == F.col("_dropped"), "left_anti")
