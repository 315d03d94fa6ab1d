"""Embedding whitening: leading components by Jacobi-Davidson over distributed products.

The covariance matrix is never formed. Its product with a block of directions
is one pass over the vectors: every task centres its rows, multiplies them and
sends back one sum per dimension. All wanted pairs are worked on at once. The
correction equation of each is solved by a few steps of MINRES, and one pass
serves that step of all equations. Corrections enlarge the search space, its
Rayleigh-Ritz pairs are locked when their residuals reach double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise
from .common import arrow_of, ship
from .tokens import batch_of

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Components this large or larger leave the integers' range; their vectors count as non-finite.
TOO_LARGE = 2.0**51
#: Residuals relative to the largest eigenvalue: wanted, and still accepted when rounding stops all progress.
PRECISE, STALLED = 1e-13, 1e-11
#: Eigenvalues this small beside the largest are zero.
ZERO = 1e-12
INNER_STEPS, INNER_GAIN = 5, 0.1
ROWS_AT_ONCE, BLOCK_BYTES = 4096, 2_000_000

Product = Callable[[np.ndarray], np.ndarray]


def orthonormal(x: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `x` adds to `against`; directions that add nothing are left out."""
    kept = [np.zeros((len(x), 0))]
    for j in range(x.shape[1]):
        column = x[:, j]
        size = np.linalg.norm(column)
        if not size:
            continue
        column = column / size
        for _ in range(3):
            for q in (*against, np.hstack(kept)):
                column = column - q @ (q.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            kept.append(column[:, None])
    return np.hstack(kept)


def minres(product: Product, shift: np.ndarray, project: Product, rhs: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Minimal residual steps for several equations project(A - shift) x = rhs, each with its own shift, in common passes."""
    tiny = np.finfo(float).tiny
    size = np.maximum(np.linalg.norm(rhs, axis=0), tiny)
    eta, x, v = size.copy(), np.zeros_like(rhs), rhs / size
    before, w0, w1 = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    beta, c0, c1, s0, s1 = np.zeros_like(size), np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        y = project(product(v) - v * shift)
        alpha = (v * y).sum(0)
        y = y - v * alpha - before * beta
        after = np.linalg.norm(y, axis=0)
        delta = c1 * alpha - c0 * s1 * beta
        one = np.maximum(np.hypot(delta, after), tiny)
        two, three = s1 * alpha + c0 * c1 * beta, s0 * beta
        c0, c1, s0, s1 = c1, delta / one, s1, after / one
        w0, w1 = w1, (v - w0 * three - w1 * two) / one
        x = x + w1 * (c1 * eta)
        eta = -s1 * eta
        before, v, beta = v, y / np.maximum(after, tiny), after
        if (np.abs(eta) <= gain * size).all():
            break
    return x


def jacobi_davidson(product: Product, dims: int, want: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric non-negative operator; fewer than `want` where its rank ends."""
    want = min(want, dims)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    space = orthonormal(np.random.default_rng(seed).normal(size=(dims, min(dims, want + 2))))
    image = product(space)
    most, stale, best = min(dims, 6 * want + 4), 0, np.inf
    while len(values) < want and space.shape[1]:
        inside = space.T @ image
        theta, turn = np.linalg.eigh((inside + inside.T) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, turn = theta[order], turn[:, order]
        space, image = space @ turn, image @ turn
        top = max([*values[:1].tolist(), float(theta[0])])
        if theta[0] <= ZERO * top or top <= 0:  # nothing but rounding is left in this space: is there anything beyond it?
            fresh = orthonormal(np.random.default_rng(seed + len(values)).normal(size=(dims, 2)), locked, space)
            if not fresh.shape[1] or top <= 0:
                break
            space, image = fresh, product(fresh)
            if np.linalg.norm(image) <= ZERO * top:
                break
            continue
        k = min(want - len(values), space.shape[1])
        rest = image[:, :k] - space[:, :k] * theta[:k]
        rest -= locked @ (locked.T @ rest)
        sizes = np.linalg.norm(rest, axis=0)
        whole = space.shape[1] + len(values) >= dims
        stale = 0 if sizes[0] < 0.5 * best else stale + 1
        best = min(best, sizes[0])
        done = 0
        while done < k and (sizes[done] <= PRECISE * top or (stale > 3 and sizes[done] <= STALLED * top)) and theta[done] > ZERO * top:
            done += 1
        if done:
            locked, values = np.hstack([locked, space[:, :done]]), np.concatenate([values, theta[:done]])
            space, image, stale, best = space[:, done:], image[:, done:], 0, np.inf
            continue
        if stale > 12:
            raise RuntimeError(f"residuals stay at {sizes[0] / top:.1e} of the largest eigenvalue")
        if whole:  # the space holds everything: only its rounding can be mended
            space = orthonormal(space, locked)
            image = product(space)
            continue
        near = np.hstack([locked, space[:, :k]])
        project = lambda y, q=near: y - q @ (q.T @ y)
        more = minres(product, theta[:k], project, -project(rest), INNER_STEPS, INNER_GAIN)
        if space.shape[1] + k > most:  # restart from the best pairs
            space, image = space[:, : 2 * want], image[:, : 2 * want]
        more = orthonormal(more, locked, space)
        if not more.shape[1]:
            more = orthonormal(np.random.default_rng(seed + space.shape[1]).normal(size=(dims, k)), locked, space)
        space, image = np.hstack([space, more]), np.hstack([image, product(more)])
    if not len(values):
        return values, locked
    # a last Rayleigh-Ritz step among the locked pairs
    locked = orthonormal(locked)
    inside = locked.T @ product(locked)
    theta, turn = np.linalg.eigh((inside + inside.T) / 2)
    order = np.argsort(-theta, kind="stable")
    return theta[order], locked @ turn[:, order]


def _integers(batch, at: int, dims: int):
    """(places, x rows as 64-bit integers) of a batch, some rows at a time."""
    column = batch.column(at)
    for i in range(0, batch.num_rows, ROWS_AT_ONCE):
        some = column.slice(i, ROWS_AT_ONCE)
        x = np.asarray(some.flatten()).astype(np.float64).reshape(len(some), dims)
        yield slice(i, i + len(some)), np.floor(x * SCALE).astype(np.int64) + OFFSET


def _exact_sum(x: np.ndarray) -> np.ndarray:
    return x.sum(0) if np.abs(x).max(initial=0) < 2**62 // max(1, len(x)) else x.astype(object).sum(0)


class Centred:
    """The usable vectors of one length: exact sums, centred products."""

    def __init__(self, rows: DataFrame, dims: int):
        self.rows, self.dims = rows, dims
        ddl = "place int, total decimal(38,0), n long"
        out = arrow_of(ddl)

        def sums(batches):
            total, n = np.zeros(dims, dtype=object), 0
            for batch in batches:
                for _, x in _integers(batch, 0, dims):
                    total, n = total + _exact_sum(x), n + len(x)
            if n:
                yield batch_of(out, place=np.arange(dims), total=[Decimal(int(t)) for t in total], n=[n] * dims)

        found = rows.select("v").mapInArrow(sums, ddl).groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        self.n = found[0].n
        self.sums = [int(r.total) for r in sorted(found)]
        # x - S/n in two steps, so that nothing is lost to the offset
        self.floor = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.over = np.array([s % self.n for s in self.sums], dtype=object)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])
        self.blocks = materialise(rows.select("v").mapInArrow(self._pack(), "block binary"), "centred")

    def _pack(self):
        """Centred rows as blocks of doubles: every later pass reads them as they lie."""
        dims, low, rest = self.dims, self.floor, self.rest
        out, at_once = arrow_of("block binary"), max(1, BLOCK_BYTES // (8 * dims))

        def pack(batches):
            for batch in batches:
                for _, x in _integers(batch, 0, dims):
                    y = (x - low) - rest
                    for i in range(0, len(y), at_once):
                        yield batch_of(out, block=[y[i : i + at_once].tobytes()])

        return pack

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block, as one pass over the vectors."""
        dims, width = block.shape
        ddl = "place int, " + ", ".join(f"c{j} double" for j in range(width))
        out = arrow_of(ddl)

        def part(batches):
            total, rows = np.zeros((dims, width)), 0
            for batch in batches:
                for raw in batch.column(0):
                    y = np.frombuffer(raw.as_buffer(), dtype=np.float64).reshape(-1, dims)
                    total += y.T @ (y @ block)
                    rows += len(y)
            if rows:
                yield batch_of(out, place=np.arange(dims), **{f"c{j}": total[:, j] for j in range(width)})

        found = self.blocks.mapInArrow(part, ddl).groupBy("place").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)]).collect()
        return np.array([tuple(r)[1:] for r in sorted(found)]).reshape(dims, width) / self.n

    def whitened(self, values: np.ndarray, axes: np.ndarray) -> DataFrame:
        """(vec_id, deviation, spread, w): exact deviation, squared distance to the mean, whitened coordinates."""
        dims, low, rest, over, n = self.dims, self.floor, self.rest, self.over, self.n
        turn = axes / np.sqrt(values)
        ddl = f"vec_id {dict(self.rows.dtypes)['vec_id']}, deviation decimal(38,0), spread double, w array<double>"
        out = arrow_of(ddl)
        small = np.array([int(o) for o in over], dtype=np.int64)

        def place(batches):
            for batch in batches:
                for at, x in _integers(batch, 1, dims):
                    far = x - low
                    if (int(np.abs(far).max(initial=0)) + 1) ** 2 * n * n * dims < 2**62:
                        off = far * n - small
                        deviation = (off * off).sum(1).tolist()
                    else:
                        off = far.astype(object) * n - over
                        deviation = [int(d) for d in (off * off).sum(1)]
                    y = far - rest
                    yield batch_of(out, vec_id=batch.column(0).slice(at.start, at.stop - at.start), spread=(y * y).sum(1),
                                   deviation=[Decimal(d) if d < 10**38 else None for d in deviation], w=list(y @ turn))

        return self.rows.mapInArrow(place, ddl)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: (id, component, n, deviation, whitened, explained, identity_error).

    A component c counts as floor(1024 * c) + 100000. Vectors that are null or
    empty, or hold a null, non-finite or too large component (`TOO_LARGE`), are
    dropped; rows that repeat an id count each. Vectors of another length are a
    fit of their own. There are as many components as the covariance has
    positive eigenvalues, `components` at most: equal or single vectors give no
    row. `deviation` is an exact decimal, null beyond 38 digits. The driver
    holds a few directions, never vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = quoted(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE)), F.lit(False))
    rows = materialise(vectors.where(fine).select(quoted(id_col).alias("vec_id"), v.alias("v")), "whiten-vectors")
    answer = spark.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    lengths = sorted(r.dims for r in rows.select(F.size("v").alias("dims")).distinct().collect())
    for dims in lengths:
        own = Centred(rows.where(F.size("v") == dims) if len(lengths) > 1 else rows, dims)
        values, axes = jacobi_davidson(own.product, dims, components)
        if not len(values):
            continue
        held = materialise(own.whitened(values, axes), "whitened")
        w = [F.col("w")[i] for i in range(len(values))]
        *means, trace = held.agg(*[F.avg(x) for x in w], F.avg("spread")).first()
        pairs = [(i, j) for i in range(len(w)) for j in range(i + 1)]
        far = [x - F.lit(m) for x, m in zip(w, means)]
        found = held.agg(*[F.avg(far[i] * far[j]) for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))
        share = F.array(*[F.lit(float(e) / trace) for e in values])
        part = held.select("vec_id", "deviation", F.posexplode("w").alias("_i", "whitened")).select(
            "vec_id", (F.col("_i") + 1).cast("int").alias("component"), F.lit(own.n).cast("long").alias("n"), "deviation", "whitened",
            share[F.col("_i")].alias("explained"), F.lit(float(error)).alias("identity_error"))
        answer = answer.unionByName(part)
    return answer.withColumnRenamed("vec_id", id_col)

