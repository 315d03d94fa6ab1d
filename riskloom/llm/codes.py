"""Vector code compression: product codes by integer k-means with memoised grid cells.

A part's nearest entry is found through its coarse grid cell. For a cell, the
least and greatest squared distance of every entry to any point of its box are
known; an entry whose least distance exceeds some entry's greatest one is
dominated across the box and never nearest. What is left is kept in a bounded
cache by the cell's hash key, and only those entries are evaluated exactly. All
arithmetic is on integers, so the answer is exact and the same however the rows
are dealt out.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise
from ..plans.small import pin_small, spread_join
from .common import arrow_of, ship
from .tokens import batch_of

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Doubles this large or larger count as non-finite; no float is.
TOO_LARGE = 2.0**150
#: Cells kept for each part position; a cache that they would overfill is emptied.
CACHED_CELLS = 100_000
#: Cells are this part of a codebook's mean spread per component.
CELLS_PER_SPREAD = 1
ROWS_AT_ONCE = 4096


def part_cuts(dims: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin and end; equal parts if `dims` allows them."""
    return [dims * i // parts for i in range(parts + 1)]


def to_integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit integers if all squared distances fit, else as Python's integers."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2**44 / scale / x.shape[-1]:
        return np.floor(x * scale).astype(np.int64)
    big = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in x.ravel().tolist()]
    out = np.empty(x.size, dtype=object)
    out[:] = big
    return out.reshape(x.shape)


class Cells:
    """The nearest entries of one part position, by cached grid cells."""

    def __init__(self, book: np.ndarray, limit: int = CACHED_CELLS):
        self.book, self.limit, self.known = book, limit, {}
        self.exact = book.dtype != object and (not book.size or np.abs(book).max() < 2**28)
        spread = float((book.max(0) - book.min(0)).astype(np.float64).mean()) if book.size else 0.0
        self.width = max(1, int(spread * CELLS_PER_SPREAD))

    def _left(self, cells: np.ndarray) -> np.ndarray:
        """Which entries no other dominates across the box of each cell."""
        low = cells[:, None, :] * self.width
        high = low + self.width - 1
        below, above = low - self.book[None], self.book[None] - high
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(high - self.book[None], self.book[None] - low)
        return (least * least).sum(2) <= (most * most).sum(2).min(1)[:, None]

    def candidates(self, x: np.ndarray) -> np.ndarray:
        cells, of = np.unique(x // self.width, axis=0, return_inverse=True)
        keys = [c.tobytes() for c in cells]
        found = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(found) > self.limit:
            self.known.clear()
            found = list(range(len(keys)))
        for i in range(0, len(found), 1024):
            part = found[i : i + 1024]
            self.known.update(zip([keys[j] for j in part], self._left(cells[part])))
        return np.array([self.known[k] for k in keys])[of.ravel()]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; equal distances go to the lower entry."""
        if not x.shape[1]:
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        if x.dtype == object or not self.exact:  # beyond 64 bits: every entry, in Python's integers
            d = ((x.astype(object)[:, None, :] - self.book.astype(object)[None]) ** 2).sum(2)
            at = np.array([row.index(min(row)) for row in d.tolist()], dtype=np.int64)
            return at, d[np.arange(len(x)), at]
        row, entry = np.nonzero(self.candidates(x))  # ordered by row, then entry; no row is without one
        rest = x[row] - self.book[entry]
        d = (rest * rest).sum(1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(d, first)
        hit = np.flatnonzero(d == best[row])
        one = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        return entry[one], d[one]


def _book_array(rows: list[list[int]]) -> np.ndarray:
    big = any(abs(v) >= 2**62 for r in rows for v in r)
    return np.array(rows, dtype=object if big else np.int64).reshape(len(rows), -1)


def start_books(x: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    cuts = part_cuts(x.shape[1], parts)
    return [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for row in b for v in row).encode()).hexdigest()


def _vectors(batch, at: int):
    """(length, places, integer rows) of the vectors of a batch, some rows at a time."""
    column = batch.column(at)
    lengths = np.diff(np.asarray(column.offsets))
    for dims in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == dims)
        for i in range(0, len(places), ROWS_AT_ONCE):
            some = places[i : i + ROWS_AT_ONCE]
            yield dims, some, to_integers(np.asarray(column.take(some).flatten()).reshape(len(some), dims))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: (id, code, error, label_error, codebooks_sha256).

    Vectors that are null or hold a null or non-finite component (a double of
    `TOO_LARGE` counts as one) are dropped; an empty vector has the code of
    zeros. Vectors of another length have codebooks of their own. With fewer than `entries` vectors a codebook has
    fewer entries. Rows that repeat an id stay, null ids come last among the
    starting entries, equal ids go by their vectors. An error beyond a long is
    null. Codebooks are the only thing the driver holds.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = quoted(vector_col)
    fine = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE)), F.lit(False))
    label = quoted(label_col).cast("string")
    rows = materialise(
        vectors.where(fine).select(quoted(id_col).alias("vec_id"), F.coalesce(F.concat(F.lit("="), label), F.lit("")).alias("label"), v.alias("v")),
        "code-vectors")
    books: dict[int, list[np.ndarray]] = {}
    for (dims,) in rows.select(F.size("v").alias("dims")).distinct().collect():  # one row per length
        first = rows.where(F.size("v") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        books[dims] = start_books(to_integers(np.array([r.v for r in first], dtype=np.float64).reshape(len(first), dims)), parts)

    ddl = "dims int, part int, entry int, place int, high decimal(38,0), low decimal(38,0), n long"
    out = arrow_of(ddl)

    def summed(held):
        def sums(batches):
            finders = {dims: [Cells(b) for b in own] for dims, own in held.items()}
            total = {dims: [np.zeros(b.shape, dtype=object) for b in own] for dims, own in held.items()}
            count = {dims: [np.zeros(len(b), dtype=np.int64) for b in own] for dims, own in held.items()}
            for batch in batches:
                for dims, _, x in _vectors(batch, 0):
                    cuts = part_cuts(dims, parts)
                    for p, finder in enumerate(finders[dims]):
                        part = x[:, cuts[p] : cuts[p + 1]]
                        at, _ = finder.nearest(part)
                        more = np.zeros(finder.book.shape, dtype=part.dtype)
                        np.add.at(more, at, part)
                        total[dims][p] += more
                        count[dims][p] += np.bincount(at, minlength=len(finder.book))
            found = [(dims, p, e, k, int(t), int(count[dims][p][e])) for dims, own in total.items() for p, part in enumerate(own)
                     for e, row in enumerate(part) if count[dims][p][e] for k, t in enumerate(row)]
            if found:
                cols = list(zip(*found))
                yield batch_of(out, dims=cols[0], part=cols[1], entry=cols[2], place=cols[3], high=[Decimal(t >> 62) for t in cols[4]], low=[Decimal(t & (2**62 - 1)) for t in cols[4]], n=cols[5])

        return sums

    for _ in range(rounds):
        new = rows.select("v").mapInArrow(summed(books), ddl).groupBy("dims", "part", "entry", "place").agg(*[F.sum(c).alias(c) for c in ("high", "low", "n")]).collect()
        grown = {dims: [b.astype(object) for b in own] for dims, own in books.items()}
        for r in new:  # entries x dimensions, however many vectors
            grown[r.dims][r.part][r.entry, r.place] = ((int(r.high) << 62) + int(r.low)) // r.n
        books = {dims: [_book_array([[int(x) for x in row] for row in b]) for b in own] for dims, own in grown.items()}

    digests = {dims: books_digest(own) for dims, own in books.items()}
    kind = dict(rows.dtypes)["vec_id"]
    ddl2 = f"vec_id {kind}, label string, code string, error long, codebooks_sha256 string"
    out2 = arrow_of(ddl2)

    def code(batches):
        finders = {dims: [Cells(b) for b in own] for dims, own in books.items()}
        for batch in batches:
            for dims, places, x in _vectors(batch, 2):
                cuts = part_cuts(dims, parts)
                found = [f.nearest(x[:, cuts[p] : cuts[p + 1]]) for p, f in enumerate(finders[dims])]
                codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                error = sum(d.astype(object) for _, d in found).tolist()
                yield batch_of(
                    out2, vec_id=batch.column(0).take(places), label=batch.column(1).take(places), code=[c.tobytes().hex() for c in codes],
                    error=[e if e < 2**63 else None for e in error], codebooks_sha256=[digests[dims]] * len(places))

    coded = materialise(rows.mapInArrow(code, ddl2), "vector-codes")
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(whole.try_cast("long").alias("label_error"))
    answer = spread_join(coded, pin_small(sums), ["label"], coded.count())
    return answer.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def _rounds_sql() -> str:
    """Starting entries, six rounds and the last assignment."""
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, list_slice(v, CAST(p * len(v) // {PARTS} + 1 AS BIGINT), CAST((p + 1) * len(v) // {PARTS} AS BIGINT)) AS x
  FROM kept, (SELECT unnest(range({PARTS})) AS p)),
firsts AS (SELECT r - 1 AS e, v FROM kept WHERE r <= {ENTRIES}),
b0 AS MATERIALIZED (SELECT p, e, list_slice(v, CAST(p * len(v) // {PARTS} + 1 AS BIGINT), CAST((p + 1) * len(v) // {PARTS} AS BIGINT)) AS c
  FROM firsts, (SELECT unnest(range({PARTS})) AS p))"""]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT r, p, x, e, {distance} AS d FROM parts JOIN b{i} USING (p)) GROUP BY r, p)")
        if i < ROUNDS:
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, o.c) AS c FROM b{i} o LEFT JOIN (
  SELECT p, e, list(CAST(floor(s / k) AS BIGINT) ORDER BY j) AS c FROM (
    SELECT p, e, j, sum(CAST(x[j] AS DOUBLE)) AS s, count(*) AS k FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY p, e, j) GROUP BY p, e
  ) n USING (p, e))""")
    return ",".join(steps)


OP11_SQL = f"""
WITH {_rounds_sql()},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT r, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), h
"""
