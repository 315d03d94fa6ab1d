"""Exact quantiles with bounded memory.

Spark's `percentile` keeps every distinct value of a column in one buffer, which
is impossible for continuous columns at scale. Here:

1. one pass counts the values, finds the extremes and sketches them; the
   sketch, whose rank error is bounded, gives a bracket around every wanted rank;
2. one pass counts the rows below and inside each bracket, which proves or
   rejects it (a rejected bracket becomes the full range). A bracket that holds
   one value, as in coded columns, is the answer;
3. the values inside the other brackets are cut into a histogram whose cells
   carry count, min and max, and the cell holding the rank becomes the new
   bracket, until the two wanted neighbours are known. Each round divides the
   rows in question by about `fan`.

The sketch only steers the search; the result does not depend on it. Every
pass is a map-side combined aggregate over the needed columns, and the driver
sees at most `fan` cells per wanted rank.

`many_quantiles` takes hundreds of ranks a column at once: a sketch cuts each
column into cells, a pass counts them exactly, and only the values of cells that
hold a wanted rank are grouped and ranked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions.numbers import double_of, quoted
from .shipping import ship
from .small import local_frame

#: Half widths of the brackets, in units of the sketch's rank error; the smallest that spans some rows is taken.
WIDTHS = (4, 40, 400)
SPAN_ROWS = 4
_LARGEST = 1.7976931348623157e308


@dataclass
class _Rank:
    """The order statistics k0 <= k1 (0-based) of one column."""

    col: str
    at: int
    n: int
    pos: float
    lo: float
    hi: float
    below: int = 0
    v0: float | None = None
    v1: float | None = None

    @property
    def k0(self) -> int:
        return math.floor(self.pos)

    @property
    def k1(self) -> int:
        return math.ceil(self.pos)

    @property
    def done(self) -> bool:
        return self.v0 is not None

    def value(self) -> float:
        if self.v0 == self.v1:
            return self.v0
        return self.v0 + (self.v1 - self.v0) * (self.pos - self.k0)


def _sql(x: float) -> str:
    return f"double('{'-' if x < 0 else ''}Infinity')" if math.isinf(x) else f"double('{x!r}')"


def _cell(c: str, lo: float, hi: float, fan: int) -> str:
    # halves keep hi - lo finite for any pair of doubles
    lo, hi = max(lo, -_LARGEST) / 2, min(hi, _LARGEST) / 2
    if hi <= lo:
        return "0"
    half = f"greatest(least({c}, {_sql(_LARGEST)}), {_sql(-_LARGEST)}) / 2"
    return f"least(int(floor(({half} - {_sql(lo)}) / {_sql(hi - lo)} * {fan})), {fan - 1})"


def _narrow(src: DataFrame, ranks: list[_Rank], fan: int) -> None:
    """One pass: replace every open bracket by the histogram cell of its rank."""
    near = [f"{r.col} BETWEEN {_sql(r.lo)} AND {_sql(r.hi)}" for r in ranks]
    entries = [
        f"IF({near[i]}, named_struct('i', {i}, 'cell', {_cell(r.col, r.lo, r.hi, fan)}, 'v', {r.col}), NULL)"
        for i, r in enumerate(ranks)
    ]
    cells = (
        src.where(" OR ".join(near))
        .select(F.expr(f"explode(array({', '.join(entries)})) AS e"))
        .where("e IS NOT NULL")
        .groupBy("e.i", "e.cell")
        .agg(F.count("*").alias("n"), F.min("e.v").alias("lo"), F.max("e.v").alias("hi"))
        .collect()
    )
    by_rank: dict[int, list[Row]] = {}
    for c in cells:
        by_rank.setdefault(c.i, []).append(c)
    for i, r in enumerate(ranks):
        before = r.below
        first = last = None
        for c in sorted(by_rank[i], key=lambda c: c.cell):
            if first is None and r.k0 < before + c.n:
                first, start = c, before
            if r.k1 < before + c.n:
                last = c
                break
            before += c.n
        if first is not last:
            r.v0, r.v1 = first.hi, last.lo
        elif first.lo == first.hi:
            r.v0 = r.v1 = first.lo
        elif first.n == 2 and r.k1 > r.k0:
            r.v0, r.v1 = first.lo, first.hi
        else:
            r.lo, r.hi, r.below = first.lo, first.hi, start


def _brackets(probs: list[float], accuracy: int) -> list[float]:
    """Probabilities on both sides of each wanted one, in every width."""
    return [min(1.0, max(0.0, p + side * w / accuracy)) for p in probs for w in WIDTHS for side in (-1, 1)]


def _bracket(sketch: list[float], j: int, n: int, accuracy: int, low: float, high: float) -> tuple[float, float]:
    """The narrowest bracket of probability number `j` that spans some rows, else the whole range."""
    for i, w in enumerate(WIDTHS):
        if n * w / accuracy >= SPAN_ROWS:
            at = 2 * (j * len(WIDTHS) + i)
            return sketch[at], sketch[at + 1]
    return low, high


def _search(src: DataFrame, ranks: list[_Rank], lows: dict[str, float], highs: dict[str, float], fan: int) -> None:
    counts = []
    for i, r in enumerate(ranks):
        counts += [
            F.expr(f"count_if({r.col} < {_sql(r.lo)})").alias(f"b{i}"),
            F.expr(f"count_if({r.col} <= {_sql(r.hi)})").alias(f"u{i}"),
        ]
    got = src.agg(*counts).first()
    for i, r in enumerate(ranks):
        r.below = got[f"b{i}"]
        if r.below > r.k0 or got[f"u{i}"] <= r.k1:
            r.below, r.lo, r.hi = 0, lows[r.col], highs[r.col]
        elif r.lo == r.hi:
            r.v0 = r.v1 = r.lo
    todo = [r for r in ranks if not r.done]
    while todo:
        before = [(r.lo, r.hi) for r in todo]
        _narrow(src, todo, fan)
        stuck = [r for r, b in zip(todo, before) if not r.done and (r.lo, r.hi) == b]
        if stuck:
            raise ArithmeticError(f"cannot separate values between {stuck[0].lo!r} and {stuck[0].hi!r}")
        todo = [r for r in todo if not r.done]


def quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float] | dict[str, list[float]],
    method: str = "exact",
    accuracy: int = 10_000,
    fan: int = 4096,
    extra: dict[str, Column] | None = None,
) -> tuple[dict[str, list[float | None]], Row]:
    """Quantiles by linear interpolation, and the first pass as a row.

    `probs` holds for all columns, or names those of each. Nulls and NaN are
    skipped; a column without values gives None. `extra`
    aggregates of `df` ride along with the first pass, whose row also holds
    _c<i>_n, _c<i>_min and _c<i>_max of column i. method="approx" takes Spark's
    sketch with the given accuracy in that one pass.
    """
    if method not in ("exact", "approx"):
        raise ValueError(f"unknown quantile method {method!r}")
    names = {c: f"_c{i}" for i, c in enumerate(cols)}
    want = probs if isinstance(probs, dict) else {c: probs for c in cols}
    first = [v.alias(k) for k, v in (extra or {}).items()]
    for c, a in names.items():
        x = double_of(df, c)
        first += [F.count(x).alias(f"{a}_n"), F.min(x).alias(f"{a}_min"), F.max(x).alias(f"{a}_max")]
        asked = want[c] if method == "approx" else _brackets(want[c], accuracy)
        first.append(F.percentile_approx(x, [float(p) for p in asked], accuracy).alias(f"{a}_s"))
    if not first:
        return {}, Row()
    head = df.agg(*first).first()

    out: dict[str, list[float | None]] = {c: [None] * len(want[c]) for c in cols}
    filled = [c for c in cols if head[f"{names[c]}_n"] > 0]
    if method == "approx":
        out |= {c: [float(v) for v in head[f"{names[c]}_s"]] for c in filled}
        return out, head
    if not filled:
        return out, head

    src = df.select(*[double_of(df, c).alias(names[c]) for c in filled])
    ranks = []
    for c in filled:
        a = names[c]
        n = head[f"{a}_n"]
        for j, p in enumerate(want[c]):
            lo, hi = _bracket(head[f"{a}_s"], j, n, accuracy, head[f"{a}_min"], head[f"{a}_max"])
            ranks.append(_Rank(a, j, n, p * (n - 1), lo, hi))
    _search(
        src, ranks,
        {names[c]: head[f"{names[c]}_min"] for c in filled}, {names[c]: head[f"{names[c]}_max"] for c in filled}, fan,
    )
    back = {a: c for c, a in names.items()}
    for r in ranks:
        out[back[r.col]][r.at] = r.value()
    return out, head


def many_quantiles(df: DataFrame, probs: list[float], fan: int = 16, accuracy: int = 10_000) -> list[tuple[float | None, list[float]]]:
    """For each column of doubles, which may hold nulls but no NaN, its smallest value and its quantiles.

    Exact, and interpolated as `percentile` does. The sketch only places the
    cells, about `fan` a probability; the ranks come from exact counts.
    """
    ship(df.sparkSession)
    marks = F.array(*[F.lit(j / (fan * len(probs) + 1)) for j in range(1, fan * len(probs) + 1)])
    aggs = [x for c in df.columns for x in (F.count(quoted(c)), F.min(quoted(c)), F.percentile_approx(quoted(c), marks, accuracy))]
    head = df.agg(*aggs).first()
    sizes, lows = head[0::3], head[1::3]
    edges = [np.unique(np.array(s or [], dtype=np.float64)) for s in head[2::3]]  # a cell is what lies above one edge up to the next

    def columns(batch: pa.RecordBatch):
        for i in range(batch.num_columns):
            x = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)  # nulls come as NaN
            x = x[~np.isnan(x)]
            yield i, x, np.searchsorted(edges[i], x)

    def tally(batches):
        counts = [np.zeros(len(e) + 1, dtype=np.int64) for e in edges]
        for batch in batches:
            for i, _, cell in columns(batch):
                counts[i] += np.bincount(cell, minlength=len(counts[i]))
        for i, n in enumerate(counts):
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"col": np.full(len(cell), i, dtype=np.int32), "cell": cell.astype(np.int32), "n": n[cell]})

    counts = [np.zeros(len(e) + 1, dtype=np.int64) for e in edges]
    for r in df.mapInArrow(tally, "col int, cell int, n long").groupBy("col", "cell").agg(F.sum("n").alias("n")).collect():  # the cells
        counts[r.col][r.cell] = r.n
    places = [[p * (n - 1) for p in probs] if n else [] for n in sizes]
    ranks: dict[tuple[int, int], set[int]] = {}  # of each cell, from its own first value on
    at: dict[tuple[int, int], tuple[int, int]] = {}
    for i, n in enumerate(counts):
        upto = np.cumsum(n)
        for k in {f(x) for x in places[i] for f in (math.floor, math.ceil)}:
            cell = int(np.searchsorted(upto, k, side="right"))
            at[i, k] = cell, k - int(upto[cell] - n[cell])
            ranks.setdefault((i, cell), set()).add(at[i, k][1])
    wanted = [np.zeros(len(e) + 1, dtype=bool) for e in edges]
    for i, cell in ranks:
        wanted[i][cell] = True

    def pick(batches):
        for batch in batches:
            for i, x, cell in columns(batch):
                values, n = np.unique(x[wanted[i][cell]], return_counts=True)
                cell = np.searchsorted(edges[i], values).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"col": np.full(len(values), i, dtype=np.int32), "cell": cell, "x": values, "n": n.astype(np.int64)})

    sought = local_frame(df.sparkSession, [(i, cell, sorted(k)) for (i, cell), k in ranks.items()], "col int, cell int, ranks array<long>")
    grouped = df.mapInArrow(pick, "col int, cell int, x double, n long").groupBy("col", "cell", "x").agg(F.sum("n").alias("n"))
    ranked = grouped.withColumn("upto", F.sum("n").over(Window.partitionBy("col", "cell").orderBy("x")))
    hits = ranked.join(F.broadcast(sought), ["col", "cell"]).select(  # at most two ranks a probability
        "col", "cell", "x", F.explode(F.filter("ranks", lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto")))).alias("rank"))
    value = {(r.col, r.cell, r.rank): r.x for r in hits.collect()}

    def one(i: int, place: float) -> float:
        k0, k1 = math.floor(place), math.ceil(place)
        v0, v1 = value[(i, *at[i, k0])], value[(i, *at[i, k1])]
        return v0 if v0 == v1 else (k1 - place) * v0 + (place - k0) * v1

    return [(lows[i], [one(i, place) for place in places[i]]) for i in range(len(edges))]
