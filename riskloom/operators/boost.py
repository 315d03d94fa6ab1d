"""Second-order boosted trees with log loss, grown level by level as Spark jobs.

Features are cut into at most `max_bin` bins at quantiles. A level of a tree is
one job: every task applies the trees that its stored margins lack, adds up the
gradients and curvatures of its rows by (model, node, feature, bin) and sends
the sums on; Spark adds them, runs along the bins of each (model, node, feature)
and hands one best split per (model, node) to the driver. Where the cells are few,
their number being known beforehand, the driver searches the sums itself. So
nothing that grows with the rows leaves the executors.

Several models grow in the same jobs: `model` is one more grouping key. The five
models of a cross-validation, or all models of a batch of trials, cost as many
jobs as one model does.

With `num_leaves` a tree grows leaf by leaf instead: always the leaf that gains
most is split. A job looks at the children of all leaves that may still get
their turn, so a tree takes as many jobs as it is deep, not as it has leaves;
what was looked at in vain is cut off. With `top_rate` and `other_rate` each
tree sees the rows of large gradients and a weighted part of the others.

With `symmetric` all nodes of a level share one cut, the one that gains most in
all of them together. With `segments` boosting is ordered: rows lie in segments
of doubling size in hash order, and a row's margin comes from leaf values of
rows in earlier segments only, so no gradient rests on the row's own label. One
more job a tree adds up gradients by (model, leaf, segment). The finished trees
hold the values of all segments.

Gradients are added as 64-bit integers (`UNIT` of one), which makes every sum
exact: the trees do not depend on how rows are dealt out, nor on lost tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise
from ..plans.quantiles import many_quantiles
from ..plans.shipping import ship
from ..plans.small import local_frame

UNIT = 2.0**24
#: A split must gain more than this.
LEAST_GAIN = 1e-6
#: Margins are written anew after so many trees of a model, or tree nodes of all models.
KEEP_TREES, KEEP_NODES = 16, 20_000
#: Up to so many models their margins are short beside the rows, and written after fewer trees.
FEW_MODELS, KEEP_FEW = 4, 4
#: Margins of one stored block, which bounds its rows by the number of models, and blocks of a row group, which readers and writers hold whole.
BLOCK_BYTES, GROUP_BLOCKS = 1 << 20, 8
#: A task sends its sums on when they fill so many cells.
CELLS_AT_ONCE = 4_000_000
#: Sums that fill at most so many cells are searched on the driver, which saves two shuffles a level; more are searched by Spark.
DRIVER_CELLS = 500_000
#: Gains of one cut in several nodes are added as whole parts of so many, so that their order does not matter.
GAIN_UNIT = 2.0**20
#: Up to this number of rows one aggregate takes the quantiles, beyond it cells are counted; both are exact.
CUT_ROWS = 200_000

# The search ranges (name, kind, low, high), those of trees that grow leaf by leaf below.
BOOST_SPACE = (
    ("n_estimators", "int", 500, 1200),
    ("max_depth", "int", 5, 12),
    ("learning_rate", "log", 0.005, 0.1),
    ("subsample", "float", 0.7, 1.0),
    ("colsample_bytree", "float", 0.7, 1.0),
    ("min_child_weight", "int", 1, 10),
    ("gamma", "float", 0.0, 0.5),
    ("reg_alpha", "float", 0.0, 2.0),
    ("reg_lambda", "float", 0.0, 2.0),
)
LEAF_SPACE = (
    ("n_estimators", "int", 500, 1200),
    ("max_depth", "int", 5, 12),
    ("learning_rate", "log", 0.005, 0.1),
    ("num_leaves", "int", 20, 100),
    ("subsample", "float", 0.7, 1.0),
    ("colsample_bytree", "float", 0.7, 1.0),
    ("min_child_samples", "int", 5, 100),
    ("reg_alpha", "float", 0.0, 2.0),
    ("reg_lambda", "float", 0.0, 2.0),
)
ORDERED_SPACE = (
    ("n_estimators", "int", 500, 1200),
    ("max_depth", "int", 5, 12),
    ("learning_rate", "log", 0.005, 0.1),
    ("reg_lambda", "float", 1.0, 10.0),
    ("subsample", "float", 0.7, 1.0),
    ("colsample_bylevel", "float", 0.7, 1.0),
)


@dataclass(frozen=True)
class Boost:
    """The nine searched parameters, the weight of positive rows, the bins and the seed."""

    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.3
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    scale_pos_weight: float = 1.0
    max_bin: int = 256
    seed: int = 42
    #: Leaves of a tree that grows leaf by leaf, where a `max_depth` of 0 sets no limit; 0: level by level.
    num_leaves: int = 0
    min_child_samples: int = 0
    #: The share of rows with the largest gradients that each tree sees, and the share of all rows drawn from the others.
    top_rate: float = 0.0
    other_rate: float = 0.0
    #: 1: one cut for each level, from a share of the columns drawn anew for each; a side may stay empty then.
    symmetric: int = 0
    colsample_bylevel: float = 1.0
    #: Segments of ordered boosting, each as large as all before it; 0: plain margins.
    segments: int = 0

    def __post_init__(self):
        if self.segments == 1 or not 0 <= self.segments <= 50:
            raise ValueError("segments must be 0 or between 2 and 50")
        if self.symmetric and self.num_leaves:
            raise ValueError("a tree grows either with one cut a level or by num_leaves")
        if self.colsample_bylevel < 1.0 and not self.symmetric:
            raise ValueError("columns are drawn by level for symmetric trees only")
        if self.num_leaves == 1 or self.num_leaves < 0:
            raise ValueError("num_leaves must be 0 or at least 2")
        if self.top_rate and (not 0 < self.top_rate < 1 or not 0 < self.other_rate <= 1 - self.top_rate):
            raise ValueError("top_rate and other_rate must be above 0 and at most 1 together")
        if self.top_rate and self.subsample < 1.0:
            raise ValueError("rows are drawn either evenly or by their gradients")

    @classmethod
    def of(cls, params: dict | None) -> Boost:
        known = {f.name: f.type for f in fields(cls)}
        unknown = set(params or {}) - set(known)
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**{k: int(v) if known[k] == "int" else float(v) for k, v in (params or {}).items()})


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has the feature -1. Rows with a bin below `bin` go to `left`, the others to `left` + 1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    #: In ordered boosting the values that each segment's rows see, one line a segment, and those of all rows last.
    by_segment: np.ndarray | None = None

    def split(self, node: int, feature: int, at: int, gain: float) -> int:
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, at, len(self.feature), gain
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.value, 0.0), (self.gain, 0.0), (self.cover, 0.0)):
            column += [empty, empty]
        return self.left[node]

    def packed(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.bin), np.array(self.left), np.array(self.value)

    def packed_for_fit(self) -> tuple[np.ndarray, ...]:
        return self.packed() if self.by_segment is None else (*self.packed()[:3], self.by_segment)


#: Up to so many features are compared for all rows of a level; beyond it each row looks up its own.
LEVEL_FEATURES = 12


def _levels(feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> list[tuple]:
    """A tree as steps of all rows at once: for each level (node after a step to the left, features with each node's cut, nodes).

    A node that does not ask for a feature has a cut beyond all bins; leaves stay where they are.
    """
    steps, nodes = [], np.flatnonzero(feature[:1] >= 0)
    while len(nodes):
        after = np.arange(len(feature))
        after[nodes] = left[nodes]
        asked = np.unique(feature[nodes])
        limits = None
        if len(asked) <= LEVEL_FEATURES:
            limits = []
            for f in asked:
                limit = np.full(len(feature), 256, dtype=np.int16)
                mine = nodes[feature[nodes] == f]
                limit[mine] = cut[mine]
                limits.append((int(f), limit))
        steps.append((after, limits, nodes))
        sides = np.concatenate([left[nodes], left[nodes] + 1])
        nodes = sides[feature[sides] >= 0]
    return steps


def walk(rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, steps: list[tuple] | None = None) -> np.ndarray:
    """The node that each row ends in; rows: one line for each feature, steps: the tree's `_levels`, if known."""
    at = np.zeros(rows.shape[1], dtype=np.int64)
    for depth, (after, limits, nodes) in enumerate(_levels(feature, cut, left) if steps is None else steps):
        if limits is None:
            asks = np.zeros(len(feature), dtype=bool)
            asks[nodes] = True
            open_ = np.flatnonzero(asks[at])
            node = at[open_]
            at[open_] = left[node] + (rows[feature[node], open_] >= cut[node])
            continue
        right = np.zeros(0)
        for i, (f, limit) in enumerate(limits):
            above = rows[f] >= (limit[0] if depth == 0 else limit.take(at))
            right = above if i == 0 else np.logical_or(right, above, out=right)
        at = after.take(at) if depth else np.full(len(at), after[0])
        at += right
    return at


def _draw(hashes: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row, from its hash."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)) / 2.0**53


@dataclass
class _Grown:
    """One model on the driver: its trees, and what the tree in hand is waiting for."""

    params: Boost
    n_features: int
    fold: int | None = None
    trees: list[Tree] = field(default_factory=list)
    kept: int = 0  # trees whose leaves the stored margins hold
    columns: list[int] = field(default_factory=list)
    open: dict[int, tuple[int, int] | None] = field(default_factory=dict)  # node -> its sums, None if not yet known
    floor: int = 0  # rows of this gradient cell or above it are seen whole by the tree in hand
    known: dict[int, np.ndarray] = field(default_factory=dict)  # node of the tree in hand -> its cells, where the driver searched them
    derived: dict[int, tuple[int, int]] = field(default_factory=dict)  # open node -> (parent, other side): its cells follow from theirs

    def begin(self) -> None:
        tree = len(self.trees)
        n = max(1, int(self.params.colsample_bytree * self.n_features))
        drawn = np.random.default_rng([self.params.seed, tree]).permutation(self.n_features)[:n]
        self.columns, self.open = sorted(drawn.tolist()), {0: None}
        self.known, self.derived = {}, {}
        self.trees.append(Tree())

    def derive(self, on_driver: bool) -> None:
        """Of two open sides of a split whose cells are known only the lighter one is added up; the sums are exact, so the other one is what is left."""
        self.derived = {}
        tree = self.trees[-1]
        for node in self.known if on_driver else ():
            left = tree.left[node]
            if tree.feature[node] >= 0 and left in self.open and left + 1 in self.open:
                heavy = left if self.open[left][1] > self.open[left + 1][1] else left + 1
                self.derived[heavy] = (node, 2 * left + 1 - heavy)

    def _score(self, g: int, h: int) -> float:
        soft = max(abs(g) / UNIT - self.params.reg_alpha, 0.0)
        return soft * soft / (h / UNIT + self.params.reg_lambda) if h else 0.0

    def value(self, g: int, h: int) -> float:
        p = self.params
        soft = max(abs(g) / UNIT - p.reg_alpha, 0.0)
        return float(-np.sign(g) * soft / (h / UNIT + p.reg_lambda) * p.learning_rate) if h else 0.0

    def close(self, node: int, sums: tuple[int, int] | None) -> None:
        g, h = sums or (0, 0)
        self.trees[-1].value[node], self.trees[-1].cover[node] = self.value(g, h), h / UNIT

    def order(self, sums: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Leaf values for each segment from the (leaf, segment) sums of all segments before it."""
        tree, n = self.trees[-1], self.params.segments
        tree.by_segment = np.zeros((n + 1, len(tree.feature)))
        for node, feature in enumerate(tree.feature):
            g = h = 0
            for segment in range(n if feature < 0 else 0):
                tree.by_segment[segment, node] = self.value(g, h)
                more = sums.get((node, segment), (0, 0))
                g, h = g + more[0], h + more[1]
            if feature < 0:
                tree.by_segment[n, node] = tree.value[node] = self.value(g, h)

    def take(self, found: dict[int, tuple]) -> None:
        """Split the open nodes by their best splits, close those that gain too little."""
        opened, tree = {}, self.trees[-1]
        for node, sums in self.open.items():
            best = found.get(node)
            if best is None:
                self.close(node, sums)
                continue
            g, h, gain, feature, at, gl, hl = best
            self.close(node, (g, h))
            if feature is not None and gain > LEAST_GAIN and gain >= self.params.gamma:
                left = tree.split(node, feature, at, gain)
                opened[left], opened[left + 1] = (gl, hl), (g - gl, h - hl)
        self.open = opened

    def full(self, depth: int) -> bool:
        return depth >= self.params.max_depth

    def finish(self) -> None:
        for node, sums in self.open.items():
            self.close(node, sums)
        self.open = {}

    def task(self, finished: bool = False) -> dict:
        """What a task must know: the trees that the margins lack, the tree in hand (if not finished), its open nodes."""
        p = self.params
        if finished:  # all its leaves are asked for
            return self.task() | {"trees": [t.packed_for_fit() for t in self.trees[self.kept : -1]], "hand": self.trees[-1].packed()}
        slots = np.full(len(self.trees[-1].feature) if self.open else 0, -1)
        asked = [node for node in self.open if node not in self.derived]
        slots[asked] = np.arange(len(asked))
        later = self.trees[self.kept : -1] if self.open else self.trees[self.kept :]
        return {
            "trees": [t.packed_for_fit() for t in later], "hand": self.trees[-1].packed() if self.open else None, "slots": slots, "nodes": asked,
            "columns": self.columns, "fold": self.fold, "subsample": p.subsample, "seed": p.seed, "tree": len(self.trees) - 1, "weight": p.scale_pos_weight,
            "segments": p.segments, "counted": p.min_child_samples > 0, "top": p.top_rate, "other": p.other_rate, "floor": self.floor,
        }


@dataclass
class _LeafGrown(_Grown):
    """A model whose trees split the leaf of the largest gain first.

    `best` holds the split of every node looked at that is worth one, `place`
    the nodes' numbers in a full binary tree, which order equal gains.
    """

    best: dict[int, tuple] = field(default_factory=dict)
    place: dict[int, int] = field(default_factory=dict)

    def begin(self) -> None:
        super().begin()
        self.best, self.place = {}, {0: 1}

    def full(self, depth: int) -> bool:
        return False

    def take(self, found: dict[int, tuple]) -> None:
        """Repeat the choice of leaves as far as their gains are known, then open the children of all that may follow."""
        p = self.params
        for node, sums in self.open.items():
            best = found.get(node)
            self.close(node, sums if best is None else best[:2])
            if best and best[3] is not None and best[2] > LEAST_GAIN and best[2] >= p.gamma:
                self.best[node] = best
        self.open = {}
        while not self.open:
            chosen, unknown = self._chosen()
            if not unknown:
                self.trees[-1] = _pruned(self.trees[-1], chosen)
                return
            for node in unknown:
                self._open_sides(node)

    def _chosen(self) -> tuple[set[int], list[int]]:
        """(the nodes split, those among them whose sides are unknown), as if unknown sides gained nothing.

        Unknown sides can only take the turn of others, so no node that is split in the end is missing.
        """
        tree, chosen, unknown = self.trees[-1], set(), []
        waiting = [self._turn(0)] if 0 in self.best else []
        while waiting and len(chosen) < self.params.num_leaves - 1:
            node = heapq.heappop(waiting)[2]
            chosen.add(node)
            if tree.feature[node] < 0:
                unknown.append(node)
                continue
            for child in (tree.left[node], tree.left[node] + 1):
                if child in self.best:
                    heapq.heappush(waiting, self._turn(child))
        return chosen, unknown

    def _turn(self, node: int) -> tuple[float, int, int]:
        return -self.best[node][2], self.place[node], node

    def _open_sides(self, node: int) -> None:
        g, h, gain, feature, at, gl, hl = self.best[node]
        left = self.trees[-1].split(node, feature, at, gain)
        for side, sums in ((left, (gl, hl)), (left + 1, (g - gl, h - hl))):
            self.place[side] = 2 * self.place[node] + side - left
            if self.place[side].bit_length() - 1 == self.params.max_depth:  # a leaf for certain
                self.close(side, sums)
            else:
                self.open[side] = sums


@dataclass
class _EvenGrown(_Grown):
    """A model whose nodes of a level share one cut; a node that it does not part gets an empty side."""

    depth: int = 0

    def begin(self) -> None:
        super().begin()
        self.whole, self.depth = self.columns, 0
        self._draw_columns()

    def _draw_columns(self) -> None:
        n = max(1, int(self.params.colsample_bylevel * len(self.whole)))
        if n < len(self.whole):
            drawn = np.random.default_rng([self.params.seed, len(self.trees) - 1, self.depth]).permutation(self.whole)[:n]
            self.columns = sorted(drawn.tolist())

    def take(self, found: dict[int, tuple]) -> None:
        """`found` has the common cut, its gain in all nodes together and each node's own sums."""
        opened, tree = {}, self.trees[-1]
        for node, sums in self.open.items():
            best = found.get(node)
            self.close(node, sums if best is None else best[:2])
            if best and best[3] is not None and best[2] > LEAST_GAIN and best[2] >= self.params.gamma:
                g, h, gain, feature, at, gl, hl = best
                left = tree.split(node, feature, at, gain / len(found))
                opened[left], opened[left + 1] = (gl, hl), (g - gl, h - hl)
        self.open = opened
        self.depth += 1
        self._draw_columns()


def _pruned(tree: Tree, chosen: set[int]) -> Tree:
    """The tree with the chosen splits only."""
    out, at = Tree(), [(0, 0)]
    for old, new in at:
        out.value[new], out.cover[new] = tree.value[old], tree.cover[old]
        if old in chosen:
            left = out.split(new, tree.feature[old], tree.bin[old], tree.gain[old])
            at += [(tree.left[old], left), (tree.left[old] + 1, left + 1)]
    return out


def _grown(params: Boost, n_features: int, fold: int | None = None) -> _Grown:
    return (_LeafGrown if params.num_leaves else _EvenGrown if params.symmetric else _Grown)(params, n_features, fold)


_BLOCK = "n int, bins binary, y binary, w binary, fold binary, hash binary, margins binary"


def _schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


class _Block:
    """Rows as arrays, as they lie in one stored block."""

    def __init__(self, batch: pa.RecordBatch, i: int, n_models: int):
        def raw(k, dtype):
            return np.frombuffer(batch.column(k)[i].as_buffer(), dtype=dtype)

        self.n = batch.column(0)[i].as_py()
        self.bins = raw(1, np.uint8).reshape(-1, self.n)
        self.y, self.w, self.fold, self.hash = raw(2, np.uint8), raw(3, np.float64), raw(4, np.int32), raw(5, np.uint64)
        held = raw(6, np.float64)
        self.margins = held.reshape(n_models, self.n) if len(held) else np.zeros((n_models, self.n))

    def margin(self, i: int, model: dict, rows: np.ndarray | None = None) -> np.ndarray:
        """The margins of all rows, or of the given ones."""
        every = rows is None or len(rows) == self.n
        out, bins = (self.margins[i], self.bins) if every else (self.margins[i][rows], self.bins[:, rows] if model["trees"] else None)
        segment = _segment(self, model) if model["segments"] and model["trees"] else None
        segment = segment if segment is None or every else segment[rows]
        if "steps" not in model:  # once a task
            model["steps"] = [_levels(*t[:3]) for t in model["trees"]]
        for (feature, cut, left, value), steps in zip(model["trees"], model["steps"]):
            node = walk(bins, feature, cut, left, steps)
            out = out + (value[node] if segment is None else value[segment, node])
        return out


def _blocks_of(batches: Iterable[pa.RecordBatch], n_models: int) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch, i, n_models)


def _gradients(block: _Block, i: int, model: dict, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = block.y[rows]
    p = 1.0 / (1.0 + np.exp(-block.margin(i, model, rows)))
    w = block.w[rows] * np.where(y == 1, model["weight"], 1.0)
    return np.rint((p - y) * w * UNIT), np.maximum(np.rint(p * (1.0 - p) * w * UNIT), 1.0)


def _used(block: _Block, model: dict) -> np.ndarray:
    """The rows that the model learns from."""
    return block.fold != model["fold"] if model["fold"] is not None else np.ones(block.n, dtype=bool)


def _segment(block: _Block, model: dict) -> np.ndarray:
    """Each row's segment; rows that the model does not learn from see the values of all segments."""
    n = model["segments"]
    place = _draw(block.hash, model["seed"], 1_000_003)
    own = np.where(place > 0, np.maximum(n - 1 + np.frexp(place)[1], 0), 0)
    return np.where(_used(block, model), own, n)


def _leaf_sums(blocks: DataFrame, models: list[_Grown], at_work: list[_Grown]) -> None:
    """Give the trees just finished of ordered models their values by segment, from one row for each (model, leaf, segment)."""
    tasks = [m.task(finished=True) if m.params.segments and any(m is a for a in at_work) else None for m in models]
    ddl = "model int, node int, segment int, g long, h long"
    out = _schema(blocks.sparkSession, ddl)

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for block in _blocks_of(batches, len(tasks)):
            for i, model in enumerate(tasks):
                if model is None:
                    continue
                n, rows = model["segments"], np.flatnonzero(_used(block, model))
                size = len(model["hand"][0]) * n
                cell = (walk(block.bins, *model["hand"][:3]) * n + _segment(block, model).clip(max=n - 1))[rows]
                sums = held.setdefault(i, np.zeros((2, size), dtype=np.int64))
                for j, x in enumerate(_gradients(block, i, model, rows)):
                    sums[j] += np.bincount(cell, weights=x, minlength=size).astype(np.int64)
        for i, sums in held.items():
            cell = np.flatnonzero(sums[1])
            yield _record(out, model=np.full(len(cell), i, dtype=np.int32), node=(cell // tasks[i]["segments"]).astype(np.int32),
                          segment=(cell % tasks[i]["segments"]).astype(np.int32), g=sums[0][cell], h=sums[1][cell])

    found: dict[int, dict] = {}
    summed = blocks.mapInArrow(add, ddl).groupBy("model", "node", "segment").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    for r in summed.collect():  # at most leaves x segments a model
        found.setdefault(r.model, {})[r.node, r.segment] = (r.g, r.h)
    for i, m in enumerate(models):
        if tasks[i] is not None:
            m.order(found.get(i, {}))


def _size_cell(g: np.ndarray) -> np.ndarray:
    """The cell of a gradient's size: 32 cells from each power of two to the next."""
    part, power = np.frexp(np.abs(g))
    return np.where(g == 0, 0, (power + 1) * 32 + ((part - 0.5) * 64).astype(np.int64))


def _set_floors(blocks: DataFrame, models: list[_Grown]) -> None:
    """For models that draw rows by their gradients, the lowest cell of those that hold their top share, by one count."""
    tasks = [m.task() for m in models]
    ddl = "model int, cell int, n long"
    out = _schema(blocks.sparkSession, ddl)

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for block in _blocks_of(batches, len(tasks)):
            for i, model in enumerate(tasks):
                if model["top"] and model["nodes"]:
                    cells = np.bincount(_size_cell(_gradients(block, i, model, np.flatnonzero(_used(block, model)))[0]), minlength=1)
                    both = np.zeros(max(len(cells), len(held.get(i, cells))), dtype=np.int64)
                    both[: len(cells)] += cells
                    if i in held:
                        both[: len(held[i])] += held[i]
                    held[i] = both
        for i, n in held.items():
            cell = np.flatnonzero(n)
            yield _record(out, model=np.full(len(cell), i, dtype=np.int32), cell=cell.astype(np.int32), n=n[cell])

    counts: dict[int, dict[int, int]] = {}
    for r in blocks.mapInArrow(add, ddl).groupBy("model", "cell").agg(F.sum("n").alias("n")).collect():  # at most 64 x 32 a model
        counts.setdefault(r.model, {})[r.cell] = r.n
    for i, cells in counts.items():
        want, seen = models[i].params.top_rate * sum(cells.values()), 0
        for cell in sorted(cells, reverse=True):
            seen += cells[cell]
            models[i].floor = cell
            if seen >= want:
                break


def _cells(blocks: DataFrame, models: list[dict], n_bins: int) -> DataFrame:
    """(model, node, feature, bin, g, h, n): each task's sums over the rows of the open nodes; n is 0 where no model asks for it."""
    ddl = "model int, node int, feature int, bin int, g long, h long, n long"
    out = _schema(blocks.sparkSession, ddl)
    planes = 3 if any(m["counted"] for m in models) else 2

    def add(batches):
        held: dict[int, np.ndarray] = {}

        def sent():
            for i, sums in held.items():
                node, feature, cell = np.nonzero(sums[1])
                model = models[i]
                if len(node):
                    yield _record(
                        out, model=np.full(len(node), i, dtype=np.int32), node=np.array(model["nodes"], dtype=np.int32)[node],
                        feature=np.array(model["columns"], dtype=np.int32)[feature], bin=cell.astype(np.int32),
                        g=sums[0][node, feature, cell], h=sums[1][node, feature, cell],
                        n=sums[2][node, feature, cell] if planes == 3 else np.zeros(len(node), dtype=np.int64))
            held.clear()

        for block in _blocks_of(batches, len(models)):
            for i, model in enumerate(models):
                if not model["nodes"]:
                    continue
                if "hand_steps" not in model:  # once a task
                    model["hand_steps"] = _levels(*model["hand"][:3])
                slot = model["slots"].take(walk(block.bins, *model["hand"][:3], model["hand_steps"]))
                use = (slot >= 0) & _used(block, model)
                if model["subsample"] < 1.0:
                    use &= _draw(block.hash, model["seed"], model["tree"]) < model["subsample"]
                rows = np.flatnonzero(use)
                if not len(rows):
                    continue
                g, h = _gradients(block, i, model, rows)
                if model["top"]:
                    large = _size_cell(g) >= model["floor"]
                    part = model["other"] / (1.0 - model["top"])
                    stays = large | (_draw(block.hash[rows], model["seed"], model["tree"]) < part)
                    g, h = (np.where(large, x, np.rint(x / part))[stays] for x in (g, h))
                    rows = rows[stays]
                shape = (len(model["nodes"]), len(model["columns"]), n_bins)
                if i not in held:
                    if sum(s.size for s in held.values()) > CELLS_AT_ONCE:
                        yield from sent()
                    held[i] = np.zeros((planes, *shape), dtype=np.int64)
                first = slot[rows] * n_bins
                for k, f in enumerate(model["columns"]):
                    place = first + block.bins[f][rows]
                    for j, x in enumerate((g, h, None)[:planes]):  # sums of whole numbers below 2^53 are exact
                        held[i][j, :, k] += np.bincount(place, weights=x, minlength=shape[0] * n_bins).astype(np.int64).reshape(shape[0], n_bins)
        yield from sent()

    return blocks.mapInArrow(add, ddl)


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def _best_here(sums: pa.Table, models: list[_Grown], n_bins: int) -> dict[int, dict[int, tuple]]:
    """The same as `_best_splits`, for sums that are proven to fit the driver."""
    found: dict[int, dict[int, tuple]] = {}
    columns = [sums.column(c).to_numpy() for c in ("model", "node", "feature", "bin", "g", "h", "n")]
    for i, m in enumerate(models):
        mine = columns[0] == i
        if not mine.any() and not m.derived:
            continue
        node, feature, at, g, h, n = (c[mine] for c in columns[1:])
        p, nodes = m.params, np.array(list(m.open))
        slots = np.zeros(nodes.max() + 1, dtype=np.int64)
        slots[nodes] = np.arange(len(nodes))
        place = np.zeros(max(m.columns) + 1, dtype=np.int64)
        place[m.columns] = np.arange(len(m.columns))
        dense = np.zeros((3, len(nodes), len(m.columns), n_bins), dtype=np.int64)
        dense[0][slots[node], place[feature], at] = g
        dense[1][slots[node], place[feature], at] = h
        dense[2][slots[node], place[feature], at] = n
        for heavy, (parent, other) in m.derived.items():
            dense[:, slots[heavy]] = m.known[parent] - dense[:, slots[other]]
        m.known = {node: dense[:, slots[node]] for node in m.open} if m.params.colsample_bylevel >= 1.0 else {}
        left = np.cumsum(dense, axis=3) - dense
        whole = dense.sum(axis=3, keepdims=True)

        def score(g, h, p=p):
            soft = np.maximum(np.abs(g) / UNIT - p.reg_alpha, 0.0)
            return soft * soft / (h / UNIT + p.reg_lambda)

        right = whole - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = score(*left[:2]) + score(*right[:2]) - score(*whole[:2])
        fits = (left[2] >= p.min_child_samples) & (right[2] >= p.min_child_samples)
        fits &= (dense[1] > 0) & (left[1] > 0) & (left[1] / UNIT >= p.min_child_weight) & (right[1] / UNIT >= p.min_child_weight)
        if p.symmetric:
            total = np.where(fits, np.rint(gain * GAIN_UNIT), 0.0).astype(np.int64).sum(axis=0).reshape(-1)
            gain = np.broadcast_to(total / GAIN_UNIT, (len(nodes), total.size))
        else:
            gain = np.where(fits, gain, -1.0).reshape(len(nodes), -1)
        best = gain.argmax(axis=1)  # the first of equals
        for s, k in enumerate(best.tolist()):
            f, b = divmod(k, n_bins)
            g0, h0 = (int(x) for x in whole[:2, s, 0, 0])
            if h0:
                top = float(gain[s, k])
                gl, hl = (int(x) for x in left[:2, s, f, b])
                found.setdefault(i, {})[int(nodes[s])] = (g0, h0, top, m.columns[f] if top >= 0 else None, b, gl, hl)
    return found


def _splits(cells: DataFrame, models: list[_Grown]) -> DataFrame:
    """(model, node, g, h, feature, bin, gl, hl, gain, fits, last): all splits between bins that hold rows; `last` is the bin before."""
    def of(name: str) -> Column:
        return F.array(*[F.lit(float(getattr(m.params, name))) for m in models])[F.col("model")]

    keys = ["model", "node", "feature"]
    summed = _summed(cells.repartition(*keys))  # dealt out by three keys, so that neither the sums nor the running sums shuffle again
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rows = summed.select(
        *keys, "bin", F.lag("bin").over(whole.orderBy("bin")).alias("last"), F.sum("g").over(before).alias("gl"), F.sum("h").over(before).alias("hl"), F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h"),
        F.sum("n").over(before).alias("nl"), F.sum("n").over(whole).alias("n"))
    rows = rows.withColumns({"fewest": of("min_child_samples"), "alpha": of("reg_alpha"), "lambda": of("reg_lambda"), "least": of("min_child_weight")})

    def score(g: Column, h: Column) -> Column:
        soft = F.greatest(F.abs(g) / F.lit(UNIT) - F.col("alpha"), F.lit(0.0))
        return soft * soft / (h / F.lit(UNIT) + F.col("lambda"))

    g, h, gl, hl = (F.col(c) for c in ("g", "h", "gl", "hl"))
    fits = gl.isNotNull() & (F.col("nl") >= F.col("fewest")) & (F.col("n") - F.col("nl") >= F.col("fewest")) & (hl / UNIT >= F.col("least")) & ((h - hl) / UNIT >= F.col("least"))
    gain = F.when(fits, score(gl, hl) + score(g - gl, h - hl) - score(g, h)).otherwise(F.lit(-1.0))
    return rows.select("model", "node", "g", "h", "feature", "bin", "gl", "hl", gain.alias("gain"), fits.alias("fits"), "last")


def _best_splits(cells: DataFrame, models: list[_Grown]) -> DataFrame:
    """(model, node, g, h, gain, feature, bin, gl, hl): the best split of each open node, the first feature and bin of equals."""
    found = _splits(cells, models)
    best = F.max_by(F.struct("gain", "feature", "bin", "gl", "hl"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return found.groupBy("model", "node").agg(F.first("g").alias("g"), F.first("h").alias("h"), best.alias("best")).select("model", "node", "g", "h", "best.*")


def _best_common(cells: DataFrame, models: list[_Grown]) -> DataFrame:
    """The same for symmetric models: one cut for all open nodes of a model, `gain` being its sum over them.

    A cut counts in a node by what lies to its left there, also where the node holds no row of that very bin.
    """
    splits = _splits(cells, models)
    gain = F.when(F.col("fits"), F.rint(F.col("gain") * GAIN_UNIT)).otherwise(0.0).cast("long")
    first = F.coalesce(F.col("last") + 1, F.col("bin"))
    every = splits.select("model", "feature", F.explode(F.sequence(first, F.col("bin"))).alias("at"), gain.alias("gain"))
    total = every.groupBy("model", "feature", "at").agg(F.sum("gain").alias("gain"))
    cut = F.max_by(F.struct("gain", "feature", "at"), F.struct("gain", -F.col("feature"), -F.col("at")))
    best = F.broadcast(total.groupBy("model").agg(cut.alias("best")).select(
        F.col("model").alias("of"), F.col("best.gain").alias("gain"), F.col("best.feature").alias("cut"), F.col("best.at").alias("at")))  # one row a model
    mine = cells.join(best, (F.col("model") == F.col("of")) & (F.col("feature") == F.col("cut")))
    low = F.col("bin") < F.col("at")
    return mine.groupBy("model", "node", "feature", "at", "gain").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum(F.when(low, F.col("g")).otherwise(0)).alias("gl"), F.sum(F.when(low, F.col("h")).otherwise(0)).alias("hl"),
    ).select("model", "node", "g", "h", (F.col("gain") / GAIN_UNIT).alias("gain"), "feature", F.col("at").alias("bin"), "gl", "hl")


def _kept(blocks: DataFrame, models: list[_Grown]) -> DataFrame:
    """The blocks with margins that hold all finished trees."""
    tasks = [m.task() for m in models]
    out = _schema(blocks.sparkSession, _BLOCK)

    def add(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, len(tasks))
                margins = np.stack([block.margin(k, t) for k, t in enumerate(tasks)])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(6)), pa.array([margins.tobytes()], type=pa.binary())], schema=out)

    kept = materialise(blocks.mapInArrow(add, _BLOCK), "margins", GROUP_BLOCKS)
    for m in models:
        m.kept = len(m.trees)
    return kept


#: Session setting: bytes of a batch of blocks on its way to Python, of which a task holds some at a time.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _grow(blocks: DataFrame, models: list[_Grown], n_bins: int) -> DataFrame:
    """Grow all models, a tree of each at a time; returns the blocks with their final margins."""
    with _short_batches(blocks.sparkSession):
        return _grow_levels(blocks, models, n_bins)


def _grow_levels(blocks: DataFrame, models: list[_Grown], n_bins: int) -> DataFrame:
    for tree in range(max((m.params.n_estimators for m in models), default=0)):
        at_work = [m for m in models if tree < m.params.n_estimators]
        for m in at_work:
            m.begin()
        if any(m.params.top_rate for m in at_work):
            _set_floors(blocks, models)
        for depth in count():
            for m in at_work:
                if m.full(depth):
                    m.finish()
            if not any(m.open for m in at_work):
                break
            on_driver = sum(len(m.open) * len(m.columns) * n_bins for m in models) <= DRIVER_CELLS
            for m in models:
                m.derive(on_driver)
            cells = _cells(blocks, [m.task() for m in models], n_bins)
            if on_driver:
                found = _best_here(_summed(cells).toArrow(), models, n_bins)
            else:
                even = [i for i, m in enumerate(models) if m.params.symmetric]
                held = materialise(_summed(cells), "cells") if even else cells
                rows = _best_splits(held.where(~F.col("model").isin(even)) if even else held, models).collect() if len(even) < len(models) else []
                rows += _best_common(held.where(F.col("model").isin(even)), models).collect() if even else []
                found = {}
                for m in models:
                    m.known = {}
                for r in rows:  # one row per open node
                    found.setdefault(r.model, {})[r.node] = (r.g, r.h, r.gain, r.feature if r.gain >= 0 else None, r.bin, r.gl, r.hl)
            for i, m in enumerate(models):
                if m.open:
                    m.take(found.get(i, {}))
        for m in at_work:
            m.finish()
        if any(m.params.segments for m in at_work):
            _leaf_sums(blocks, models, at_work)
        later = [len(t.feature) for m in models for t in m.trees[m.kept :]]
        if max(len(m.trees) - m.kept for m in models) >= (KEEP_FEW if len(models) <= FEW_MODELS else KEEP_TREES) or sum(later) >= KEEP_NODES:
            blocks = _kept(blocks, models)
    return blocks if all(m.kept == len(m.trees) for m in models) else _kept(blocks, models)


def bin_cuts(df: DataFrame, features: list[str], max_bin: int = 256) -> list[list[float]]:
    """For each feature the rising values at which its bins begin, at most max_bin - 2.

    Quantiles of all rows. Nulls and NaN have a bin of their own below all others.
    """
    if not 3 <= max_bin <= 256:
        raise ValueError("max_bin must be between 3 and 256")
    numbers = df.select(*[F.nanvl(quoted(f).cast("double"), F.lit(None)).alias(f"x{i}") for i, f in enumerate(features)])
    probs = [j / (max_bin - 1) for j in range(1, max_bin - 1)]
    if numbers.count() > CUT_ROWS:
        found = many_quantiles(numbers, probs)
    else:
        row = numbers.agg(*[x for c in numbers.columns for x in (F.min(c), F.percentile(c, F.array(*map(F.lit, probs))))]).first()
        found = [(row[2 * i], row[2 * i + 1] or []) for i in range(len(features))]
    return [sorted({float(v) for v in values if v > low}) for low, values in found]


def _blocks(df: DataFrame, features: list[str], label: str, cuts: list[list[float]], weight: str | None, fold: str | None, key: str | None,
            n_models: int = 1) -> DataFrame:
    """The rows as binned blocks, written once. Rows without a label are refused by the caller's split, here they are left out."""
    ship(df.sparkSession)
    edges = [np.array(c) for c in cuts]
    out = _schema(df.sparkSession, _BLOCK)
    numbers = [quoted(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    drawn = F.xxhash64(quoted(key)) if key else F.xxhash64(*[quoted(f).cast("double") for f in features], quoted(label).cast("double"))
    rows = df.where(quoted(label).isNotNull()).select(
        (quoted(label).cast("double") == 1.0).cast("int").alias("y"), (quoted(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (quoted(fold).cast("int") if fold else F.lit(-1)).alias("fold"), drawn.alias("hash"), *numbers)

    most = max(1, BLOCK_BYTES // (8 * n_models))

    def pack(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                y, w, folds, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                bins = np.zeros((len(edges), batch.num_rows), dtype=np.uint8)
                for i, e in enumerate(edges):
                    x = batch.column(4 + i).to_numpy(zero_copy_only=False)  # nulls come as NaN
                    bins[i] = np.where(np.isnan(x), 0, np.searchsorted(e, x, side="right") + 1)
                yield _record(out, n=[batch.num_rows], bins=[bins.tobytes()], y=[y.astype(np.uint8).tobytes()], w=[w.astype(np.float64).tobytes()],
                              fold=[folds.astype(np.int32).tobytes()], hash=[hashes.astype(np.int64).view(np.uint64).tobytes()], margins=[b""])

    return materialise(rows.mapInArrow(pack, _BLOCK), "blocks", GROUP_BLOCKS)


class BoostedTrees:
    """A fitted model. `transform` adds `probability` to rows with a vector `features`, as MLlib's tree models do."""

    def __init__(self, features: list[str], cuts: list[list[float]], trees: list[Tree], params: Boost):
        self.features, self.cuts, self.trees, self.params = list(features), cuts, trees, params

    @property
    def numFeatures(self) -> int:  # noqa: N802  the name that MLlib's models have
        return len(self.features)

    def threshold(self, feature: int, at: int) -> float:
        """Rows with a value below it go left; minus infinity parts missing values from all others."""
        return self.cuts[feature][at - 2] if at >= 2 else float("-inf")

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """The mean gain of each feature's splits, as shares of their sum."""
        total, n = np.zeros(self.numFeatures), np.zeros(self.numFeatures)
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += gain
                    n[f] += 1
        mean = total / np.maximum(n, 1)
        return DenseVector(mean / mean.sum() if mean.sum() else mean)

    def chance(self, features: Column) -> Column:
        """The probability of the positive class for an array of doubles; evaluated in Arrow batches."""
        spark = SparkSession.active()
        ship(spark)
        shared = spark.sparkContext.broadcast(([np.array(c) for c in self.cuts], [t.packed() for t in self.trees]))  # the model

        @F.arrow_udf("double")
        def of(rows: pa.Array) -> pa.Array:
            edges, trees = shared.value
            x = np.asarray(rows.flatten()).astype(np.float64).reshape(len(rows), len(edges))
            bins = np.stack([np.where(np.isnan(x[:, i]), 0, np.searchsorted(e, x[:, i], side="right") + 1) for i, e in enumerate(edges)]).astype(np.uint8)
            margin = np.zeros(len(rows))
            for feature, cut, left, value in trees:
                margin += value[walk(bins, feature, cut, left)]
            return pa.array(1.0 / (1.0 + np.exp(-margin)))

        return of(F.transform(features, lambda v: F.coalesce(v, F.lit(float("nan")))))

    def transform(self, df: DataFrame) -> DataFrame:
        features = F.col("features")
        if isinstance(df.schema["features"].dataType, VectorUDT):
            features = vector_to_array(features)
        p = self.chance(features)
        return df.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p")))).drop("_p")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, position, bin, threshold, left, value, gain, cover); leaves have no feature."""
        rows = [
            (i, k, self.features[f] if f >= 0 else None, f if f >= 0 else None, t.bin[k], self.threshold(f, t.bin[k]) if f >= 0 else None,
             t.left[k] if f >= 0 else None, t.value[k], t.gain[k], t.cover[k])
            for i, t in enumerate(self.trees) for k, f in enumerate(t.feature)
        ]
        return local_frame(spark, rows, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        cuts = [(i, f, c) for i, (f, c) in enumerate(zip(self.features, self.cuts))]
        local_frame(spark, cuts, "position int, feature string, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cuts")
        params = [({k: float(v) for k, v in asdict(self.params).items()},)]
        local_frame(spark, [(list(p[0].items()),) for p in params], "params map<string,double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/boost")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        cuts = spark.read.parquet(f"{path}/cuts").orderBy("position").collect()
        params = Boost.of(spark.read.parquet(f"{path}/boost").first().params)
        trees = [Tree([], [], [], [], [], []) for _ in range(params.n_estimators)]
        for r in spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            t = trees[r.tree]
            for column, v in ((t.feature, -1 if r.position is None else r.position), (t.bin, r.bin), (t.left, r.left or 0), (t.value, r.value), (t.gain, r.gain), (t.cover, r.cover)):
                column.append(v)
        return cls([r.feature for r in cuts], [list(r.cuts) for r in cuts], trees, params)


NODES = "tree int, node int, feature string, position int, bin int, threshold double, left int, value double, gain double, cover double"


def fit_boosted(df: DataFrame, features: list[str], label: str, params: dict | Boost | None = None, weight: str | None = None,
                key: str | None = None, cuts: list[list[float]] | None = None) -> BoostedTrees:
    """Fit boosted trees on columns of numbers; the label is positive where it is 1.

    Rows with a null label are left out; null and NaN features go below all
    numbers. With `subsample` below 1 rows are drawn by the hash of `key`, or of
    all their values, so equal rows are drawn together then. An empty table
    gives trees of one leaf and the probability one half.
    """
    p = params if isinstance(params, Boost) else Boost.of(params)
    cuts = bin_cuts(df, features, p.max_bin) if cuts is None else cuts
    from . import boost_alone

    blocks, n_bins = _blocks(df, features, label, cuts, weight, None, key), max(len(c) for c in cuts) + 2
    if boost_alone.fits_a_task(blocks, [p], len(features)):
        return BoostedTrees(features, cuts, boost_alone.fit_trees(blocks, p, len(features), n_bins), p)
    model = _grown(p, len(features))
    _grow(blocks, [model], n_bins)
    return BoostedTrees(features, cuts, model.trees, p)


def cross_validate(df: DataFrame, features: list[str], label: str, fold: str, trials: list[dict | Boost], k: int = 5,
                   key: str | None = None, cuts: list[list[float]] | None = None) -> DataFrame:
    """(trial, fold, n, score): the accuracy of each trial's model on the rows of a fold, fitted on the other folds.

    All models of all trials grow in the same jobs, or each in a task of its own
    where the binned rows fit one (`boost_alone.py`); the scores are the same.
    """
    from . import boost_alone

    ps = [t if isinstance(t, Boost) else Boost.of(t) for t in trials]
    bins = {p.max_bin for p in ps}
    if len(bins) != 1:
        raise ValueError("trials of one call share max_bin")
    cuts = bin_cuts(df, features, bins.pop()) if cuts is None else cuts
    n_bins = max(len(c) for c in cuts) + 2
    blocks = _blocks(df, features, label, cuts, None, fold, key, len(ps) * k)
    if boost_alone.fits_a_task(blocks, ps, len(features)):
        told = boost_alone.fold_hits(blocks, [(p, f) for p in ps for f in range(k)], len(features), n_bins)
        rows = [(*divmod(i, k), n, hits / n if n else 0.0) for i, (n, hits) in enumerate(told)]
        return local_frame(df.sparkSession, rows, "trial int, fold int, n long, score double")
    models = [_grown(p, len(features), f) for p in ps for f in range(k)]
    blocks = _grow(blocks, models, n_bins)
    ddl = "trial int, fold int, n long, hits long"
    out = _schema(df.sparkSession, ddl)
    n_models = len(models)

    def judge(batches):
        n, hits = np.zeros(n_models, dtype=np.int64), np.zeros(n_models, dtype=np.int64)
        for block in _blocks_of(batches, n_models):
            for i in range(n_models):
                mine = block.fold == i % k
                n[i] += mine.sum()
                hits[i] += ((block.margins[i][mine] > 0) == (block.y[mine] == 1)).sum()
        yield _record(out, trial=np.arange(n_models) // k, fold=np.arange(n_models) % k, n=n, hits=hits)

    sums = blocks.mapInArrow(judge, ddl).groupBy("trial", "fold").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    with _short_batches(df.sparkSession):
        rows = [(r.trial, r.fold, r.n, r.hits / r.n if r.n else 0.0) for r in sums.orderBy("trial", "fold").collect()]  # one row per model
    return local_frame(df.sparkSession, rows, "trial int, fold int, n long, score double")


class BoostedClassifier:
    """`fit` on rows with a vector `features`, so that boosted trees can stand wherever an MLlib estimator does."""

    def __init__(self, label: str, params: dict | None = None, seed: int = 42):
        self.label, self.params = label, Boost.of({"seed": seed, **(params or {})})

    def fit(self, df: DataFrame) -> BoostedTrees:
        size = df.select("features").first()
        n = size.features.size if size else 0
        names = [f"f{i}" for i in range(n)]
        flat = df.select(quoted(self.label).alias("y"), vector_to_array("features").alias("v")).select("y", *[F.col("v")[i].alias(c) for i, c in enumerate(names)])
        return fit_boosted(materialise(flat, "flat"), names, "y", self.params)


__all__ = ["BOOST_SPACE", "LEAF_SPACE", "ORDERED_SPACE", "Boost", "BoostedClassifier", "BoostedTrees", "Tree", "bin_cuts", "cross_validate", "fit_boosted", "walk"]
