"""Quality scores from document statistics.

Random Fourier features approximate a Gaussian kernel over the standardised
statistics of a text; ridge regression on them is fitted from normal equations
that are summed over partitions; isotonic regression turns its scores into
calibrated probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise
from .common import arrow_of, renamed, text_rows
from .tokens import batch_of

FEATURES = 200
RIDGE = 1e-3
WIDTH = 4.0
CELLS = 1000

_PUNCT = re.compile(r"[^\w\s]")
_BREAKS = re.compile(r"[.!?]")
STATISTICS = (
    "log_chars", "log_words", "mean_word", "sd_word", "distinct_words", "top_word", "letters", "digits", "capitals", "spaces",
    "punctuation", "symbols", "line_breaks", "mean_line", "distinct_lines", "ended_lines", "sentence_words", "repeated_pairs",
    "one_char_words", "long_words", "capital_words", "max_word", "non_ascii", "stops",
)


def statistics(text: str | None) -> list[float]:
    """The `STATISTICS` of a text; all 0 for a null or empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    words = text.split()
    w = max(1, len(words))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = codes[codes < 128]
    kinds = np.bincount(low, minlength=128)
    digits, upper, lower = kinds[48:58].sum(), kinds[65:91].sum(), kinds[97:123].sum()
    spaces, wide = kinds[[9, 10, 11, 12, 13, 32]].sum(), n - len(low)
    marks = kinds[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    symbols = len(low) - digits - upper - lower - spaces - marks
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    seen: dict[str, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n), np.log1p(len(words)), lengths.mean(), lengths.std(), len(seen) / w, max(seen.values(), default=0) / w,
        (upper + lower + wide) / n, digits / n, upper / n, spaces / n, marks / n, symbols / n, kinds[10] / n,
        np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        sum(x[-1] in ".!?\"'" for x in lines) / max(1, len(lines)), np.log1p(w / (1 + len(_BREAKS.findall(text)))),
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, (lengths == 1).mean(), (lengths > 12).mean(),
        sum(x[0].isupper() for x in words) / w, np.log1p(lengths.max()), wide / n, (kinds[46] + kinds[33] + kinds[63]) / w,
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps_x: np.ndarray
    steps_y: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cosines = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.steps_x, self.steps_y), 0.0, 1.0)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>): the statistics of every row."""
    ddl = "doc_id long, x array<double>"
    out = arrow_of(ddl)

    def run(batches):
        for batch in batches:
            yield batch_of(out, doc_id=batch.column(0), x=[[float(v) for v in statistics(t)] for t in batch.column(1).to_pylist()])

    return renamed(text_rows(docs, id_col, text_col).mapInArrow(run, ddl), id_col)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-decreasing means of y with weights n, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), n.tolist()):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + k]
    return np.concatenate([np.full(k, v) for v, _, k in blocks]) if blocks else np.zeros(0)


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(-1, len(STATISTICS))


def fit_quality(rows: DataFrame, x_col: str = "x", label_col: str = "label", features: int = FEATURES, ridge: float = RIDGE,
                width: float = WIDTH, seed: int = 11) -> QualityModel:
    """Fit on all rows with a label of 0 or 1. rows: statistics and label.

    Two passes of fixed-size sums (moments; normal equations), then one of
    calibration counts by score cell. Without labelled rows every score is 0.
    """
    k = len(STATISTICS)
    rows = rows.select(quoted(x_col).alias("x"), quoted(label_col).cast("double").alias("y")).where("y IS NOT NULL")
    moments = rows.select(*[F.col("x")[i].alias(f"v{i}") for i in range(k)]).agg(
        F.count(F.lit(1)), *[f(f"v{i}") for f in (F.avg, F.stddev_pop) for i in range(k)]
    ).first()
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(0.0, 1.0 / width, (k, features)), rng.uniform(0.0, 2 * np.pi, features)
    mean = np.array([v or 0.0 for v in moments[1 : k + 1]])
    scale = np.array([v if v and v > 1e-9 else 1.0 for v in moments[k + 1 :]])
    flat = QualityModel(mean, scale, directions, phases, np.zeros(features + 1), np.zeros(1), np.zeros(1))
    if not moments[0]:
        return flat

    upper = np.triu_indices(features + 2)
    ddl = "cell int, v double"
    out = arrow_of(ddl)

    def sums(batches):
        total = np.zeros((features + 2, features + 2))
        for batch in batches:
            z = np.hstack([flat.fourier(_matrix(batch.column(0))), np.array(batch.column(1))[:, None]])
            total += z.T @ z
        yield batch_of(out, cell=np.arange(len(upper[0])), v=total[upper])

    # (features + 2)^2 / 2 numbers
    cells = rows.mapInArrow(sums, ddl).groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    whole = np.zeros((features + 2, features + 2))
    whole[upper[0][cells["cell"]], upper[1][cells["cell"]]] = cells["v"]
    whole = whole + np.triu(whole, 1).T
    gram, right = whole[:-1, :-1], whole[:-1, -1]
    penalty = np.full(features + 1, ridge * moments[0] / features)
    penalty[-1] = 0.0
    weights = np.linalg.solve(gram + np.diag(penalty) + 1e-9 * moments[0] * np.eye(features + 1), right)
    linear = QualityModel(mean, scale, directions, phases, weights, np.zeros(1), np.zeros(1))

    ddl2 = "cell int, n double, y double"
    out2 = arrow_of(ddl2)

    def calibrate(batches):
        n, y = np.zeros(CELLS), np.zeros(CELLS)
        for batch in batches:
            at = np.clip(((linear.raw(_matrix(batch.column(0))) + 0.5) / 2.0 * CELLS).astype(int), 0, CELLS - 1)
            n += np.bincount(at, minlength=CELLS)
            y += np.bincount(at, weights=np.array(batch.column(1)), minlength=CELLS)
        used = np.flatnonzero(n)
        yield batch_of(out2, cell=used, n=n[used], y=y[used])

    steps = rows.mapInArrow(calibrate, ddl2).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas().sort_values("cell")
    n, y = steps["n"].to_numpy(), steps["y"].to_numpy()
    middle = (steps["cell"].to_numpy() + 0.5) / CELLS * 2.0 - 0.5
    return QualityModel(mean, scale, directions, phases, weights, middle, isotonic(y / n, n))


def score_quality(rows: DataFrame, model: QualityModel, id_col: str = "doc_id", x_col: str = "x") -> DataFrame:
    """(id, score, predicted) of rows of statistics."""
    ddl = "doc_id long, score double, predicted int"
    out = arrow_of(ddl)

    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column(1)))
            yield batch_of(out, doc_id=batch.column(0), score=s, predicted=(s >= 0.5).astype(np.int32))

    return renamed(rows.select(quoted(id_col).alias("doc_id"), quoted(x_col).alias("x")).mapInArrow(run, ddl), id_col)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Learns from labelled rows that are not held out; several labels of one id
    count as their mean, null labels not at all. Null and empty texts have all
    statistics 0 and are scored like any text. Rows that repeat give repeated
    rows; an empty table gives an empty one.
    """
    stats = materialise(with_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(quoted(id_col).alias(id_col), quoted(label_col).cast("double").alias("label")).groupBy(id_col).agg(F.avg("label").alias("label"))
    learn = materialise(stats.where(~held_out).join(known.where("label IS NOT NULL"), id_col).select("x", "label"), "learning")
    model = fit_quality(learn)
    scored = score_quality(stats, model, id_col)
    return scored.select(quoted(id_col), held_out.alias("held_out"), "score", "predicted")
