"""Language identification by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent letter n-grams over
all learning documents. A document gets the language whose profile has the
smallest out-of-place distance to the document's own ranking: the summed rank
differences, with the largest possible one for an n-gram that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import quoted
from ..plans.durable import materialise
from .common import arrow_of, give_back, renamed, ship, text_rows
from .tokens import batch_of

PROFILE = 400
UNKNOWN = "und"
CHUNK_CHARS = 250_000
EDGE = 32  # stands for a word's edge
DENSE = 1 << 22
BROADCAST_ROWS = 500_000
_BITS = 21  # of a code point

_known_letters: dict[int, bool] = {}


def _is_letter(code: int) -> bool:
    if code not in _known_letters:
        _known_letters[code] = chr(code).isalpha()
    return _known_letters[code]


class Chunk:
    """The letter 1- to 3-grams of some texts, as numbers over the chunk's own alphabet.

    Texts are lower-cased; a run of other characters is one word edge, and a
    text begins and ends with one. An n-gram has edges only at its ends. Numbers
    sort as (size, code points) do, so rankings do not depend on the chunk.
    """

    def __init__(self, texts: list[str]):
        parts = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
        begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)])
        whole = np.full(int(begins[-1]) + 1, EDGE, dtype=np.int64)
        for p, b in zip(parts, begins[:-1].tolist()):
            whole[b + 1 : b + 1 + len(p)] = p
        present = np.flatnonzero(np.bincount(whole, minlength=EDGE + 1))
        letters = np.array([c == EDGE or _is_letter(c) for c in present.tolist()])
        self.alphabet = present[letters]
        place = np.zeros(int(present[-1]) + 1, dtype=np.int64)  # anything else counts as an edge, number 0
        place[self.alphabet] = np.arange(len(self.alphabet))
        index = place[whole]
        keep = index > 0
        keep[1:] |= index[:-1] > 0
        keep[begins] = True
        self.begins = np.concatenate([[0], np.cumsum(keep)])[begins]
        index = index[keep]
        a = self.size = len(self.alphabet)
        n = len(index)
        self.grams = np.full((3, n), -1, dtype=np.int64 if a > 1200 else np.int32)
        edge = index == 0
        self.grams[0] = np.where(edge, -1, index)
        if n > 1:
            self.grams[1, : n - 1] = np.where(edge[:-1] & edge[1:], -1, a + index[:-1] * a + index[1:])
        if n > 2:
            self.grams[2, : n - 2] = np.where(edge[1:-1], -1, a + a * a + (index[:-2] * a + index[1:-1]) * a + index[2:])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams of the chunk, by `codes`, and their counts."""
        found = self.grams[self.grams >= 0]
        if self.size**3 + self.size**2 + self.size <= DENSE:
            n = np.bincount(found)
            numbers = np.flatnonzero(n)
            return self.codes(numbers), n[numbers]
        numbers, n = np.unique(found, return_counts=True)
        return self.codes(numbers), n

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """Numbers as chunk-independent codes: code points side by side, 21 bits each."""
        a, x = self.size, numbers.astype(np.int64)
        three, two = x >= a + a * a, (x >= a) & (x < a + a * a)
        x = x - np.where(three, a + a * a, np.where(two, a, 0))
        c = self.alphabet
        return np.where(
            three, c[x // (a * a) % a] << 2 * _BITS | c[x // a % a] << _BITS | c[x % a],
            np.where(two, c[x // a % a] << _BITS | c[x % a], c[x % a]),
        )

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """Codes as numbers of this chunk, -1 where a letter does not occur in it."""
        mask, a, c = (1 << _BITS) - 1, self.size, self.alphabet
        parts = [codes >> s & mask for s in (2 * _BITS, _BITS, 0)]
        at = [np.minimum(np.searchsorted(c, p), a - 1) for p in parts]
        missing = np.zeros(len(codes), dtype=bool)
        for p, i in zip(parts, at):
            missing |= (p > 0) & (c[i] != p)
        x, y, z = at
        n = np.where(parts[0] > 0, a + a * a + (x * a + y) * a + z, np.where(parts[1] > 0, a + y * a + z, z))
        return np.where(missing, -1, n)

    def rankings(self, most: int) -> Iterator[np.ndarray]:
        """The most frequent n-grams of each text, ties by number."""
        for a, b in zip(self.begins[:-1].tolist(), self.begins[1:].tolist()):
            own = self.grams[:, a:b].ravel()
            numbers, n = np.unique(own, return_counts=True)
            if len(numbers) and numbers[0] < 0:
                numbers, n = numbers[1:], n[1:]
            yield numbers[np.argsort(-n, kind="stable")[:most]]


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit_profiles(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", most: int = PROFILE) -> DataFrame:
    """(lang, rank, gram) of each language's most frequent n-grams over all rows with `learn` and a language."""
    ddl = "lang string, gram long, n long"
    out = arrow_of(ddl)

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(pairs):
            grams, at = np.unique(np.concatenate([g for g, _ in pairs]), return_inverse=True)
            return grams, np.bincount(at, weights=np.concatenate([n for _, n in pairs])).astype(np.int64)

        for batch in batches:
            by: dict[str, list[str | None]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for part in chunks(texts):  # merged one by one: a chunk's counts are far larger than their share of the whole
                    held[lang] = [merged([*held.get(lang, []), Chunk(part).counts()])]
            give_back()
        for lang, [(grams, n)] in held.items():
            yield batch_of(out, lang=[lang] * len(grams), gram=grams, n=n)

    ship(docs.sparkSession)
    rows = docs.where(learn & quoted(lang_col).isNotNull()).select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(run, ddl).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # filtered as row_number counts, so that Spark keeps `most` rows of a language in each task before it sorts the rest
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.select("lang", (F.col("rank") - 1).alias("rank"), "gram")


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = PROFILE) -> DataFrame:
    """(id, lang_pred, score) of every row.

    score is 1 minus the distance's share of the largest possible distance. A
    null text, one without a letter, and any text where no profile was learned
    are `und` with score 0. Ties go to the alphabetically first language. Rows
    that repeat give repeated rows. `profiles` holds `most` rows a language.
    """
    rows = profiles.orderBy("lang", "rank").collect()  # `most` rows for each language
    langs = sorted({r.lang for r in rows})
    grams = np.array(sorted({r.gram for r in rows}), dtype=np.int64)
    ranks = np.full((len(grams) + 1, len(langs)), -1, dtype=np.int64)  # the last row: in no profile
    for r in rows:
        ranks[np.searchsorted(grams, r.gram), langs.index(r.lang)] = r.rank
    ddl = "doc_id long, lang_pred string, score double"
    out = arrow_of(ddl)

    def run(batches):
        own = np.arange(most)[:, None]
        for batch in batches:
            best, score = [], []
            for part in chunks(batch.column(1).to_pylist()):
                chunk = Chunk(part)
                numbers = chunk.numbers(grams)
                order = np.argsort(numbers, kind="stable")
                sorted_numbers = numbers[order]
                for top in chunk.rankings(most):
                    if not len(top) or not langs:
                        best.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    at = np.minimum(np.searchsorted(sorted_numbers, top), len(numbers) - 1)
                    found = ranks[np.where(sorted_numbers[at] == top, order[at], len(grams))]
                    far = np.where(found < 0, most, np.abs(found - own[: len(top)])).sum(axis=0)
                    i = int(far.argmin())
                    best.append(langs[i])
                    score.append(1.0 - float(far[i]) / (most * len(top)))
            yield batch_of(out, doc_id=batch.column(0), lang_pred=best, score=score)
            give_back()

    return renamed(text_rows(docs, id_col, text_col).mapInArrow(run, ddl), id_col)


def keep_identified(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = PROFILE) -> DataFrame:
    """The rows whose text got a language, with all their columns; null texts and texts without a letter go."""
    keyed = docs.withColumn("_row_key", F.xxhash64(quoted(id_col), quoted(text_col)))
    found = identify(keyed, profiles, "_row_key", text_col, most)
    rejected = materialise(found.where(F.col("lang_pred") == UNKNOWN).select("_row_key").distinct(), "rejected")
    small = rejected.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(rejected) if small else rejected, "_row_key", "left_anti").select(*[quoted(c) for c in docs.columns])
