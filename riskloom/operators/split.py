"""Seeded stratified splitting. Neither operator shuffles its input."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.draws import digest, unit
from ..plans.ranking import class_counts, hash_cutoffs, slot_by_cutoff


def class_quotas(counts: list[tuple], share: float) -> list[tuple]:
    """(label, rows of the test part): ceil(share * n) in total, by largest remainder."""
    n = sum(c for _, c in counts)
    total = math.ceil(share * n)
    base = [(g, c, c * total // n, c * total % n) for g, c in counts]
    extra = total - sum(b for _, _, b, _ in base)
    order = sorted(range(len(base)), key=lambda i: (-base[i][3], i))
    lift = set(order[:extra])
    return [(g, b + (1 if i in lift else 0)) for i, (g, _, b, _) in enumerate(base)]


def stratified_split(
    df: DataFrame, label: str, key: str, test: float = 0.4, seed: int = 42, exact: bool = True, out: str = "is_test"
) -> DataFrame:
    """Flag the test rows: in each class the first rows in md5 order of the unique `key`.

    exact=True gives exact sizes through one cutoff per class; exact=False
    compares the hash with the share and needs no pass over the data.
    """
    if not exact:
        return df.withColumn(out, unit(digest(seed, F.col(key)), 1) < F.lit(test))
    counts = class_counts(df, label)
    if not counts:
        return df.withColumn(out, F.lit(False))
    few = [g for g, c in counts if c < 2]
    if few:
        raise ValueError(f"classes with a single row cannot be split: {few[:5]}")
    quotas = class_quotas(counts, test)
    # a row is in the test part if it lies before the first row of the train part
    wanted = [(g, 0, q) for g, q in quotas if q > 0]
    none = [g for g, q in quotas if q == 0]
    cutoffs = hash_cutoffs(df, label, key, wanted, seed, max(c for _, c in counts))
    flagged = slot_by_cutoff(df, label, key, cutoffs, 1, seed, "_after")
    is_test = F.col("_after") == 0
    for g in none:
        is_test = is_test & ~F.col(label).eqNullSafe(F.lit(g))
    return flagged.select(*df.columns, is_test.alias(out))


def fold_sizes(counts: list[tuple], k: int) -> list[tuple]:
    """(label, [rows per fold]): classes are dealt to folds in turn, one after the other."""
    out, start = [], 0
    for g, c in counts:
        out.append((g, [(c - ((f - start) % k) + k - 1) // k for f in range(k)]))
        start = (start + c) % k
    return out


def assign_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1 per row; class shares and fold sizes differ by at most one row."""
    counts = class_counts(df, label)
    small = [g for g, c in counts if c < k]
    if small:
        raise ValueError(f"classes with fewer than {k} rows: {small[:5]}")
    wanted = []
    for g, sizes in fold_sizes(counts, k):
        upto = 0
        for f in range(k - 1):
            upto += sizes[f]
            wanted.append((g, f, upto))
    if not wanted:
        return df.withColumn(out, F.lit(0))
    cutoffs = hash_cutoffs(df, label, key, wanted, seed, max(c for _, c in counts))
    return slot_by_cutoff(df, label, key, cutoffs, k - 1, seed, out)
