"""Reproducible pseudo-random draws.

Every draw is a slice of md5(seed | key), so it does not depend on how the
rows are partitioned and is the same after a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def slice_to_long(h: Column, start: int, digits: int) -> Column:
    """`digits` hex digits (at most 15) of a digest, from 1-based `start`, as long.

    Never null, so joins and filters on a draw do not compute it twice.
    """
    return F.coalesce(F.conv(F.substring(h, start, digits), 16, 10).cast("long"), F.lit(0))


def unit(h: Column, start: int, digits: int = 13) -> Column:
    """Uniform draw in [0, 1)."""
    return slice_to_long(h, start, digits) / F.lit(float(16**digits))
