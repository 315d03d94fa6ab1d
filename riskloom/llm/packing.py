"""Packing token sequences by minimum bin slack.

A document's ids are cut into full windows and a remainder. For each window the
longest remaining length is taken, and a bitset subset-sum over the multiset of
remaining lengths finds the total closest to the free room; backtracking gives
how often each length is used, and the same filling is repeated as long as the
counts allow. Documents are dealt by a hash into groups of bounded size, which
are packed independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.durable import materialise
from .common import arrow_of, renamed, text_rows
from .tokens import CACHED_UNITS, CHARS_AT_ONCE, batch_of, id_array, let_go, text_encoder

WINDOW = 4096
GROUP_PIECES = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def best_filling(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, times) of a multiset of the counted lengths whose total is closest to `room`, not above it."""
    if room <= 0:
        return []
    if counts[room]:
        return [(room, 1)]
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in np.flatnonzero(counts[:room])[::-1].tolist():
        left, times = min(int(counts[length]), room // length), 1
        while left:
            times = min(times, left)  # 1, 2, 4, ... and the rest: any count up to all of them
            steps.append((length, times, reach))
            reach = (reach | reach << length * times) & mask
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + times
            total -= length * times
    return list(used.items())


def fillings(lengths: np.ndarray, window: int) -> Iterator[list[int]]:
    """Windows as lists of lengths; every given length is used exactly once."""
    counts = np.bincount(lengths, minlength=window + 1)
    longest = window
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return
        counts[longest] -= 1
        filling = [(longest, 1), *best_filling(counts, window - longest)]
        counts[longest] += 1
        need: dict[int, int] = {}
        for length, times in filling:
            need[length] = need.get(length, 0) + times
        repeats = min(int(counts[length]) // times for length, times in need.items())
        for length, times in need.items():
            counts[length] -= times * repeats
        one = [length for length, times in need.items() for _ in range(times)]
        for _ in range(repeats):
            yield one


def pieces_of(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
              kept_units: int = CACHED_UNITS, chars: int = CHARS_AT_ONCE, hold: bool = True) -> DataFrame:
    """Each document's ids with the end id, cut at multiples of the window: one row per piece.

    Workers keep their encoder for the next task, or with `hold=False` let it go after each.
    """
    out = arrow_of(PIECES)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder = text_encoder(path, kept_units, chars)
        for batch in batches:
            cols: dict[str, list] = {f.name: [] for f in out}
            for doc, raw in zip(batch.column(0).to_pylist(), coder(batch.column(1).to_pylist())):
                raw += end
                n = len(raw) // 4
                for start in range(0, n, window):
                    piece = raw[4 * start : 4 * (start + window)]
                    for name, v in zip(cols, (doc, start, len(piece) // 4, zlib.crc32(piece), n)):
                        cols[name].append(v)
            yield batch_of(out, **cols)
        if not hold:
            del coder
            let_go(path)

    return text_rows(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, group_pieces: int = GROUP_PIECES,
         id_col: str = "doc_id", text_col: str = "text", kept_units: int = CACHED_UNITS, chars: int = CHARS_AT_ONCE,
         hold: bool = True) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is the end id alone. Rows that repeat are packed each
    for itself; a null id is kept. An empty table gives an empty one.
    `group_pieces` bounds what one task packs; only lengths travel, never ids.
    `kept_units` and `chars` bound a worker's memory while it tokenises, `hold=False` what it keeps.
    """
    pieces = materialise(pieces_of(docs, path, end_id, window, id_col, text_col, kept_units, chars, hold), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ignore_index=True)
        lengths = rows["length"].to_numpy()
        after = np.searchsorted(lengths, np.arange(window + 2), side="left")  # the next unused row of each length
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for number, filling in enumerate(fillings(lengths, window)):
            at = 0
            for length in filling:
                i = after[length]
                after[length] += 1
                sequence[i], offset[i] = number, at
                at += length
        group = int(rows["_group"].iloc[0])
        return rows.drop(columns="_group").assign(sequence_id=sequence * groups + group, offset=offset)

    keyed = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups)))
    packed = keyed.groupBy("_group").applyInPandas(pack_group, PIECES + ", sequence_id long, offset long")
    return renamed(packed, id_col)


def sequences(docs: DataFrame, pieces: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed ids themselves: (sequence_id, ids array<int>), pieces in the order of their offsets. Ids must be unique and not null."""
    end = np.array([end_id], dtype="<u4").tobytes()
    out = arrow_of("doc_id long, ids array<int>")

    def run(batches):
        coder = text_encoder(path)
        for batch in batches:
            ids = [id_array(raw + end).astype(np.int32) for raw in coder(batch.column(1).to_pylist())]
            yield batch_of(out, doc_id=batch.column(0), ids=ids)

    tokens = text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")
    cut = pieces.withColumnRenamed(id_col, "doc_id").join(tokens, "doc_id").select(
        "sequence_id", F.struct("offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")).alias("piece")
    )
    return cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list("piece")).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"))
