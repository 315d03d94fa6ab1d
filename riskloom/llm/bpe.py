"""Byte-pair encoding and decoding from a merge list.

A pre-token is a doubly linked list of symbols; a priority queue holds the
possible merges by rank, then by position. An entry whose symbols have changed
since it was queued is stale and skipped. Decoding concatenates the vocabulary
strings of the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_of, renamed, text_rows
from .tokens import CHARS_AT_ONCE, UnitCache, batch_of, byte_symbols, id_array, spaced_units

# Fixed value: the public pattern that cuts texts before byte-level merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_WORDS = 400_000


class MergeEncoder:
    """Encoder and decoder of a byte-level merge list."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        self.byte_ids = [vocab.get(s) for s in symbols]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in merges]
        # (left id, right id) -> (rank, merged id)
        self.merged = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.strings = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.decimal = {i: str(i) for i in self.strings}
        self.find_words = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = UnitCache(lambda words: [self._word(w) for w in words], CACHED_WORDS)
        self.heads = UnitCache(lambda units: self._units(units))
        self.rest = UnitCache(lambda units: self._units([" " + u for u in units]))

    def merge(self, ids: list[int]) -> list[int]:
        """The ids of one pre-token after all merges."""
        n, merged = len(ids), self.merged
        ids = list(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            if (found := merged.get((ids[i], ids[i + 1]))) is not None:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapify(queue)
        while queue:
            _, i, a, b, new = heappop(queue)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = new, -1
            after = right[i] = right[j]
            before = left[i]
            if after < n:
                left[after] = i
                if (found := merged.get((new, ids[after]))) is not None:
                    heappush(queue, (found[0], i, new, ids[after], found[1]))
            if before >= 0 and (found := merged.get((ids[before], new))) is not None:
                heappush(queue, (found[0], before, ids[before], new, found[1]))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        ids = self.merge([i for i in map(self.byte_ids.__getitem__, word.encode()) if i is not None])
        return struct.pack(f"<{len(ids)}I", *ids)

    def _units(self, units: list[str]) -> list[bytes]:
        rows = [self.find_words(u) for u in units]
        self.words.prepare(set().union(*rows))
        return [self.words.joined(r) for r in rows]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = [[(t, None)] if self.cut_added is None else [(p, self.added.get(p)) for p in self.cut_added.split(t)] for t in texts]
        rows = [[(spaced_units(p) if i is None else None, i) for p, i in row] for row in pieces]
        self.heads.prepare({u[0] for row in rows for u, i in row if i is None})
        self.rest.prepare(set().union(*(u[1:] for row in rows for u, i in row if i is None)))
        for row in rows:
            yield b"".join(self.heads[u[0]] + self.rest.joined(u[1:]) if i is None else struct.pack("<I", i) for u, i in row)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


_HELD: dict[str, MergeEncoder] = {}


def merge_encoder(path: str) -> MergeEncoder:
    if path not in _HELD:
        _HELD[path] = MergeEncoder(path)
    return _HELD[path]


def in_parts(texts: list[str | None]) -> Iterator[list[str]]:
    """Consecutive texts with a bounded number of characters together; null counts as empty."""
    part, chars = [], 0
    for text in texts:
        part.append(text or "")
        chars += len(part[-1])
        if chars >= CHARS_AT_ONCE:
            yield part
            part, chars = [], 0
    if part:
        yield part


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; a null or empty text gives an empty array."""
    out = arrow_of("doc_id long, ids array<int>")

    def run(batches):
        coder = merge_encoder(path)
        for batch in batches:
            ids = [id_array(raw).tolist() for part in in_parts(batch.column(1).to_pylist()) for raw in coder.encode(part)]
            yield batch_of(out, doc_id=batch.column(0), ids=ids)

    return renamed(text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>"), id_col)


def bpe_decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row; null ids give the empty text."""
    out = arrow_of("doc_id long, text string")

    def run(batches):
        coder = merge_encoder(path)
        for batch in batches:
            yield batch_of(out, doc_id=batch.column(0), text=[coder.decode(ids or []) for ids in batch.column(1).to_pylist()])

    rows = tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].cast("array<int>").alias("ids"))
    return renamed(rows.mapInArrow(run, "doc_id long, text string"), id_col)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again: (id, n_tokens, ids_sha256, decoded_sha256).

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the
    decoded text. Null and empty texts have no ids. Rows that repeat give
    repeated rows; an empty table gives an empty one. No row meets another, so
    nothing is shuffled and a lost task is just run again.
    """
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out: pa.Schema = arrow_of(ddl)

    def run(batches):
        coder = merge_encoder(path)
        for batch in batches:
            n, first, second = [], [], []
            for part in in_parts(batch.column(1).to_pylist()):
                for raw in coder.encode(part):
                    ids = id_array(raw).tolist()
                    n.append(len(ids))
                    first.append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest())
                    second.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield batch_of(out, doc_id=batch.column(0), n_tokens=n, ids_sha256=first, decoded_sha256=second)

    return renamed(text_rows(docs, id_col, text_col).mapInArrow(run, ddl), id_col)
