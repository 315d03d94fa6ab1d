"""Whole texts to token ids by a vocabulary file of the tokenizers library.

A text is cut at spaces where the vocabulary's pre-tokenizer always cuts too,
so the ids of the text are those of its units, one after the other. Units
repeat, so each worker lets the library encode a unit once and keeps the answer
in a cache of bounded size; a chunk's texts are cut and put together as arrays.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

from .common import give_back

CACHED_UNITS = 800_000
UNITS_AT_ONCE = 4096
CHARS_AT_ONCE = 4_000_000

_LOOSE = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")
# words of these letters are one pre-token each for every pre-tokenizer known to `cut_rule`
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PLAIN, _MARK = (np.isin(np.arange(256), np.frombuffer(b, dtype=np.uint8)) for b in (string.ascii_letters.encode(), b".,;:!?"))
#: Bytes that begin a character which is surely no white space; a space before any other one is not cut.
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = _VISIBLE[0xC3:0xE0] = _VISIBLE[0xE4:0xF5] = True


def cut_rule(spec: dict) -> str:
    """How texts may be cut for this tokenizer file.

    `joins`: a space that a visible character follows begins a pre-token and
    belongs to it (byte-level pattern). `parts`: spaces only separate
    pre-tokens and are dropped. `whole`: no cut is known to be safe.
    """
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return "joins"
    steps = pre.get("pretokenizers") or []
    if len(steps) != 2 or steps[1].get("type") != "ByteLevel" or steps[1].get("add_prefix_space"):
        return "whole"
    names = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    if (
        steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")
        and set(names) <= {"NFC", "Replace", "Lowercase"}
    ):
        return "parts"
    return "whole"


def spaced_units(text: str) -> list[str]:
    """The text cut before each space that a visible character follows; those spaces are left out."""
    return _CUT.split(text) if _LOOSE.search(text) else text.split(" ")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class UnitCache(dict):
    """unit -> ids as little-endian unsigned 32-bit integers; `encode` answers for many units."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHED_UNITS):
        super().__init__()
        self.encode, self.limit = encode, limit

    def missing(self, units: set[str]) -> list[str]:
        """The units without an answer; empties a cache that they would overfill."""
        found = [u for u in units if u not in self]
        if len(self) + len(found) > self.limit:
            self.clear()
            found = list(units)
        return found

    def prepare(self, units: set[str]) -> None:
        missing = self.missing(units)
        for i in range(0, len(missing), UNITS_AT_ONCE):
            part = missing[i : i + UNITS_AT_ONCE]
            self.update(zip(part, self.encode(part)))

    def joined(self, units: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, units))


class TextEncoder:
    """Ids of whole texts, as the library's `encode(text, add_special_tokens=False)`; null counts as empty.

    The texts of a chunk are cut as one byte array, and Arrow numbers its
    distinct units. Only those are looked up or encoded; the chunk's ids are
    then gathered by array indexing.
    """

    def __init__(self, path: str, kept_units: int = CACHED_UNITS, chars: int = CHARS_AT_ONCE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        self.rule = cut_rule(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        if any(" " in t for t in self.added):
            self.rule = "whole"
        self.symbols = byte_symbols()
        self.units = UnitCache(self._encode, kept_units)
        self.chars = chars

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        part, chars = [], 0
        for text in texts:
            part.append(text or "")
            chars += len(part[-1])
            if chars >= self.chars:
                yield from self._part(part)
                part, chars = [], 0
        yield from self._part(part)

    def _found(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units. A word of plain letters, perhaps after a space, is one pre-token: the library's model takes it in its byte symbols."""
        cache, rest = self.units, []
        found = list(map(cache.get, units))
        missing = [i for i, f in enumerate(found) if f is None]
        if len(cache) + len(missing) > cache.limit:  # what was found is at hand, so the older half may go
            for u in list(islice(cache, max(len(cache) // 2, len(cache) + len(missing) - cache.limit))):
                del cache[u]
        tokenize, symbol, lower, fits = self.library.model.tokenize, self.symbols.__getitem__, self.rule == "parts", _WORD.fullmatch
        for i in missing:
            u = units[i]
            if fits(u):
                word = u.lower() if lower else u
                text = word.replace(" ", "\u0120") if word.isascii() else "".join(map(symbol, word.encode()))
                found[i] = cache[u] = array("I", [t.id for t in tokenize(text)]).tobytes()
            else:
                rest.append(i)
        for k in range(0, len(rest), UNITS_AT_ONCE):
            part = rest[k : k + UNITS_AT_ONCE]
            for i, ids in zip(part, self._encode([units[i] for i in part])):
                found[i] = cache[units[i]] = ids
        return found

    def _cut(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, where units begin in them and the end, first unit of each text and the end) of texts that follow one another.

        Besides spaces, units end where letters meet marks and around a line
        break between them, where both kinds of pre-tokenizer cut as well.
        """
        n, space = len(data), data == 32
        after = np.zeros(n, dtype=np.uint8)
        after[1:] = data[:-1]
        latin = (after == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)  # a letter's second byte
        plain, mark, line = _PLAIN[data], _MARK[data], data == 10
        ends_word, begins_word = plain | latin, plain.copy()
        begins_word[:-1] |= latin[1:]
        visible = ends_word | mark
        begins = np.zeros(n, dtype=bool)
        begins[1:] = (ends_word[:-1] & (mark | line)[1:]) | (mark[:-1] & (begins_word | line)[1:])
        begins[2:] |= visible[:-2] & line[1:-1] & begins_word[2:]
        filled = starts[ends > starts]
        if self.rule == "joins":
            begins[:-1] |= space[:-1] & _VISIBLE[data[1:]]
            begins[filled[1:] - 1] &= ~space[filled[1:] - 1]  # nothing follows the last byte of a text
        else:
            begins[1:] |= space[:-1]
            begins &= ~space
        first = np.zeros(n, dtype=bool)
        first[filled] = True
        begins |= first if self.rule == "joins" else first & ~space
        at = np.flatnonzero(begins)
        unit = np.concatenate([np.searchsorted(at, starts), [len(at)]])
        if self.rule == "joins":
            return data, np.concatenate([at, [n]]), unit
        kept = ~space
        return data[kept], np.concatenate([np.cumsum(kept)[at] - 1, [int(kept.sum())]]), unit

    def _part(self, texts: list[str]) -> Iterator[bytes]:
        if self.rule == "whole":
            yield from (self._encode([t])[0] for t in texts)
            return
        # an added token cuts its text before the pattern does: such texts go to the library whole
        alone = {i: self._encode([t])[0] for i, t in enumerate(texts) if any(a in t for a in self.added)} if self.rule == "joins" else {}
        raw = [b"" if i in alone else t.encode() for i, t in enumerate(texts)]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        if not len(ends) or not ends[-1]:
            yield from (alone.get(i, b"") for i in range(len(texts)))
            return
        data, offsets, first = self._cut(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        units = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        found, which = self._found(units.dictionary.to_pylist()), units.indices.to_numpy()
        flat = id_array(b"".join(found))
        sizes = np.array([len(f) for f in found], dtype=np.int64) // 4
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begins[which] - upto[:-1], n) + np.arange(upto[-1])]
        for i, (a, b) in enumerate(zip(upto[first[:-1]].tolist(), upto[first[1:]].tolist())):
            yield alone[i] if i in alone else ids[a:b].tobytes()
        del raw, data, units, found, flat, which, ids, n, upto
        give_back()

    @property
    def n_ids(self) -> int:
        return max(self.library.get_vocab(with_added_tokens=True).values()) + 1


_HELD: dict[str, TextEncoder] = {}


def text_encoder(path: str, kept_units: int = CACHED_UNITS, chars: int = CHARS_AT_ONCE) -> TextEncoder:
    """The encoder of this worker for a vocabulary file; kept between tasks. Fewer units and characters at once take less memory and more time."""
    if path not in _HELD:
        _HELD[path] = TextEncoder(path, kept_units, chars)
    return _HELD[path]


def let_go(path: str) -> None:
    """Forget this worker's encoder of a file and give its memory back."""
    _HELD.pop(path, None)
    give_back()


def id_array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
