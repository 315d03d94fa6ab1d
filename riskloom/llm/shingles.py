"""Word shingles of whole texts as 64-bit hashes, computed over byte arrays.

Words are the runs of bytes other than ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import give_back

WORDS = 5
#: Texts hashed together; the scratch arrays hold about 60 bytes for each of these bytes.
CHUNK_BYTES = 250_000

_rng = np.random.default_rng(20_240_611)
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A number of its own for each byte at each of a word's first places, capitals as their small letters.
_NEAR = 32
_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += np.uint64(32)
_KEY = np.uint64(_rng.integers(1 << 62, 1 << 63))
_powers: dict[str, np.ndarray] = {}


def _powers_of(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 2_000_000)
        grown = np.full(size, np.uint64(base), dtype=np.uint64)
        grown[0] = 1
        _powers[name] = have = np.multiply.accumulate(grown)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _at_place(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Random-like numbers for (place in the word, byte): no linear relation holds between them."""
    with np.errstate(over="ignore"):
        return mixed(mixed(place.astype(np.uint64) * np.uint64(256) + _FOLDED[byte] + _KEY) + _KEY)


_TABLE = _at_place(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256), _NEAR))


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[cuts[i]:cuts[i+1]], and the first word of each text (and the end).

    A word's hash is the mixed sum of its bytes' numbers (tabulation hashing).
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(cuts), dtype=np.int64)
    space = _SPACE[data]
    begins = ~space
    inside = cuts[(cuts > 0) & (cuts < n)]
    edge = np.zeros(n, dtype=bool)
    edge[inside] = True
    begins[1:] &= space[:-1] | edge[1:]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(cuts), dtype=np.int64)
    place = np.arange(n) - np.repeat(start, np.diff(np.concatenate([[0], start[1:], [n]])))  # below 0 before the first word
    number = _TABLE[np.clip(place, 0, _NEAR - 1) << 8 | data]
    far = np.flatnonzero((place >= _NEAR) & ~space)
    number[far] = _at_place(place[far], data[far])
    number[space] = 0
    return mixed(np.add.reduceat(number, start)), np.searchsorted(start, cuts)


def shingle_sets(texts: list[str | None], n_words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer words is one shingle as a whole; one without words, an
    empty or a null text has none.
    """
    part, size = [], 0
    for text in texts:
        part.append((text or "").encode())
        size += len(part[-1])
        if size >= CHUNK_BYTES:
            yield from _sets(part, n_words)
            part, size = [], 0
    yield from _sets(part, n_words)
    give_back()


def _sets(texts: list[bytes], n_words: int) -> Iterator[np.ndarray]:
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    words, first = word_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), cuts)
    last = max(0, len(words) - n_words + 1)
    rolled = np.zeros(last, dtype=np.uint64)
    for j in range(n_words):
        rolled += words[j : j + last] * _PLACE[j]
    rolled = mixed(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n_words:
            yield np.unique(rolled[a : b - n_words + 1])
        elif b > a:
            short = words[a:b] * _PLACE[: b - a]
            yield mixed(short.sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)
