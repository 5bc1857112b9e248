"""Word hashing over Arrow string buffers, many texts at a time.

A batch of texts is one flat byte array with offsets, so words are found and hashed without a Python loop over words.
A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased; no other byte of UTF-8 text is touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 5)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time; a longer text is one piece of its own.
PIECE = 1 << 20
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE)
        inverse = np.uint64(pow(int(_ROOT), -1, 2**64))
        _powers[:] = []
        for base in (_ROOT, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string array; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``size`` bytes, or one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more entry than texts).

    ``parts`` tells the bytes between words.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    text = data[base:end]
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~parts[text]
    marks = (offsets - base).astype(np.int64)
    before = np.empty(len(text), bool)
    before[0], before[1:] = False, solid[:-1]
    edge = marks[:-1][marks[:-1] < len(text)]
    before[edge] = False
    starts = np.flatnonzero(solid & ~before)
    follows = np.zeros(len(text), bool)
    follows[:-1] = solid[1:]
    follows[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(solid & ~follows) + 1
    power, inverse = _tables(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTES[text] * power[: len(text)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, marks)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; the last n - 1 words begin none."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + count]
    return mix(out)
