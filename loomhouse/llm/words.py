"""Words of whole texts as arrays: numpy scans Arrow's own buffers, so no Python object is made for a word.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 never uses these bytes inside a character. Each word gets a
64-bit key: a polynomial of its bytes modulo 2^64 (odd base), mixed with its length. The chance that any two of V words
share a key is about V^2 / 2^65, below one in a million for five million words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 17
SLICE = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
#: All ASCII but letters and digits parts words.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept and doubled as longer ones are asked for."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are those of text i; ``start`` and ``end`` are offsets in ``data``."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.empty(0, np.uint64)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))


def _cut(space: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where no word is cut."""
    if at >= len(space):
        return len(space)
    ahead = at
    while ahead < len(space):
        hit = np.flatnonzero(space[ahead : ahead + 4096])
        if len(hit):
            return ahead + int(hit[0])
        ahead += 4096
    return len(space)


def split(data: np.ndarray, bounds: np.ndarray, lower: bool = False, between: np.ndarray = _IS_SPACE) -> Words:
    """Words of the texts ``data[bounds[i]:bounds[i + 1]]``, ``bounds[0]`` being 0; keys are made in pieces of bounded size."""
    if lower:
        data = _LOWER[data]
    space = between[data]
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(space, out=word[1:-1])
    starts, ends = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    starts[inner] = word[1:-1][inner]
    ends[inner - 1] = word[1:-1][inner - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    keys, at = [], 0
    while at < len(data):
        to = _cut(space, at + PIECE)
        a, b = np.searchsorted(start, (at, to))
        keys.append(_keys(data[at:to], start[a:b] - at, end[a:b] - at))
        at = to
    return Words(data, bounds, start, end, np.concatenate(keys) if keys else np.empty(0, np.uint64), np.searchsorted(start, bounds))


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, bounds) of slices of a string column, a few MB each unless one text is longer. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, to, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def slices(column: pa.Array, lower: bool = False, between: np.ndarray = _IS_SPACE) -> Iterator[tuple[int, int, Words]]:
    for at, to, data, bounds in texts(column):
        yield at, to, split(data, bounds, lower, between)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def joined(w: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words whose places are in ``kept`` (ascending), each text's joined by one space: (bytes, starts, ends, end of each text)."""
    n = len(w.first) - 1
    owner = w.owner()[kept]
    more = np.append(owner[1:] == owner[:-1], False) if len(kept) else np.empty(0, bool)
    step = np.zeros(len(w.data) + 1, np.int8)
    step[w.start[kept]] += 1
    to = w.end[kept] + more
    np.subtract.at(step, to, 1)
    data = w.data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    length = to - w.start[kept]
    end = np.cumsum(length)
    return np.where(_IS_SPACE[data], np.uint8(32), data), end - length, end - more, np.cumsum(np.bincount(owner, length, n)).astype(np.int64)
