"""The perfect binary Golay code: every 23-bit word lies within three bits of exactly one of 4,096 codewords."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS = 23
#: Fixed value: the code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for k in range(BITS - 1, 10, -1):
        x ^= ((x >> k) & 1) * (GENERATOR << (k - 11))
    return x


@cache
def errors() -> np.ndarray:
    """The error pattern of up to three bits for each of 2,048 remainders."""
    patterns = np.array([sum(1 << i for i in c) for n in range(4) for c in combinations(range(BITS), n)], np.int64)
    out = np.empty(1 << 11, np.int64)
    out[_remainder(patterns)] = patterns
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    return (x ^ errors()[_remainder(x)]) >> 11


def nearby(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords that a word, or a word one bit from it, decodes to: (indices in rows of 24, whether first of their kind).

    A word has one or six distinct ones. Words at most two bits apart share one: that of a word one bit or less from both.
    """
    near = np.sort(np.stack([decode(x), *(decode(x ^ (1 << i)) for i in range(BITS))], 1), axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    return near, first
