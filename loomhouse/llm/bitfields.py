"""Counters that stop at two, kept by many tasks and merged: which places of a field were noted once, and which twice or more.

A task sends the places that it has noted as sorted gaps, compressed: about two bytes each, whatever the size of the field. Merging adds
the tasks' counters, which in bits is: twice |= once & new, once |= new.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

NOTED = pa.schema([("part", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])
NOTED_SPARK = "part long, once binary, more binary"
FIELD_SPARK = "part long, twice binary"


def _packed(places: np.ndarray) -> bytes:
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int64)


def at(part: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A part of a field and a place in it, below 2^32, as one number."""
    return (part.astype(np.int64) << 32) | place.astype(np.int64)


def noted(places: list[np.ndarray]) -> pa.RecordBatch:
    """The counters of a task, or of a piece of its rows, by part: the places (``at``) that come once, and those that come more often."""
    all_, n = np.unique(np.concatenate(places), return_counts=True)
    part = all_ >> 32
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else part
    rows = []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(all_)], strict=False):
        here, many = all_[a:b] & 0xFFFFFFFF, n[a:b] > 1
        rows.append((int(part[a]), _packed(here[~many]), _packed(here[many])))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(NOTED)], schema=NOTED)


def _set(field: np.ndarray, places: np.ndarray) -> None:
    """Set bits, whose places ascend."""
    if len(places):
        byte = places >> 3
        new = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        field[byte[new]] |= np.bitwise_or.reduceat(np.uint8(1) << (places & 7).astype(np.uint8), new)


def are_set(field: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (field[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def merged(places: int):
    """For ``applyInArrow`` by part: the field of the places, below ``places``, that were noted twice or more."""

    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(places // 8 + 1, np.uint8), np.zeros(places // 8 + 1, np.uint8)
        for b in parts:
            for one, more in zip(b.column("once").to_pylist(), b.column("more").to_pylist(), strict=True):
                new = _unpacked(one)
                _set(twice, new[are_set(once, new)])
                _set(once, new)
                new = _unpacked(more)
                _set(twice, new)
                _set(once, new)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([twice.tobytes()], pa.binary())], names=["part", "twice"])

    return run
