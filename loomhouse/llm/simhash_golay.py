"""SimHash near-duplicates, linked by Golay-code keys.

A text's fingerprint has 64 bits, the majority of the hashes of its shingles. Two fingerprints that differ in three bits or fewer agree in
one of their four quarters; the other 48 bits, as two halves of 24, hold all the differences. If neither half has three of them, both halves
share a Golay index (``golay.nearby``), and the pair meets at a key of quarter and two indices; else the other half is equal, and the pair
meets at a key of quarter and half. Each key has 40 bits; a fingerprint has about 120 keys, fewer where a half lies close to a codeword.

Keys are sorted, and fingerprints under one key are verified by their distance. A key that more than ``CHUNK`` share goes out again
and is dealt to blocks of two chunks each, so that no task compares or holds it whole; inside a block only a spanning forest of the links is emitted, never
all pairs. Links become components by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomhouse.llm import golay
from loomhouse.llm import words as W
from loomhouse.llm.components import components
from loomhouse.llm.shared import broadcast_below, map_arrow, prepare, written

DISTANCE = 3
CHUNK = 1024


def fingerprints(w: W.Words, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' XXH64; a text of fewer words is one shingle; one without words is 0."""
    n = len(w.first) - 1
    data, start, end, _ = W.joined(w, np.arange(len(w.key)))
    count = np.diff(w.first)
    shingles = np.where(count > 0, np.maximum(1, count - shingle + 1), 0)
    first = np.repeat(w.first[:-1], shingles) + W.ragged(shingles)
    last = np.minimum(first + shingle - 1, np.repeat(w.first[1:] - 1, shingles))
    whole, of = data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((of(whole[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    out = np.zeros((n, 64), np.int64)
    owner = np.repeat(np.arange(n), shingles)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        mine = owner[at : at + len(bits)]
        new = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        out[mine[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    return np.packbits(2 * out > shingles[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprint(shingle: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in W.slices(b.column("text"), lower=True):
                yield pa.RecordBatch.from_arrays([*(b.column(x).slice(lo, hi - lo) for x in names), pa.array(fingerprints(w, shingle).view(np.int64))], names=[*names, "print"])

    return run


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of the fingerprint of each)."""
    keys, places = [], []
    quarters = [((prints >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    everyone = np.arange(len(prints))
    for k in range(4):
        a, b, c = (quarters[i] for i in range(4) if i != k)
        halves = (a << 8) | (b >> 8), ((b & 0xFF) << 16) | c
        (near_a, new_a), (near_b, new_b) = (golay.nearby(h & ((1 << golay.BITS) - 1)) for h in halves)
        n_a, n_b = new_a.sum(1), new_b.sum(1)
        flat_a, flat_b = near_a[new_a], near_b[new_b]
        nth, at = W.ragged(n_a * n_b), np.repeat(everyone, n_a * n_b)
        one = flat_a[(np.cumsum(n_a) - n_a)[at] + nth // n_b[at]]
        two = flat_b[(np.cumsum(n_b) - n_b)[at] + nth % n_b[at]]
        keys += [(k << 40) | (quarters[k][at] << 24) | (one << 12) | two, *(((4 + 2 * k + j) << 40) | (quarters[k] << 24) | h for j, h in enumerate(halves))]
        places += [at, everyone, everyone]
    return np.concatenate(keys), np.concatenate(places)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = b.column(0).to_numpy()
        for i in range(0, len(prints), 2048):
            keys, at = keys_of(prints[i : i + 2048].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[i : i + 2048][at])], names=["key", "print"])


def _forest(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest, found by growing one tree after the other."""
    left = np.arange(len(prints))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            by = np.zeros(len(left), np.int64)
            for some in np.array_split(front, -(-len(front) // 64)):
                d = np.bitwise_count(prints[some][:, None] ^ prints[left][None, :]) <= DISTANCE
                hit = d.any(0) & ~near
                by[hit] = some[d[:, hit].argmax(0)]
                near |= hit
            if near.any():
                yield by[near], left[near]
            front, left = left[near], left[~near]


def _under_one_key(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of links between fingerprints under one key; rows are sorted by key."""
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(new, len(keys)))
    ends = []
    for at, n in zip(new[size > 32], size[size > 32], strict=True):
        ends += [(prints[at + i], prints[at + j]) for i, j in _forest(prints[at : at + n])]
    few = np.repeat(size <= 32, size)
    keys, prints = keys[few], prints[few]
    at, step = np.arange(len(keys)), 0
    while len(at):
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= DISTANCE]
        ends.append((prints[near], prints[near + step]))
    return tuple(np.concatenate([e[k] for e in ends] or [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1))


def _link(most: int | None):
    """Rows (key, u, v): links, without a key; and the fingerprints u of each key that more than ``most`` share, for ``linked`` to deal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def out(keys: np.ndarray, prints: np.ndarray, hot: int | None) -> pa.RecordBatch:
            first, ends = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), []
            size = np.diff(np.append(first, len(keys)))
            large = np.repeat((size > most) | (keys[first] == hot) if most else np.zeros(len(size), bool), size)
            u, v = _under_one_key(keys[~large], prints[~large]) if not large.all() else (np.empty(0, np.int64),) * 2
            ends = [pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(keys[large])]), pa.concat_arrays([pa.array(u), pa.array(prints[large].view(np.int64))]), pa.concat_arrays([pa.array(v), pa.nulls(int(large.sum()), pa.int64())])]
            return pa.RecordBatch.from_arrays(ends, names=["key", "u", "v"])

        for b in batches:
            keys, prints = np.concatenate((held_keys, b.column(0).to_numpy())), np.concatenate((held, b.column(1).to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield out(keys[:cut], prints[:cut], hot)
            held_keys, held = keys[cut:], prints[cut:]
            if most and (len(held) > most or keys[-1] == hot):  # a hot key goes out as it comes, so that no task holds it whole
                hot = int(keys[-1])
                yield out(held_keys, held, hot)
                held_keys, held = held_keys[:0], held[:0]
        if len(held_keys):
            yield out(held_keys, held, hot)

    return run


def linked(prints: DataFrame) -> DataFrame:
    """(u, v): fingerprints at most three bits apart, enough of them to connect all that any chain of such links connects.

    ``prints`` is a written table of distinct fingerprints (print: long).
    """
    schema = "key long, u long, v long"
    keys = map_arrow(prints, _emit, "key long, print long")
    found = written(map_arrow(keys.repartition(F.col("key")).sortWithinPartitions("key"), _link(CHUNK), schema), "links")
    links = found.filter("key is null").select("u", "v")
    hot = found.filter("key is not null")
    if len(hot.limit(1).select("key").toArrow()):
        sizes = written(hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")).withColumnRenamed("key", "of"), "hot-keys")
        dealt = hot.join(broadcast_below(sizes, 100_000), F.col("key") == F.col("of")).withColumn("mine", F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int"))
        dealt = dealt.select("key", "u", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        blocks = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), F.col("u").alias("print"))
        links = links.unionAll(map_arrow(blocks.repartition(F.col("key")).sortWithinPartitions("key"), _link(None), schema).select("u", "v"))
    return links.distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without the text, with fingerprint, component_id, kept and text_hash (XXH64 of the text, null as empty).

    component_id is the smallest id that links reach, the row's own included; null ids count only where a component has no other. kept marks
    the row with that id (of several, that with the smallest text hash, and of rows equal in both one). Texts: A-Z in lower case; null and empty
    texts, and texts of white space, have fingerprint 0 and link like others. Columns named as new ones are replaced.
    """
    prepare(docs.sparkSession)
    new = ("fingerprint", "component_id", "kept", "text_hash")
    kept = [c for c in docs.columns if c not in (text_col, *new)]
    names = [*(f"c{i}" for i in range(len(kept))), "hash", "row"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(kept, names, strict=False)), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    rows = written(map_arrow(read, _fingerprint(shingle, names), ", ".join([*(f"{x} {types[c]}" for c, x in zip(kept, names, strict=False)), "hash long, row long, print long"])), "prints")
    ident = F.col(names[kept.index(id_col)])
    prints = written(rows.groupBy("print").agg(F.min(F.struct(ident.isNull().alias("none"), ident.alias("id"), F.col("hash").alias("hash"), F.col("row").alias("row"))).alias("first")), "distinct-prints")
    roots = components(linked(prints.select("print")))
    rooted = prints.join(roots, prints["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    of_print = rooted.join(least, "root").select("print", "least")
    return rows.join(of_print, "print").select(
        *(F.col(x).alias(c) for c, x in zip(kept, names, strict=False)),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("least.id").alias("component_id"),
        (F.col("row") == F.col("least.row")).alias("kept"),
        F.col("hash").alias("text_hash"),
    )
