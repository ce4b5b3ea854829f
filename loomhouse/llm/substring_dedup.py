"""Passages that repeat across documents, found by a count-min prefilter and exact grouping.

A passage is a window of ``window`` consecutive words. Pass one counts, for each document, its windows' representatives: the least hash
among the word runs of half a window that the window holds. Equal windows have equal representatives, so the number of documents with a
window's representative is never below the number with the window. Every task keeps the counts in a count-min sketch of ``LINES`` lines of
counters that stop at two, one for every ``COUNTER_BYTES`` bytes of text; the tasks' sketches are added (``bitfields``), section by section.

Pass two emits the windows whose representative is estimated at two or more in all lines: none that repeats is lost. These alone are stored and grouped exactly,
by 96 bits of hash of their words' 64-bit keys, and each word under a window that also starts in a document with a smaller id is removed.

A sketch of ``max_sketch_bytes`` at most is broadcast, and texts are read once more. Beyond that size the documents' representatives are stored in folders by section, each section
is held against its own folder, and what it finds goes back to the documents by a join; so the texts are read as often at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomhouse.llm import bitfields
from loomhouse.llm import words as W
from loomhouse.llm.shared import map_arrow, new_path, prepare, written

LINES = 2
COUNTER_BYTES = 16
FLUSH = 1 << 20
_ONE, _TWO = np.uint64(0xC2B2AE3D27D4EB4F | 1), np.uint64(0x165667B19E3779F9 | 1)
_ALL = np.iinfo(np.int64).max


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def runs(key: np.ndarray, length: int, base: np.uint64, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of ``length`` words that start at each place, or at the places ``at``."""
    total = np.zeros(len(key) + 1, np.uint64)
    np.cumsum(key * W.powers(base, len(key)), out=total[1:])
    if at is None:
        at = np.arange(max(0, len(key) - length + 1))
    return W.mix((total[at + length] - total[at]) * W.powers(_inverse(base), len(key))[at])


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive numbers."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def windows(w: W.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows that lie in one text, their representatives)."""
    if len(w.key) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    half = window // 2
    least = least_of(runs(w.key, half, _ONE), window - half + 1)
    owner = w.owner()
    at = np.flatnonzero(owner[: len(least)] == owner[window - 1 :])
    return at, least[at]


class Shape:
    """The sketch's counters: ``sections`` parts of ``width`` counters in each line."""

    def __init__(self, text_bytes: int, most: int = 1 << 25):
        counters = max(1 << 16, text_bytes // COUNTER_BYTES)
        self.sections = -(-counters // most)
        self.width = -(-counters // self.sections)

    def section(self, x: np.ndarray) -> np.ndarray:
        return ((x >> np.uint64(32)) % np.uint64(self.sections)).astype(np.int64)

    def place(self, x: np.ndarray, line: int) -> np.ndarray:
        """The counter of each representative in a line of its section."""
        return (((W.mix(x + _TWO * np.uint64(line)) & np.uint64(0xFFFFFFFF)) * np.uint64(self.width)) >> np.uint64(32)).astype(np.int64)

    def repeated(self, x: np.ndarray, planes: dict[int, np.ndarray]) -> np.ndarray:
        """Whether all counters of each representative are at two; ``planes`` has the sections' lines."""
        found, of = np.zeros(len(x), bool), self.section(x)
        for s in np.unique(of):
            here = np.flatnonzero(of == s)
            for line in range(LINES):
                here = here[bitfields.are_set(planes[s * LINES + line], self.place(x[here], line))]
            found[here] = True
        return found


def _of_texts(w: W.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, representatives) of a slice: each text's representatives once."""
    at, least = windows(w, window)
    owner = w.owner()[at]
    if len(at):
        new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))))
        owner, least = owner[new], least[new]
        by = np.lexsort((least, owner))
        owner, least = owner[by], least[by]
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])))
        owner, least = owner[new], least[new]
    return owner, least


def _count(window: int, shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for _, _, w in W.slices(b.column("text")):
                _, x = _of_texts(w, window)
                held += [bitfields.at(shape.section(x) * LINES + line, shape.place(x, line)) for line in range(LINES)]
                size += len(x)
                if size >= FLUSH:
                    yield bitfields.noted(held)
                    held, size = [], 0
        if held:
            yield bitfields.noted(held)

    return run


def _representatives(window: int, shape: Shape, each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in W.slices(b.column("text")):
                owner, x = _of_texts(w, window)
                whose = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((shape.section(x) // each).astype(np.int32)), pa.array(x.view(np.int64)), *(b.column(k).slice(lo, hi - lo).take(whose) for k in ("id", "hash"))], names=["pass", "representative", "id", "hash"]
                )

    return run


def _repeated(shape: Shape, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array(np.flatnonzero(shape.repeated(b.column("representative").to_numpy().view(np.uint64), sent.value)))
            yield pa.RecordBatch.from_arrays([x.take(at) for x in b.columns], names=b.schema.names)

    return run


def _candidates(window: int, shape: Shape, sent):
    """Windows whose representative the sketch (broadcast, or as the list in the column ``asked``) has at two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in W.slices(b.column("text")):
                at, least = windows(w, window)
                if not len(at):
                    continue
                owner = w.owner()[at]
                new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))))
                if sent:
                    hit = shape.repeated(least[new], sent.value)
                else:
                    hit, lists = np.zeros(len(new), bool), b.column("asked").slice(lo, hi - lo)
                    for i, mine in enumerate(np.split(np.arange(len(new)), np.searchsorted(owner[new], np.arange(1, hi - lo)))):
                        hit[mine] = np.isin(least[new[mine]], lists[i].values.to_numpy().view(np.uint64))
                keep = np.repeat(hit, np.diff(np.append(new, len(least))))
                at, owner = at[keep], owner[keep]
                if not len(at):
                    continue
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(runs(w.key, window, _ONE, at).view(np.int64)),
                        pa.array((runs(w.key, window, _TWO, at) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        b.column("id").slice(lo, hi - lo).take(take),
                        b.column("hash").slice(lo, hi - lo).take(take),
                        pa.array((at - w.first[owner]).astype(np.int32)),
                    ],
                    names=["one", "two", "id", "hash", "at"],
                )

    return run


def _covers(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts of removed windows as the intervals that they cover: from, to, from, to, ..."""
        for b in batches:
            out = []
            for starts in b.column("starts"):
                x = np.sort(starts.values.to_numpy())
                new = np.flatnonzero(x[1:] > x[:-1] + window)
                out.append(np.stack((np.concatenate((x[:1], x[new + 1])), np.append(x[new], x[-1]) + window), 1).ravel())
            offsets = np.cumsum([0, *map(len, out)])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("hash"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(out).astype(np.int32)))], names=["id", "hash", "covers"]
            )

    return run


def without(w: W.Words, removed: np.ndarray) -> Iterator[memoryview]:
    """Each text's kept words, joined by one space."""
    data, _, _, ends = W.joined(w, np.flatnonzero(~removed))
    view, at = memoryview(data), 0
    for e in ends.tolist():
        yield view[at:e]
        at = e


def _rewrite(keep_text: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in W.slices(b.column("text")):
                step = np.zeros(len(w.key) + 1, np.int64)
                covers = b.column("covers").slice(lo, hi - lo)
                for i in np.flatnonzero(covers.is_valid().to_numpy(zero_copy_only=False)):
                    x = covers[i].values.to_numpy() + w.first[i]
                    step[x[::2]] += 1
                    step[x[1::2]] -= 1
                removed = np.cumsum(step[:-1]) > 0
                texts = [*without(w, removed)]
                owner = w.owner()
                columns = [
                    pa.array(np.diff(w.first).astype(np.int64)),
                    pa.array(np.bincount(owner[removed], minlength=hi - lo).astype(np.int64)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                    pa.array([bytes(x).decode() if keep_text else None for x in texts], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(b.column(x).slice(lo, hi - lo) for x in names), *columns], names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep_text: bool = True, max_sketch_bytes: int = 64 << 20, section_counters: int = 1 << 25, max_broadcast_intervals: int = 1_000_000
) -> DataFrame:
    """``docs`` without the text, with n_words, n_removed, kept_sha256 and (if ``keep_text``) kept_text.

    Words: ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none. A word goes if a window over it also starts in a document with a
    smaller id; a null id counts as the largest. Rows with the same id don't take words from each other. Texts of fewer words than the window
    stay whole. All windows are judged on the input. Columns named as new ones are replaced; others stay.
    """
    spark = prepare(docs.sparkSession)
    new = ("n_words", "n_removed", "kept_sha256", "kept_text")
    kept = [c for c in docs.columns if c != text_col and c not in new]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_ALL)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")
    )
    shape = Shape(keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0, section_counters)
    sketches = map_arrow(keyed.select("text"), _count(window, shape), bitfields.NOTED_SPARK)
    merged = written(sketches.groupBy("part").applyInArrow(bitfields.merged(shape.width), bitfields.FIELD_SPARK), "sketch")
    each = max(1, max_sketch_bytes // (LINES * (shape.width // 8 + 1)))

    def planes(first: int, last: int):
        got, empty = merged.filter(F.col("part").between(first * LINES, last * LINES - 1)).toArrow(), np.zeros(shape.width // 8 + 1, np.uint8)
        found = {part: np.frombuffer(x, np.uint8) for part, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)}
        return spark.sparkContext.broadcast({k: found.get(k, empty) for k in range(first * LINES, last * LINES)})

    schema = "one long, two int, id long, hash long, at int"
    if shape.sections <= each:
        sent = planes(0, shape.sections)
        candidates = written(map_arrow(keyed.select("id", "hash", "text"), _candidates(window, shape, sent), schema), "windows")
        sent.unpersist()
    else:
        of = "pass int, representative long, id long, hash long"
        stored = written(map_arrow(keyed.select("id", "hash", "text"), _representatives(window, shape, each), of), "representatives", ("pass",))
        path = new_path(spark, "repeated")
        for k in range(-(-shape.sections // each)):
            sent = planes(k * each, min(shape.sections, (k + 1) * each))
            mine = stored.filter(F.col("pass") == k).select("representative", "id", "hash")
            map_arrow(mine, _repeated(shape, sent), "representative long, id long, hash long").write.mode("append").parquet(path)
            sent.unpersist()
        asked = spark.read.schema("representative long, id long, hash long").parquet(path).groupBy("id", "hash").agg(F.collect_set("representative").alias("asked"))
        with_asked = keyed.select("id", "hash", "text").join(asked, ["id", "hash"])
        candidates = written(map_arrow(with_asked, _candidates(window, shape, None), schema), "windows")

    # stored, so that the join has both its sides from plain exchanges and can split the rows of a hot window
    first = written(candidates.groupBy("one", "two").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last"), "first")
    removed = candidates.join(first, ["one", "two"]).filter("id > first")
    covers = written(map_arrow(removed.groupBy("id", "hash").agg(F.collect_set("at").alias("starts")), _covers(window), "id long, hash long, covers array<int>"), "covers")
    total = covers.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("covers")), F.lit(0))).first()[0]
    joined = keyed.join(F.broadcast(covers) if total <= max_broadcast_intervals else covers, ["id", "hash"], "left")
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [f"c{i}" for i in range(len(kept))]
    out = map_arrow(joined.select(*names, "text", "covers"), _rewrite(keep_text, names), ", ".join([*(f"{x} {types[c]}" for x, c in zip(names, kept, strict=True)), "n_words long, n_removed long, kept_sha256 string, kept_text string"]))
    return out.select(*(F.col(x).alias(c) for x, c in zip(names, kept, strict=True)), *[c for c in new if keep_text or c != "kept_text"])
