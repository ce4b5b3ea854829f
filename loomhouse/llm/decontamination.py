"""Benchmark items inside documents, found by a random-walk embedding and bit sampling.

Texts become words: Unicode lower case, parted by all ASCII but letters and digits; in scripts without spaces each character is a word. The CGK embedding walks over a window word by
word; at each step it emits the word it stands on and moves on or stays by a random bit of (step, word). Two walks that an edit has
parted meet again soon, so a small edit distance becomes a small Hamming distance. A walk from a start in a document is the same for
all window sizes up to where it leaves the window; so the walks from all starts are run once, in step, and each sample of a few steps
serves all items whose windows the walk hardly leaves within these steps (an item of n words: steps up to 1.5 n).

Walks begin only where a window could hold an item by the number of its words that occur in items at all, which loses none (``Index.likely``). With the numbers of walks and
samples set here they find 0.95 of the items at similarity 0.8, and more of nearer ones. The rest is found exactly: an item of n words and k edits, cut into
k + 1 seeds, keeps one seed whole, so all runs of words that equal a seed are candidates too.

Several walks and samples are repeated (``walks`` times ``samples`` for each of the two longest ``RANGES`` that fit); an item and a window that agree in all steps of
one sample are a candidate, and the edit distance is then computed exactly, the item against the best run of words near there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomhouse.llm import words as W
from loomhouse.llm.shared import map_arrow, prepare

#: Steps that a sample is taken from; items of less than two thirds as many words don't use it.
RANGES = (8, 14, 24, 40, 66)
PIECE = 64
TAKEN = 4
HERE = 1 << 14
_FILTER = 1 << 16
_VOCABULARY = 1 << 20
_NONE = np.empty(0, np.uint64)


#: Scripts written without spaces: each of their characters is a word.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def words_of(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def parted(texts: pa.Array) -> pa.Array:
    """``texts`` with spaces around each character of the scripts without spaces."""
    whole = texts.cast(pa.large_string())
    many = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    # their characters take three bytes or four in UTF-8
    return pc.replace_substring_regex(whole, UNSPACED, r" \1 ") if len(many) and many.max() >= 0xE0 else whole


class Samples:
    """Steps of every sample, and the walks' bits of words, all from one seed."""

    def __init__(self, walks: int, samples: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(1, 1 << 63, (walks, 2), dtype=np.uint64)
        self.factor = rng.integers(1, 1 << 63, (walks, len(RANGES), samples, TAKEN), dtype=np.uint64) | np.uint64(1)
        # one step from each quarter of the range, so that a sample looks at the whole window
        self.step = np.stack([np.stack([rng.integers(k * r // TAKEN, (k + 1) * r // TAKEN, (walks, samples)) for k in range(TAKEN)], -1) for r in RANGES], 1)
        self.longest = max(RANGES)

    def bits(self, key: np.ndarray, walk: int) -> list[np.ndarray]:
        return [W.mix(key ^ s) for s in self.salt[walk]]

    @staticmethod
    def fit(words: int) -> list[int]:
        """The ranges for items of so many words: the two largest that such a walk hardly leaves, the shortest only if it is alone."""
        fit = [i for i, r in enumerate(RANGES) if 2 * r <= 3 * words + 2]
        return fit[1:][-2:] or [0]

    def run(self, key: np.ndarray, starts: np.ndarray, walk: int, ranges: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(range, sample, key of each of the windows from ``starts``) of one walk over ``ranges``.

        ``key`` goes on for as long as walks may reach, or is filled up.
        """
        one, two = self.bits(key, walk)
        at = starts.astype(np.intp)
        wanted: dict[int, list[tuple[int, int, int]]] = {}
        for r in ranges:
            for s in range(self.step.shape[2]):
                for k, j in enumerate(self.step[walk, r, s]):
                    wanted.setdefault(int(j), []).append((r, s, k))
        sums: dict[tuple[int, int], np.ndarray] = {}
        for j in range(1 + max(wanted, default=-1)):
            if j in wanted:
                here = key.take(at)
                for r, s, k in wanted[j]:
                    term = here * self.factor[walk, r, s, k]
                    if (r, s) in sums:
                        sums[r, s] += term
                    else:
                        sums[r, s] = term
            move = ((one if j < 64 else two) >> np.uint64(j % 64)) & np.uint64(1)
            at += move.astype(np.intp).take(at)
        for (r, s), x in sums.items():
            yield r, s, x ^ (x >> np.uint64(29))


def _filled(key: np.ndarray, more: int) -> np.ndarray:
    return np.concatenate((key, np.zeros(more, np.uint64)))


def edits(words: int, similarity: float) -> int:
    """The largest edit distance of an item of so many words."""
    return int((1 - similarity) * words + 1e-9)


def runs(key: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, key of the run of so many words from each start), by doubling."""
    power, wide = 1, {1: key}
    while 2 * power <= max(lengths, default=1):
        x = wide[power]
        wide[2 * power] = W.mix(x[: max(0, len(x) - power)] * W.BASE + x[power:])
        power *= 2
    for n in lengths:
        most = 1 << (n.bit_length() - 1)
        x, size = wide[most], max(0, len(key) - n + 1)
        yield n, W.mix(x[:size] * W.BASE + x[n - most :][:size])


class Index:
    """Items, cut into pieces of up to 64 words, by the key of each sample; and their seeds by length."""

    def __init__(self, ids: list, texts: list[str], samples: Samples, min_words: int, similarity: float = 0.8):
        self.samples, self.ids, self.words, self.min_words, pieces = samples, [], [], min_words, []
        for i, text in zip(ids, parted(pa.array(texts, pa.string())).to_pylist(), strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            key = W.split(data, np.array([0, len(data)]), between=W.NOT_ALNUM).key
            if len(key) >= min_words:
                parts = -(-len(key) // PIECE)
                cut = np.linspace(0, len(key), parts + 1).astype(int)
                pieces += [(len(self.words), a, key[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            if len(key):
                self.ids.append(i)
                self.words.append(key)
        found: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
        for item, offset, key in pieces:
            for walk in range(len(samples.salt)):
                for r, s, x in samples.run(_filled(key, samples.longest), np.zeros(1), walk, samples.fit(len(key))):
                    found.setdefault((walk, r, s), []).append((int(x[0]), item, offset))
        self.ranges = sorted({r for _, r, _ in found})
        # windows of ``reach`` words that hold ``least`` words of items: for lengths in steps of a sixteenth
        self.vocabulary = np.zeros(_VOCABULARY, bool)
        self.vocabulary[(np.concatenate([_NONE, *self.words]) >> np.uint64(64 - _VOCABULARY.bit_length() + 1)).astype(np.int64)] = True
        lengths, self.shapes = sorted({len(key) for _, _, key in pieces}), []
        while lengths:
            here = [n for n in lengths if n <= lengths[0] * 1.0625]
            self.shapes.append((here[-1], here[0] - edits(here[0], similarity)))
            lengths = lengths[len(here) :]
        self.tables = {}
        for k, rows in found.items():
            rows.sort()
            keys = np.array([x[0] for x in rows], np.uint64)
            first = np.zeros(_FILTER, bool)
            first[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.tables[k] = first, keys, np.array([x[1:] for x in rows], np.int64)
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for item, key in enumerate(self.words):
            parts = min(len(key), self.allowed(len(key), similarity) + 1)
            cut = np.linspace(0, len(key), parts + 1).astype(int)
            for a, n in zip(cut[:-1].tolist(), np.diff(cut).tolist(), strict=True):
                _, x = next(runs(key[a : a + n], [n]))
                seeds.setdefault(n, []).append((int(x[0]), item, a))
        self.seeds = {}
        for n, rows in sorted(seeds.items()):
            rows.sort()
            keys = np.array([x[0] for x in rows], np.uint64)
            first = np.zeros(_FILTER, bool)
            first[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.seeds[n] = first, keys, np.array([x[1:] for x in rows], np.int64)

    def allowed(self, words: int, similarity: float) -> int:
        """The largest edit distance of an item of so many words; short items hold only where they are equal."""
        return edits(words, similarity) if words >= self.min_words else 0

    def likely(self, key: np.ndarray) -> np.ndarray:
        """Where a window could begin that holds an item: of an item of n words with at most k edits, n - k stand in the first n words of its run.

        (Words that insertions push out of these are edits, too.) No window within the similarity is lost; how many others go depends on how many of the texts' words
        occur in items.
        """
        known = np.concatenate(([0], np.cumsum(self.vocabulary[(key >> np.uint64(64 - _VOCABULARY.bit_length() + 1)).astype(np.int64)], dtype=np.int32)))
        out, at = np.zeros(len(key), bool), np.arange(len(key))
        for reach, least in self.shapes:
            out |= known[np.minimum(at + reach, len(key))] - known[:-1] >= least
        return out

    def candidates(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, starts in ``key``), each pair once."""
        reach = self.samples.longest
        whole, items, starts = _filled(key, reach), [], []

        def look(x: np.ndarray, place: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
            first, keys, rows = table
            at = np.flatnonzero(first.take((x >> np.uint64(48)).astype(np.intp)))
            lo, hi = np.searchsorted(keys, x[at]), np.searchsorted(keys, x[at], "right")
            which = np.repeat(lo, hi - lo) + W.ragged(hi - lo)
            items.append(rows[which, 0])
            starts.append(np.repeat(place[at], hi - lo) - rows[which, 1])

        widest = max(self.seeds, default=1)
        for a in range(0, len(key), HERE):
            for n, x in runs(key[a : a + HERE + widest - 1], [*self.seeds]):
                look(x[:HERE], a + np.arange(min(HERE, len(x))), self.seeds[n])
        likely = np.flatnonzero(self.likely(key))
        for here in (likely[i : i + HERE] for i in range(0, len(likely), HERE)):
            part = whole[here[0] : here[-1] + 1 + reach]
            for walk in range(len(self.samples.salt)):
                for r, s, x in self.samples.run(part, here - here[0], walk, self.ranges):
                    look(x, here, self.tables[walk, r, s])
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pair = np.unique(np.stack((np.concatenate(items), np.concatenate(starts)), 1), axis=0)
        return pair[:, 0], pair[:, 1]


def best_run(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """(edit distance, start) of the run of ``text`` that is nearest to ``item``, the first of several, if at most ``most``."""
    n, at = len(text), np.arange(len(text) + 1)
    cost, start = np.zeros(n + 1, np.int64), at.copy()
    for i, w in enumerate(item):
        swap = cost[:-1] + (text != w)
        step = np.concatenate(([i + 1], np.minimum(swap, cost[1:] + 1)))
        origin = np.concatenate(([0], np.where(swap <= cost[1:] + 1, start[:-1], start[1:])))
        # cost and origin in one number: the least cost, then the first origin; a word skipped in the text adds 1
        both = (step - at) * (2 * n + 2) + origin
        both = np.minimum.accumulate(both)
        cost, start = both // (2 * n + 2) + at, both % (2 * n + 2)
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end])


def matches(index: Index, key: np.ndarray, first: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, distance, start) of the best run of each text and item; ``first`` has the bounds of the texts in ``key``."""
    items, starts = index.candidates(key)
    if not len(items):
        return
    # a start that an edit has shifted may lie in a neighbour: each candidate goes to all texts that its run could lie in
    length = np.array([len(x) for x in index.words])
    allowed = np.array([index.allowed(n, similarity) for n in length])
    low, high = starts - 2 * allowed[items] - 4, starts + length[items] + 4 * allowed[items] + 8
    one = np.maximum(np.searchsorted(first, np.maximum(low, 0), "right") - 1, 0)
    each = np.maximum(np.searchsorted(first, np.minimum(high, len(key)), "left") - one, 0)
    texts, at = np.repeat(one, each) + W.ragged(each), np.repeat(np.arange(len(items)), each)
    whole = np.minimum(high[at], first[texts + 1]) - np.maximum(low[at], first[texts]) >= (length - allowed)[items[at]]
    texts, items, starts = texts[whole], items[at[whole]], starts[at[whole]]
    by = np.lexsort((starts, items, texts))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    tried: dict[tuple[int, int], int] = {}
    for text, item, start in zip(texts[by].tolist(), items[by].tolist(), starts[by].tolist(), strict=True):
        word = index.words[item]
        most = index.allowed(len(word), similarity)
        low, high = first[text], first[text + 1]
        if start < tried.get((text, item), -1):
            continue
        reach = 2 * most + 4
        a, b = max(low, start - reach), min(high, start + len(word) + 2 * reach)
        here = key[a:b]
        if np.isin(here, word).sum() < len(word) - most or np.isin(word, here).sum() < len(word) - most:
            continue
        if got := best_run(word, here, most):
            found = got[0], a + got[1] - low
            best[text, item] = min(best.get((text, item), found), found)
            if not most or got[0] == 0:
                tried[text, item] = high
        tried[text, item] = max(tried.get((text, item), -1), start + reach)
    for (text, item), (distance, start) in best.items():
        yield text, item, distance, int(start)


def _find(sent, similarity: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            for lo, hi, w in W.slices(parted(b.column("text")), between=W.NOT_ALNUM):
                rows = [*matches(index, w.key, w.first, similarity)]
                if rows:
                    at = pa.array([lo + x[0] for x in rows])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(b.column(x).take(at) for x in names),
                            pa.array([index.ids[x[1]] for x in rows], pa.int64()),
                            pa.array([len(index.words[x[1]]) for x in rows], pa.int32()),
                            *(pa.array([x[k] for x in rows], pa.int32()) for k in (2, 3)),
                        ],
                        names=[*names, "item_id", "item_words", "distance", "start_word"],
                    )

    return run


def find_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8, min_words: int = 5, walks: int = 4, samples: int = 10, items_each: int = 10_000, bytes_each: int = 16 << 20
) -> DataFrame:
    """A row for each row of ``docs`` and item that it holds: the columns of ``docs`` but the text, item_id, item_words, distance, start_word.

    A document holds an item of n words if some run of its words has an edit distance of floor((1 - similarity) n) at most, in words; start_word
    is where the best run begins, the first of several. Items of fewer words than ``min_words`` hold where a run equals them; null and empty
    ones hold nowhere. Documents of any length are searched whole. Repeated documents and
    repeated items each give their rows. Items are taken in blocks of bounded size, each broadcast and held against all documents. Columns of ``docs`` with the names of new
    ones are dropped.
    """
    spark = prepare(docs.sparkSession)
    new = ("item_id", "item_words", "distance", "start_word")
    kept = [c for c in docs.columns if c != text_col and c not in new]
    names = [f"c{i}" for i in range(len(kept))]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"{x} {types[c]}" for x, c in zip(names, kept, strict=True)), "item_id long, item_words int, distance int, start_word int"])
    read = docs.select(*(F.col(f"`{c}`").alias(x) for x, c in zip(names, kept, strict=True)), words_of(F.col(f"`{text_col}`")).alias("text"))
    source = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), words_of(F.col(f"`{item_text}`")).alias("text"))
    n, size = source.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // items_each), -(-size // bytes_each))
    seed, out = Samples(walks, samples), None
    for k in range(blocks):
        block = source.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        index = Index([r["id"] for r in block], [r["text"] for r in block], seed, min_words, similarity)
        part = map_arrow(read, _find(spark.sparkContext.broadcast(index), similarity, names), schema)
        out = part if out is None else out.unionAll(part)
    return out.select(*(F.col(x).alias(c) for x, c in zip(names, kept, strict=True)), *new)
