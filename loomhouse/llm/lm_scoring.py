"""Language-model scores from a log-frequency Bloom filter.

Every task adds up the words and n-grams of some MB of text at a time and sends them, cut by cell (the top bits of a key), to the task that merges the
cell; nothing is pruned, so what is gathered grows with the corpus, and so does the number of cells, a cell staying at ``cell_bytes`` of text. The merged cell keeps
exact word counts and a piece of the filter: a count c is quantised to q = 1 + floor(log_b c), and the members (key, 1) .. (key, q) enter the piece, whose
width follows their number.

Scoring probes (key, 1), (key, 2), ... until one is absent, which gives q and so the least and the largest count that q stands for. With these, p(w) = (c(w) + 1) / (N + V + 1) and
p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu), where h' drops the oldest word of h. Least counts above and largest ones below keep the sum of
probabilities at 1 or less, but for the filter's false positives (about 1 in 100 probes).

A filter of ``max_filter_bytes`` at most is broadcast, and texts are scored in one pass. The table of the most frequent words, which
has ``head_words`` rows at most, goes with it for the base score; other words are looked up by a shuffled join. Beyond that size no filter is sent: each cell probes its own piece for
the keys that slices of the texts have sent it, each key once, and the levels go back to the slices, which are read once more, text by text behind their levels. Both ways probe the
same pieces and give the same scores, and the work of both is in proportion to the text. A worker unpacks one slice at a time, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomhouse.llm import words as W
from loomhouse.llm.shared import map_arrow, prepare, written

FLUSH = 1 << 20
#: Bytes of an Arrow batch, beyond which no further row enters it; whether a query's shuffle files go as it ends.
BATCH_BYTES, CLEANUP = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of filter for a byte of text, more than has been seen; decides which way is tried first.
FILTER_SHARE = 0.1
#: Keys of the marks before and after a text.
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BE6546B65)
WORDS, GRAMS = 1, 2
_NONE = np.empty(0, np.uint64)
_PARTS = pa.schema([("cell", pa.int64()), ("slice", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_CELLS = pa.schema(
    [("cell", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("top", pa.int32()), ("word_keys", pa.binary()), ("word_counts", pa.binary()), ("word_bits", pa.binary()), ("gram_bits", pa.binary())]
)
_SLICES = pa.schema([("slice", pa.int64()), ("rows", pa.binary())])
_ANSWERS = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("cell", pa.int64()), ("levels", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def spark_schema(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def cell_bits(text_bytes: int, cell_bytes: int) -> int:
    return min(32, max(5, (text_bytes // cell_bytes).bit_length()))


def cell_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def folded(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a key that follow its cell's: an n-gram is held to these in a cell."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def follow(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of the n-gram that ends in w after the n-gram h."""
    return W.mix(h * np.uint64(0xD6E8FEB86659FD93) + w)


def sequence(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts with each text's end; the histories of one word; the text of each token."""
    n = len(w.first) - 1
    owner = np.repeat(np.arange(n), np.diff(w.first) + 1)
    token = np.full(len(owner), END, np.uint64)
    last = w.first[1:] + np.arange(n)
    inside = np.ones(len(owner), bool)
    inside[last] = False
    token[inside] = w.key
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[w.first[:-1] + np.arange(n)] = BEGIN
    return token, before, owner


def grams(token: np.ndarray, before: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 2 .. order: (positions, keys of the n-grams ending there, keys of their histories). Histories never leave a text."""
    history, at = before, np.arange(len(token))
    for _ in range(2, order + 1):
        key = follow(history, token[at])
        yield at, key, history
        whole, here = np.zeros(len(token), np.uint64), np.zeros(len(token), bool)
        whole[at], here[at] = key, True
        at = at[before[at] != BEGIN]
        at = at[here[at - 1]]
        history = whole[at - 1]


def _sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
    else:
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
    if not len(keys):
        return keys, np.empty(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.diff(np.append(new, len(keys))) if counts is None else np.add.reduceat(counts, new)


def _cut(kind: int, keys: np.ndarray, counts: np.ndarray, bits: int, slice_: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """Distinct keys, which ascend, and their counts by cell."""
    cells = cell_of(keys, bits)
    edges = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else cells
    held = keys if kind == WORDS else folded(keys, bits)
    counts = counts.astype("<u4")
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=False):
        yield int(cells[a]), slice_, kind, held[a:b].tobytes(), zlib.compress(counts[a:b].tobytes(), 1)


def _count(order: int, bits: int):
    """The training texts' words and n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [x for i, kind in enumerate((WORDS, GRAMS)) for x in _cut(kind, *_sums(np.concatenate([h[i] for h in held])), bits, 0)]
            for i in range(0, len(rows), 4096):
                yield rows_of(_PARTS, rows[i : i + 4096])

        for b in batches:
            for _, _, w in W.slices(b.column(0), lower=True):
                token, before, _ = sequence(w)
                held.append((np.append(token, np.full(len(w.first) - 1, BEGIN)), np.concatenate([_NONE, *(k for _, k, _ in grams(token, before, order))])))
                size += len(token)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def quantised(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def least(levels: np.ndarray, base: float) -> np.ndarray:
    """The least count of a quantised count; 0 for 0."""
    return np.where(levels > 0, np.ceil(base ** (levels - 1.0) - 1e-9), 0.0)


def most(levels: np.ndarray, base: float) -> np.ndarray:
    """The largest count of a quantised count; 0 for 0."""
    return np.where(levels > 0, np.ceil(base ** (levels * 1.0) - 1e-9) - 1, 0.0)


def _member(key: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return W.mix(key + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _place(member: np.ndarray, width: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit block of a member, and its five bits there."""
    bits = np.zeros(len(member), np.uint64)
    for k in range(5):
        bits |= np.uint64(1) << ((member >> np.uint64(6 * k)) & np.uint64(63))
    return ((member >> np.uint64(32)) * width) >> np.uint64(32), bits


def piece(keys: np.ndarray, counts: np.ndarray, base: float, bits_each: float) -> np.ndarray:
    """A cell's piece of the filter: blocks of 64 bits, as many as its members need."""
    q = quantised(counts, base)
    member = _member(np.repeat(keys.astype(np.uint64), q), W.ragged(q) + 1)
    width = max(1, int(np.ceil(len(member) * bits_each / 64)))
    block, bits = _place(member, np.uint64(width))
    by = np.argsort(block, kind="stable")
    block, bits = block[by], bits[by]
    out = np.zeros(width, np.uint64)
    if len(block):
        new = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        out[block[new]] = np.bitwise_or.reduceat(bits, new)
    return out


class Filter:
    """Pieces of cells, laid end to end. ``top`` is the highest level in a cell, where probing ends even if the piece is full."""

    def __init__(self, pieces: dict[int, tuple[int, np.ndarray]], bits: int, fold: bool):
        self.bits, self.fold = bits, fold
        self.cells = np.array(sorted(pieces), np.int64)
        blocks = [pieces[c][1] for c in self.cells.tolist()]
        self.width = np.array([len(x) for x in blocks], np.uint64)
        self.at = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
        self.top = np.array([pieces[c][0] for c in self.cells.tolist()], np.int64)
        self.blocks = np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key, by membership probes of rising level; 0 where even the first fails."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.cells):
            return out
        cell = cell_of(keys, self.bits)
        nth = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        inner = folded(keys, self.bits).astype(np.uint64) if self.fold else keys
        open_ = np.flatnonzero(self.cells[nth] == cell)
        level = 1
        while len(open_):
            c = nth[open_]
            block, bits = _place(_member(inner[open_], level), self.width[c])
            hit = (self.blocks[self.at[c] + block.astype(np.int64)] & bits) == bits
            hit &= level <= self.top[c]
            open_ = open_[hit]
            out[open_] = level
            level += 1
        return out


def _merged(rows: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one kind in a cell, with their counts in all parts."""
    kinds = rows.column("kind").to_numpy()
    at = pa.array(np.flatnonzero(kinds == kind))
    keys, counts = (rows.column(x).take(at).to_pylist() for x in ("keys", "counts"))
    keys = np.frombuffer(b"".join(keys), np.uint64 if kind == WORDS else np.uint32)
    counts = np.frombuffer(b"".join(map(zlib.decompress, counts)), "<u4").astype(np.int64)
    return _sums(keys, counts)


def _merge(base: float, bits_each: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        words, n = _merged(rows, WORDS)
        grams_, m = _merged(rows, GRAMS)
        real = words != BEGIN
        pieces = [piece(k.astype(np.uint64), c, base, bits_each).tobytes() if len(k) else b"" for k, c in ((words, n), (grams_, m))]
        top = max(int(quantised(c, base).max()) if len(c) else 0 for c in (n, m))
        out = (key[0].as_py(), int(real.sum()), int(n[real].sum()), top, words.tobytes(), n.tobytes(), *pieces)
        return pa.Table.from_batches([rows_of(_CELLS, [out])])

    return run


Levels = Callable[[np.ndarray], np.ndarray]


def log_scores(token: np.ndarray, before: np.ndarray, order: int, base: float, mu: float, total: int, vocabulary: int, of_words: Levels, of_grams: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 p of every token after its history, the distinct words, which of them each token is)."""
    distinct, at = np.unique(np.append(token, BEGIN), return_inverse=True)
    levels, at, begin = of_words(distinct), at[:-1], at[-1]
    p = (least(levels, base)[at] + 1) / (total + vocabulary + 1)
    last = np.where(before == BEGIN, begin, np.concatenate(([begin], at[:-1])))
    known = most(levels, base)[last]
    for k, (pos, key, history) in enumerate(grams(token, before, order)):
        c = least(of_grams(key), base)
        h = most(of_grams(history), base) if k else known[pos]
        p[pos] = (c + mu * p[pos]) / (np.maximum(h, c) + mu)
    return np.log10(p), distinct, at


def _score(order: int, base: float, mu: float, total: int, vocabulary: int, sent, names: list[str]):
    """The broadcast way: sums of log10 p, the base sums of frequent words, and the keys of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigrams, ngrams, head_keys, head_counts = sent.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, hi, w in W.slices(b.column("text"), lower=True):
                token, before, owner = sequence(w)
                n = hi - lo
                logs, distinct, at = log_scores(token, before, order, base, mu, total, vocabulary, unigrams.levels, ngrams.levels)
                found = np.searchsorted(head_keys, distinct)
                found[found == len(head_keys)] = 0
                frequent = head_keys[found] == distinct if len(head_keys) else np.zeros(len(distinct), bool)
                head = frequent[at]
                known = (np.log10(head_counts[found] + 1.0) if len(head_keys) else np.zeros(len(distinct)))[at[head]]
                rest, whose = token[~head], owner[~head]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(n + 1)).astype(np.int32)), pa.array(rest.view(np.int64)))
                sums = [np.bincount(owner, logs, n), np.bincount(owner[head], minlength=n).astype(np.int64), np.bincount(owner[head], known, n).astype(float)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(x).slice(lo, n) for x in names), pa.array(np.arange(row, row + n)), pa.array(np.diff(w.first) + 1), *map(pa.array, sums), lists],
                    names=[*names, "row", "n_tokens", "score", "head_known", "head_sum", "rest"],
                )
                row += n

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["key", "count"])


def _threshold(counts: DataFrame, head_words: int) -> int:
    """The least count from which on at most ``head_words`` words have it or a larger one; sixteen steps to each doubling."""
    steps = counts.groupBy(F.floor(F.log2("count") * 16).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, at = 0, None
    for step, n in sorted(((r["step"], r["n"]) for r in steps), reverse=True):
        total += n
        if total > head_words:
            break
        at = step
    return 1 << 62 if at is None else int(np.ceil(2 ** (at / 16) - 1e-9))


def _gathered(pieces: DataFrame, bits: int, fold: bool) -> Filter:
    """The filter of (cell, top, piece), laid out as the pieces come in, one partition at a time."""
    sizes = sorted(tuple(r) for r in pieces.filter("length(piece) > 0").select("cell", "top", F.length("piece")).collect())
    out = Filter({c: (top, np.empty(size // 8, np.uint64)) for c, top, size in sizes}, bits, fold)
    at = dict(zip(out.cells.tolist(), out.at.tolist(), strict=True))
    for cell, data in pieces.filter("length(piece) > 0").select("cell", "piece").toLocalIterator():
        part = np.frombuffer(data, np.uint64)
        out.blocks[at[cell] : at[cell] + len(part)] = part
    return out


def _slice(slice_bytes: int):
    """One row for some MB of texts: (slice, their rows as a compressed Arrow stream), a value of which the JVM makes no columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, held, size = TaskContext.get().partitionId() << 33, [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for x in held:
                    stream.write_batch(x)
            return rows_of(_SLICES, [(slice_, sink.getvalue().to_pybytes())])

        for b in batches:
            for lo, hi, data, _ in W.texts(b.column("text")):
                held.append(b.slice(lo, hi - lo))
                size += len(data)
                if size >= slice_bytes:
                    yield out()
                    slice_, held, size = slice_ + 1, [], 0
        if held:
            yield out()

    return run


def _learnt(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each stands where ``training`` holds."""
    distinct, (some, n) = _sums(keys)[0], _sums(keys[training])
    counts = np.zeros(len(distinct), np.int64)
    counts[np.searchsorted(distinct, some)] = n
    return distinct, counts


def _asked(order: int, bits: int):
    """Each slice's words and n-grams by cell, with the number of times that its training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slice_, rows in zip(b.column("slice").to_pylist(), b.column("rows"), strict=True):
                found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORDS: [], GRAMS: [(_NONE, np.empty(0, bool))]}
                for x in pa.ipc.open_stream(rows.as_buffer()):
                    training = x.column("training").to_numpy(zero_copy_only=False).astype(bool)
                    for lo, hi, w in W.slices(x.column("text"), lower=True):
                        token, before, owner = sequence(w)
                        learnt = training[lo:hi]
                        found[WORDS].append((np.append(token, np.full(hi - lo, BEGIN)), np.append(learnt[owner], learnt)))
                        found[GRAMS] += [(key, learnt[owner[at]]) for at, key, _ in grams(token, before, order)]
                for kind in (WORDS, GRAMS):
                    keys, marks = map(np.concatenate, zip(*found.pop(kind), strict=True))
                    parts = [*_cut(kind, *_learnt(keys, marks), bits, slice_)]
                    for k in range(0, len(parts), 4096):
                        yield rows_of(_PARTS, parts[k : k + 4096])

    return run


def _answer(base: float, bits_each: float, bits: int):
    """A cell's levels and word counts for the keys that each slice has sent; and the cell's words and tokens."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        cell, tops, exact = key[0].as_py(), [0], {}
        kinds = rows.column("kind").to_numpy()
        n_words = n_tokens = 0
        for kind in (WORDS, GRAMS):
            mine = rows.take(pa.array(np.flatnonzero(kinds == kind)))
            sent = mine.column("keys").to_pylist()
            flat = np.frombuffer(b"".join(sent), np.uint64 if kind == WORDS else np.uint32)
            weights = np.frombuffer(b"".join(map(zlib.decompress, mine.column("counts").to_pylist())), "<u4")
            by = np.argsort(flat)
            ordered = flat[by]
            new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(flat) else np.empty(0, bool)
            distinct, rank = ordered[new], np.empty(len(flat), np.int32)
            rank[by] = np.cumsum(new, dtype=np.int32) - 1
            n = np.add.reduceat(weights[by], np.flatnonzero(new), dtype=np.int64) if len(flat) else np.empty(0, np.int64)
            if kind == WORDS:
                real = (distinct != BEGIN) & (n > 0)
                n_words, n_tokens = int(real.sum()), int(n[real].sum())
            tops.append(int(quantised(n.max(), base)) if n.any() else 0)
            exact[kind] = mine.column("slice").to_pylist(), [len(x) // flat.itemsize for x in sent], distinct, rank, n
        prefix = np.uint64(cell << (64 - bits))
        out = [(-1, 0, cell, b"", b"", n_words, n_tokens)]
        for kind, (slices, lengths, distinct, rank, n) in exact.items():
            found = np.zeros(len(distinct), np.uint8)
            if n.any():
                blocks = piece(distinct[n > 0].astype(np.uint64), n[n > 0], base, bits_each)
                whole = distinct if kind == WORDS else (distinct.astype(np.uint64) << np.uint64(32 - bits)) | prefix
                found = Filter({cell: (max(tops), blocks)}, bits, kind == GRAMS).levels(whole).astype(np.uint8)
            levels, at = found[rank].tobytes(), 0
            counts = n.astype("<u4")[rank] if kind == WORDS else None
            for slice_, length in zip(slices, lengths, strict=True):
                held = b"" if counts is None else zlib.compress(counts[at : at + length].tobytes(), 1)
                out.append((slice_, kind, cell, levels[at : at + length], held, 0, 0))
                at += length
        return pa.Table.from_batches([rows_of(_ANSWERS, out)])

    return run


def _looked(of: np.ndarray, levels: np.ndarray) -> Levels:
    """The levels of keys that are all in ``of``, which ascends; they are looked up in their order, for the processor's cache."""

    def look(keys: np.ndarray) -> np.ndarray:
        by, out = np.argsort(keys), np.empty(len(keys), np.int64)
        out[by] = levels[np.searchsorted(of, keys[by])]
        return out

    return look


def _score_slices(order: int, base: float, mu: float, total: int, vocabulary: int, names: list[str]):
    """The other way: rows by ``at``, which is twice a slice for the levels of its keys, in the keys' order by cell, and one more for its rows."""

    def scored(answers: list[pa.RecordBatch], docs: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        rows = sorted((x for b in answers for x in zip(*(b.column(k).to_pylist() for k in ("kind", "cell", "levels", "counts")), strict=True)), key=lambda x: x[:2])
        levels = {kind: np.frombuffer(b"".join(x[2] for x in rows if x[0] == kind), np.uint8) for kind in (WORDS, GRAMS)}
        counts = np.frombuffer(b"".join(zlib.decompress(x[3]) for x in rows if x[0] == WORDS), "<u4")
        # of the words, only keys stay between the two rounds
        parts = []
        for b in (b for rows in docs for b in pa.ipc.open_stream(rows)):
            parts += [([b.column(x).slice(lo, hi - lo) for x in names], W.Words(_NONE, _NONE, _NONE, _NONE, w.key, w.first)) for lo, hi, w in W.slices(b.column("text"), lower=True)]
        keys: dict[int, list[np.ndarray]] = {WORDS: [np.array([BEGIN])], GRAMS: [_NONE]}
        for _, w in parts:
            token, before, _ = sequence(w)
            keys[WORDS].append(_sums(token)[0])
            keys[GRAMS] += [_sums(key)[0] for _, key, _ in grams(token, before, order)]
        words, ngrams = (_sums(np.concatenate(keys.pop(kind)))[0] for kind in (WORDS, GRAMS))
        of_words, of_grams = _looked(words, levels[WORDS]), _looked(ngrams, levels[GRAMS])
        for columns, w in parts:
            token, before, owner = sequence(w)
            logs, distinct, at = log_scores(token, before, order, base, mu, total, vocabulary, of_words, of_grams)
            n, c = len(w.first) - 1, counts[np.searchsorted(words, distinct)][at]
            sums = [np.bincount(owner, minlength=n).astype(np.int64), np.bincount(owner, c > 0, n).astype(np.int64), np.bincount(owner, np.log10(c + 1.0), n), np.bincount(owner, logs, n)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums)], names=[*names, "n_tokens", "n_known", "known_sum", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, answers, docs = -1, [], []
        for b in batches:
            at = b.column("at").to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if at[lo] >> 1 != slice_:
                    yield from scored(answers, docs)
                    slice_, answers, docs = at[lo] >> 1, [], []
                if at[lo] & 1:
                    docs += [x.as_buffer() for x in b.column("rows").slice(lo, hi - lo)]
                else:
                    answers.append(b.slice(lo, hi - lo))
        yield from scored(answers, docs)

    return run


@contextmanager
def _held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold inside only."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def score_texts(
    docs: DataFrame,
    training: Column,
    text: str = "text",
    order: int = 2,
    base: float = 1.5,
    mu: float = 64.0,
    bits_each: float = 10.0,
    head_words: int = 1 << 19,
    max_filter_bytes: int = 96 << 20,
    cell_bytes: int = 8 << 20,
    slice_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score, from a model of the rows where ``training`` holds.

    Text: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, then one end token, which counts. A null text is an empty one: one token,
    the end. Texts of any length are taken whole. Repeated rows count as often as they occur and each gets its result. With no
    training rows N and V are 0 and every count is 0; an empty table has no rows. Columns of ``docs`` that have the names of new columns are replaced; others stay.
    """
    spark = prepare(docs.sparkSession)
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c != text and c not in new]
    names = [f"c{k}" for k in range(len(kept))]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    texts = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(kept, names, strict=True)), F.coalesce(training, F.lit(False)).alias("training"), texts.alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = cell_bits(size, cell_bytes)
    carried = [f"{x} {types[c]}" for x, c in zip(names, kept, strict=True)]

    def result(df: DataFrame, total: int, vocabulary: int) -> DataFrame:
        """From n_tokens, n_known, known_sum and score."""
        base_score = F.col("known_sum") - F.col("n_tokens") * float(np.log10(total + vocabulary + 1))
        columns = {"n_tokens": F.col("n_tokens"), "n_known": F.col("n_known"), "train_tokens": F.lit(total).cast("long"), "base_score": base_score, "score": F.col("score")}
        return df.select(*(F.col(x).alias(c) for c, x in zip(kept, names, strict=True)), *(x.alias(c) for c, x in columns.items()))

    def by_broadcast() -> DataFrame | None:
        """None if the filter is larger than may be broadcast."""
        parts = map_arrow(source.filter("training").select("text"), _count(order, bits), spark_schema(_PARTS))
        cells = written(parts.groupBy("cell").applyInArrow(_merge(base, bits_each), spark_schema(_CELLS)), "lm-cells")
        sums = cells.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n_tokens", "n_words", F.length("word_bits") + F.length("gram_bits")))).first()
        total, vocabulary = sums[0], sums[1]
        if sums[2] > max_filter_bytes:
            return None
        counts = map_arrow(cells.select("word_keys", "word_counts"), _unpack, "key long, count long")
        bar = _threshold(counts, head_words)
        head = counts.filter(F.col("count") >= bar).toArrow()
        by = np.argsort(keys := head.column("key").to_numpy().view(np.uint64))
        unigrams, ngrams = (_gathered(cells.select("cell", "top", F.col(x).alias("piece")), bits, fold) for x, fold in (("word_bits", False), ("gram_bits", True)))
        sent = spark.sparkContext.broadcast((unigrams, ngrams, keys[by], head.column("count").to_numpy()[by]))
        del unigrams, ngrams
        schema = ", ".join([*carried, "row long, n_tokens long, score double, head_known long, head_sum double, rest array<long>"])
        one = written(map_arrow(source.select(*names, "text"), _score(order, base, mu, total, vocabulary, sent, names), schema), "lm-scores")
        sent.unpersist()
        # the words that the table of frequent ones lacks
        rare = one.select("row", F.explode("rest").alias("key")).join(counts.filter(F.col("count") < bar), "key")
        rest = rare.groupBy("row").agg(F.sum(F.log10(F.col("count") + 1.0)).alias("rest_sum"), F.count(F.lit(1)).alias("rest_known"))
        joined = one.drop("rest").join(rest, "row", "left")
        sums = {"n_known": F.col("head_known") + F.coalesce("rest_known", F.lit(0)), "known_sum": F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0))}
        return result(joined.withColumns(sums), total, vocabulary)

    def by_cells() -> DataFrame:
        slices = written(map_arrow(source, _slice(slice_bytes), spark_schema(_SLICES)), "lm-slices")
        parts = map_arrow(slices, _asked(order, bits), spark_schema(_PARTS))
        # slices, which have some MB each, go to Python one by one; the parts' shuffle, as large as the input, goes once the answers are stored
        with _held(spark, {BATCH_BYTES: str(1 << 20), CLEANUP: "true"}):
            answers = written(parts.groupBy("cell").applyInArrow(_answer(base, bits_each, bits), spark_schema(_ANSWERS)), "lm-answers")
        total, vocabulary = (x or 0 for x in answers.agg(F.sum("n_tokens"), F.sum("n_words")).first())
        # a slice's levels stay rows of their own, ahead of its texts
        levels = answers.filter("kind > 0").select("slice", "kind", "cell", "levels", "counts", (F.col("slice") * 2).alias("at"))
        rows = levels.unionByName(slices.withColumn("at", F.col("slice") * 2 + 1), allowMissingColumns=True).repartition("slice").sortWithinPartitions("at")
        schema = ", ".join([*carried, "n_tokens long, n_known long, known_sum double, score double"])
        return result(map_arrow(rows.drop("slice"), _score_slices(order, base, mu, total, vocabulary, names), schema), total, vocabulary)

    found = by_broadcast() if size * FILTER_SHARE <= max_filter_bytes else None
    return found if found is not None else by_cells()
