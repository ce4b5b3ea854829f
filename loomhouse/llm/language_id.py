"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions and gives every position a distribution over the languages. It is trained here, in
numpy, by backpropagation through time, each position of a training window having its document's language. A document's probabilities
are the mean of those of its letters' positions. Gates are piecewise linear, which keeps a step to a few array operations.

Whole texts are labelled: windows of ``STRIDE`` bytes cover them, each read with ``MARGIN`` more bytes on both sides, thousands of windows in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomhouse.llm import words as W
from loomhouse.llm.shared import broadcast_below, map_arrow, prepare, written

HIDDEN = 12
STRIDE, MARGIN = 224, 16
AT_ONCE = 1024
LEAST_BATCH, MOST_BATCH = 128, 512
UNKNOWN = "und"
_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


class Direction:
    """One direction's weights: ``byte`` (256 x 3H) for the input, ``back`` (H x 3H) for the state; columns are reset, update, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.byte = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.back = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps x texts x H) of bytes (steps x texts)."""
        n = self.back.shape[0]
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)):
            given, state = self.byte.take(x[t], 0), h @ self.back
            gate = given[:, : 2 * n] + state[:, : 2 * n]
            gate *= 0.25
            gate += 0.5
            flat = (gate > 0) & (gate < 1) if keep is not None else None
            np.clip(gate, 0, 1, out=gate)
            r, z = gate[:, :n], gate[:, n:]
            a = given[:, 2 * n :] + r * state[:, 2 * n :]
            c = np.clip(a, -1, 1)
            new = h - c
            new *= z
            new += c
            if keep is not None:
                keep.append((h, r, z, state[:, 2 * n :], c, flat, np.abs(a) < 1))
            h = new
            out[t] = h
        return out

    def learn(self, x: np.ndarray, keep: list, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``byte`` and ``back`` from the states' errors."""
        n = self.back.shape[0]
        given, back = np.empty((*x.shape, 3 * n), np.float32), np.zeros_like(self.back)
        later = np.zeros_like(error[0])
        for t in range(len(x) - 1, -1, -1):
            h, r, z, q, c, flat, inside = keep[t]
            d = error[t] + later
            dc = d * (1 - z) * inside
            dgate = np.concatenate((dc * q, d * (h - c)), 1) * flat * 0.25
            dstate = np.concatenate((dgate, dc * r), 1)
            given[t] = np.concatenate((dgate, dc), 1)
            back += h.T @ dstate
            later = d * z + dstate @ self.back.T
        one = np.zeros((x.size, 256), np.float32)
        one[np.arange(x.size), x.ravel()] = 1
        return one.T @ given.reshape(-1, 3 * n), back


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.ways = languages, (Direction(rng, hidden), Direction(rng, hidden))
        self.out = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def states(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        a, b = keep or (None, None)
        return np.concatenate((self.ways[0].run(x, a), self.ways[1].run(x[::-1], b)[::-1]), 2)

    def shares(self, states: np.ndarray) -> np.ndarray:
        y = states @ self.out
        y += self.bias
        y -= y.max(-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(-1, keepdims=True)
        return y

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = 400, rate: float = 0.02, seed: int = 12) -> None:
        """Adam on windows of bytes (one a row), which are dealt to the steps in random order, again if they are few; each language weighs the same."""
        rng = np.random.default_rng(seed)
        rounds = max(1, -(-LEAST_BATCH * steps // len(labels)))
        dealt = np.array_split(np.concatenate([rng.permutation(len(labels)) for _ in range(rounds)]), steps)
        weight = (len(labels) / len(self.languages) / np.maximum(1, np.bincount(labels, minlength=len(self.languages)))).astype(np.float32)
        values = [self.ways[0].byte, self.ways[0].back, self.ways[1].byte, self.ways[1].back, self.out, self.bias]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        for step in range(1, steps + 1):
            some = dealt[step - 1]
            x, y = windows[some].T.astype(np.intp), labels[some]
            keep: tuple[list, list] = ([], [])
            states = self.states(x, keep)
            error = self.shares(states)
            error[:, np.arange(len(y)), y] -= 1
            error *= weight[y][None, :, None] / x.size
            flat = states.reshape(-1, states.shape[2])
            down = error @ self.out.T
            n = down.shape[2] // 2
            grads = [*self.ways[0].learn(x, keep[0], down[:, :, :n]), *self.ways[1].learn(x[::-1], keep[1], down[::-1, :, n:]), flat.T @ error.reshape(len(flat), -1), error.sum((0, 1))]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * (1 - step / (steps + 1))
            for v, m, s, g in zip(values, first, second, grads, strict=True):
                g *= min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def pooled(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The mean distribution over the letters of each of the texts ``data[bounds[i]:bounds[i + 1]]``; 0 where there is none."""
        size = np.diff(bounds)
        count = -(-size // STRIDE)
        owner = np.repeat(np.arange(len(size)), count)
        start = bounds[:-1][owner] + STRIDE * W.ragged(count)
        total = np.zeros((len(size), len(self.languages)))
        letters = np.zeros(len(size))
        shift = np.arange(-MARGIN, STRIDE + MARGIN)
        for i in range(0, len(owner), AT_ONCE):
            mine = owner[i : i + AT_ONCE]
            at = start[i : i + AT_ONCE][None, :] + shift[:, None]
            inside = (at >= bounds[mine]) & (at < bounds[mine + 1])
            x = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 32).astype(np.intp)
            here = slice(MARGIN, MARGIN + STRIDE)
            letter = _LETTER[x[here]] & inside[here]
            y = np.einsum("tbl,tb->bl", self.shares(self.states(x)[here]), letter.astype(np.float32))
            np.add.at(total, mine, y)
            np.add.at(letters, mine, letter.sum(0))
        return total / np.maximum(1, letters)[:, None]


def sample_texts(docs: DataFrame, training: Column, text_col: str, lang_col: str, id_col: str, rows_each: int) -> list[tuple[str, bytes]]:
    """(language, whole text in UTF-8) of up to ``rows_each`` labelled rows of every language, those with the least hash of id and text.

    Rows that are equal in language, id and text are one. A hash bound that leaves about twice the rows wanted comes before the ranks of a language, so that no task gets all rows of a frequent one.
    """
    text, lang, ident = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`"), F.col(f"`{id_col}`")
    wanted = docs.filter(training & lang.isNotNull() & text.isNotNull() & ident.isNotNull()).select(lang.alias("lang"), ident.alias("id"), text.alias("text"))
    hashed = wanted.withColumn("hash", F.xxhash64("id", "text"))
    share = hashed.groupBy("lang").agg((F.lit(2.0 * rows_each) / F.approx_count_distinct("hash")).alias("share"))
    few = hashed.join(broadcast_below(written(share.withColumnRenamed("lang", "of"), "languages"), 100_000), F.col("lang") == F.col("of"))
    few = few.filter((F.shiftrightunsigned(F.xxhash64("hash", F.lit("sample")), 11) / F.lit(float(1 << 53))) < F.col("share"))
    once = few.groupBy("lang", "id", "hash").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    got = once.withColumn("rank", rank).filter(F.col("rank") <= rows_each).select("lang", "text")
    return sorted((r["lang"], r["text"].encode()) for r in got.toLocalIterator())


def trained(samples: list[tuple[str, bytes]], length: int = 64, steps: int = 400, **options) -> Network | None:
    """A network of the samples' languages, which learns from each window of ``length`` bytes of every text once, the last one filled up with spaces."""
    samples = [(lang, text) for lang, text in samples if text]
    if not samples:
        return None
    network = Network(sorted({lang for lang, _ in samples}))
    code = {x: i for i, x in enumerate(network.languages)}
    windows, labels = [], []
    for lang, text in samples:
        n = -(-len(text) // length)
        windows.append(np.frombuffer(text.ljust(n * length), np.uint8).reshape(n, length))
        labels += [code[lang]] * n
    network.train(np.concatenate(windows), np.array(labels), max(steps, len(labels) // MOST_BATCH), **options)
    return network


def _label(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network | None = sent.value
        for b in batches:
            lettered = b.column("lettered").to_numpy(zero_copy_only=False)
            for lo, hi, data, bounds in W.texts(b.column("text")):
                shares = network.pooled(data, bounds) if network else np.zeros((hi - lo, 1))
                best = shares.argmax(1)
                known = lettered[lo:hi] & (shares.max(1) > 0)
                lang = [network.languages[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
                score = np.where(known, np.clip(shares[np.arange(hi - lo), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(b.column(x).slice(lo, hi - lo) for x in names), pa.array(lang), pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def identify(
    docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", keep_text: bool = False, sample_rows: int = 250, window: int = 64, model: Network | None = None
) -> DataFrame:
    """``docs`` with lang_pred and score, and without the text unless ``keep_text``.

    The network learns from the whole texts of at most ``sample_rows`` rows of each language, where ``training`` holds and id, text and language are not
    null; ids may repeat. Every text is labelled whole, however long. lang_pred is a learned language, and ``und`` with score 0 where the text is null or without a letter, or if there was nothing to learn from;
    score is the language's mean probability. Ties go to the language that sorts first. Columns named as new ones are replaced.
    """
    spark = prepare(docs.sparkSession)
    network = model or trained(sample_texts(docs, training, text_col, lang_col, id_col, sample_rows), window)
    new = ("lang_pred", "score")
    kept = [c for c in docs.columns if c not in new and (keep_text or c != text_col)]
    names = [f"c{i}" for i in range(len(kept))]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(kept, names, strict=True)), text.rlike(r"\p{L}").alias("lettered"), text.alias("text"))
    out = map_arrow(read, _label(spark.sparkContext.broadcast(network), names), ", ".join([*(f"{x} {types[c]}" for c, x in zip(kept, names, strict=True)), "lang_pred string, score double"]))
    return out.select(*(F.col(x).alias(c) for c, x in zip(kept, names, strict=True)), *new)
