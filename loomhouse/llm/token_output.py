"""Token ids in binary shards, as patched frame-of-reference blocks.

A shard file, all numbers little-endian:

    magic "LHPF", version u32, partition u32, chunk u32, ids of the same partition in earlier chunks u64, documents u64, ids u64, blocks u64
    document ids i64 each, whether a document id is null u8 each, ids of each document u32 each
    block index: offset of each block from the first one, u64 each
    blocks: least id u32, width u8, exceptions u16, 256 differences packed at the width (lowest bit first), then the
    exceptions: places u8 each, differences u32 each
    end mark: one byte 10

A block holds 256 ids less the least of them. Its width fits nine tenths of them; the others are patched in from the exceptions. The
last block is filled up with its least id. Shards in order of (partition, chunk) hold the documents in ascending order of their ids,
null first, rows with the same id by the hash of the text.

Spark writes the shards, one row to a file (its text writer sets the end mark), and reads them as binary files, so any file system that Spark
knows will do, and a task that is run again replaces its files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomhouse.llm import words as W
from loomhouse.llm.shared import map_arrow, new_path, prepare

MAGIC, VERSION, END_MARK = b"LHPF", 2, b"\n"
BLOCK = 256
PERCENTILE = 0.9
HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("partition", "<u4"), ("chunk", "<u4"), ("before", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("blocks", "<u8")])
_OF_BLOCK = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.uint64(1) << np.arange(33, dtype=np.uint64), x.astype(np.uint64), "right")


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(offset of each block, blocks) of ids below 2^32."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.empty(0, "<u8"), b""
    filled = np.full(n * BLOCK, ids[(n - 1) * BLOCK :].min(), np.uint32)
    filled[: len(ids)] = ids
    rows = filled.reshape(n, BLOCK)
    least = rows.min(1)
    rows = rows - least[:, None]
    width = _bit_length(np.partition(rows, int(BLOCK * PERCENTILE) - 1, axis=1)[:, int(BLOCK * PERCENTILE) - 1])
    patched = _bit_length(rows.ravel()).reshape(n, BLOCK) > width[:, None]
    count = patched.sum(1)
    head = np.zeros(n, _OF_BLOCK)
    head["least"], head["width"], head["exceptions"] = least, width, count
    length = _OF_BLOCK.itemsize + BLOCK // 8 * width + 5 * count
    at = np.concatenate(([0], np.cumsum(length)))
    out = np.zeros(at[-1], np.uint8)
    out[(at[:-1, None] + np.arange(_OF_BLOCK.itemsize))] = head.view(np.uint8).reshape(n, -1)
    values = np.where(patched, 0, rows).astype("<u4")
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            for some in np.array_split(mine, max(1, len(mine) // 2048)):
                bits = np.unpackbits(values[some].view(np.uint8).reshape(len(some), BLOCK, 4), axis=2, count=int(w), bitorder="little")
                out[at[some, None] + _OF_BLOCK.itemsize + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
    block, place = np.nonzero(patched)
    nth = W.ragged(count)
    first = at[block] + _OF_BLOCK.itemsize + BLOCK // 8 * width[block]
    out[first + nth] = place
    out[(first + count[block] + 4 * nth)[:, None] + np.arange(4)] = rows[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return at[:-1].astype("<u8"), out.tobytes()


def decode_blocks(at: np.ndarray, blocks: np.ndarray, count: int) -> np.ndarray:
    """The ids of blocks (bytes) that start at the offsets ``at``; any selection of whole blocks can be decoded."""
    n, at = len(at), at.astype(np.int64)
    if not n:
        return np.empty(0, np.uint32)
    head = blocks[at[:, None] + np.arange(_OF_BLOCK.itemsize)].copy().view(_OF_BLOCK).ravel()
    width, exceptions = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    rows = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            for some in np.array_split(mine, max(1, len(mine) // 2048)):
                packed = blocks[at[some, None] + _OF_BLOCK.itemsize + np.arange(BLOCK // 8 * w)]
                bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), BLOCK, w)
                whole = np.zeros((len(some), BLOCK, 4), np.uint8)
                lanes = np.packbits(bits, axis=2, bitorder="little")
                whole[:, :, : lanes.shape[2]] = lanes
                rows[some] = whole.view("<u4")[:, :, 0]
    block = np.repeat(np.arange(n), exceptions)
    nth = W.ragged(exceptions)
    first = at[block] + _OF_BLOCK.itemsize + BLOCK // 8 * width[block]
    rows[block, blocks[first + nth]] = blocks[(first + exceptions[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    return (rows + head["least"][:, None]).ravel()[:count]


def shard(partition: int, chunk: int, before: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    at, blocks = encode_blocks(ids)
    head = np.array([(MAGIC, VERSION, partition, chunk, before, len(doc_ids), len(ids), len(at))], HEAD)
    null = np.array([x is None for x in doc_ids], np.uint8)
    known = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join((head.tobytes(), known.tobytes(), null.tobytes(), lengths.astype("<u4").tobytes(), at.tobytes(), blocks))


def read_shard(data: bytes) -> tuple[np.void, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, document ids, whether null, lengths, ids)."""
    head = np.frombuffer(data, HEAD, 1)[0]
    if head["magic"] != MAGIC or head["version"] != VERSION or bytes(data[-1:]) != END_MARK:
        raise ValueError("not a shard of token ids")
    at, parts = HEAD.itemsize, []
    for kind, n in (("<i8", head["docs"]), ("u1", head["docs"]), ("<u4", head["docs"]), ("<u8", head["blocks"])):
        parts.append(np.frombuffer(data, kind, int(n), at))
        at += parts[-1].nbytes
    return head, *parts[:3], decode_blocks(parts[3], np.frombuffer(data, np.uint8, offset=at), int(head["ids"]))


class Table:
    """Places of 64-bit keys: open addressing in arrays, asked and filled many keys at a time."""

    def __init__(self, most: int):
        self.mask = np.uint64((1 << (2 * most - 1).bit_length()) - 1)
        self.place = np.full(int(self.mask) + 1, -1, np.int32)
        self.key = np.zeros(int(self.mask) + 1, np.uint64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where it is new."""
        out = np.full(len(keys), -1, np.int32)
        open_, slot = np.arange(len(keys)), keys & self.mask
        while len(open_):
            here = self.place[slot]
            same = self.key[slot] == keys[open_]
            same &= here >= 0
            out[open_[same]] = here[same]
            on = (here >= 0) & ~same
            open_, slot = open_[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Distinct new keys."""
        slot = keys & self.mask
        while len(keys):
            free = np.flatnonzero(self.place[slot] < 0)
            self.place[slot[free]] = places[free]
            mine = np.zeros(len(keys), bool)
            mine[free] = self.place[slot[free]] == places[free]
            self.key[slot[mine]] = keys[mine]
            keys, places, slot = keys[~mine], places[~mine], (slot[~mine] + np.uint64(1)) & self.mask


class Kept:
    """Runs of ids, laid end to end, by place."""

    def __init__(self):
        self.n = self.used = 0
        self.start, self.length, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.empty(1 << 14, np.uint32)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.n + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[self.n : self.n + len(lengths)] = lengths
        self.start[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.used, self.n = self.used + len(ids), self.n + len(lengths)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the runs at these places one after the other, the length of each)."""
        lengths = self.length[at].astype(np.int64)
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


def by_words(tokenizer) -> str | None:
    """The pattern of the pieces, if a tokenizer parts texts at white space and drops it, so that a text's ids are its words' ids; else None.

    Asked for: texts are composed, lower-cased and split by one pattern at most; pieces end in a suffix of their own; nothing is added around a text.
    """
    spec = json.loads(tokenizer.to_str())
    of = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    normal, parts, model = of(spec["normalizer"], "normalizers"), of(spec["pre_tokenizer"], "pretokenizers"), spec["model"]
    plain = all(x["type"] in ("NFC", "Lowercase") or (x["type"], x.get("pattern"), x.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for x in normal)
    if not plain or not any(x["type"] == "Lowercase" for x in normal) or spec["post_processor"] or model["type"] != "BPE" or model.get("dropout") or not model["end_of_word_suffix"]:
        return None
    if [x["type"] for x in parts] != ["Split", "ByteLevel"] or (parts[0]["behavior"], parts[0]["invert"]) != ("Removed", True) or parts[1]["add_prefix_space"] or parts[1]["use_regex"]:
        return None
    if any(tokenizer.pre_tokenizer.pre_tokenize_str(c) or len(tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}.")) != 2 for c in " \t\n\x0b\x0c\r"):
        return None
    return parts[0]["pattern"].get("Regex")


class Encoder:
    """Ids of texts by the tokenizers library.

    Where a text's ids are its words' ids (``by_words``), each word is encoded once and its ids are kept by its 64-bit key, up to ``most`` words; then the memory
    starts anew. New words of plain characters are cut into pieces, and new pieces encoded many at a time; other words are encoded one by one. ``CHECKED``
    texts are held against the library's own ids of the whole text. Any other tokenizer encodes whole texts.
    """

    CHECKED = 20
    PLAIN = re.compile(r"[\x20-\x7e\u00a1-\u00ff]*")

    def __init__(self, path: str, most: int = 1 << 19):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.most, self.unchecked = Tokenizer.from_file(path), most, self.CHECKED
        pattern = by_words(self.tokenizer)
        self.pattern = regex.compile(pattern) if pattern else None
        if self.pattern:
            self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
            suffix = self.tokenizer.model.end_of_word_suffix
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
            self.joined = Tokenizer.from_file(path)  # takes pieces of plain characters, joined by spaces
            self.joined.normalizer = None
            self.joined.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.clear()

    def clear(self) -> None:
        self.table, self.kept = Table(self.most), Kept()
        self.place: dict[str, int] = {}
        self.pieces = Kept()

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after the other, the number of each), a text at a time."""
        got = [x.ids for i in range(0, len(texts), 1024) for x in self.tokenizer.encode_batch_fast(texts[i : i + 1024], add_special_tokens=False)]
        return np.array([i for one in got for i in one], np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > self.most // 4:
            self.place, self.pieces = {}, Kept()
        new = [*dict.fromkeys(p for p in pieces if p not in self.place)]
        n = self.pieces.n
        for i in range(0, len(new), 1 << 14):
            some = new[i : i + (1 << 14)]
            got = [x.ids for x in self.joined.encode_batch_fast([" ".join(some[k : k + 64]) for k in range(0, len(some), 64)], add_special_tokens=False)]
            ids = np.array([i for one in got for i in one], np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not end each piece in one suffix")
            self.pieces.add(ids, np.diff(ends, prepend=0))
        self.place.update(zip(new, range(n, n + len(new)), strict=True))
        return self.pieces.of(np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces)))

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        together = " ".join(words)
        if self.PLAIN.fullmatch(together) and not any(a in together for a in self.added):
            plain = np.ones(len(words), bool)
        else:
            plain = np.array([self.PLAIN.fullmatch(x) is not None and not any(a in x for a in self.added) for x in words], bool)
        at = np.flatnonzero(plain)
        lower = (together if plain.all() else " ".join([words[i] for i in at.tolist()])).lower()
        pieces = self.pattern.findall(lower)
        size = np.fromiter(map(len, lower.split(" ")), np.int64) if len(at) else np.empty(0, np.int64)
        long = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if long.sum() != size.sum():  # some characters are in no piece
            plain[:], at, pieces, size, long = False, at[:0], [], size[:0], long[:0]
        owner = np.searchsorted(np.cumsum(size), np.cumsum(long) - long, "right")
        ids, n = self.of_pieces(pieces)
        first = self.kept.n
        self.kept.add(ids, np.bincount(owner, n, len(at)).astype(np.int64))
        rest = np.flatnonzero(~plain)
        self.kept.add(*self.whole([words[i] for i in rest.tolist()]))
        self.table.add(keys[np.concatenate((at, rest))], np.arange(first, self.kept.n, dtype=np.int32))

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts ``data[bounds[i]:bounds[i + 1]]`` one after the other, the number of each)."""
        view = memoryview(data)
        texts = lambda n: [str(view[a:b], "utf-8") for a, b in zip(bounds[:n].tolist(), bounds[1 : n + 1].tolist(), strict=True)]
        if not self.pattern:
            return self.whole(texts(len(bounds) - 1))
        w = W.split(data, bounds)
        at = self.table.find(w.key)
        new = np.flatnonzero(at < 0)
        if len(new):
            keys, first = np.unique(w.key[new], return_index=True)
            if self.kept.n + len(keys) > self.most:
                self.clear()
                new = np.arange(len(w.key))
                keys, first = np.unique(w.key, return_index=True)
                self.table = Table(max(self.most, len(keys)))
            words = [str(view[a:b], "utf-8") for a, b in zip(w.start[new[first]].tolist(), w.end[new[first]].tolist(), strict=True)]
            self.learn(keys, words)
            at[new] = self.table.find(w.key[new])
        ids, lengths = self.kept.of(at)
        total = np.concatenate(([0], np.cumsum(lengths)))[w.first]
        n = min(self.unchecked, len(bounds) - 1)
        if n:
            self.unchecked -= n
            if self.whole(texts(n))[0].tolist() != ids[: total[n]].tolist():
                raise ValueError("the tokenizer's ids of a text are not those of its words")
        return ids, np.diff(total)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker, which later tasks use again."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _shards(tokenizer: str, end: int, ids_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, partition = encoder_of(tokenizer), TaskContext.get().partitionId()
        chunk = before = held = 0
        doc_ids, lengths, ids = [], [], []

        def out() -> pa.RecordBatch:
            data = shard(partition, chunk, before, doc_ids, np.concatenate(lengths), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])

        for b in batches:
            for lo, hi, data, bounds in W.texts(b.column(1)):
                found, n = encoder.encode(data, bounds)
                ids.append(np.insert(found, np.cumsum(n), np.uint32(end)))
                lengths.append(n + 1)
                doc_ids += b.column(0).slice(lo, hi - lo).to_pylist()
                held += len(ids[-1])
                if held >= ids_each:
                    yield out()
                    chunk, before, held = chunk + 1, before + held, 0
                    doc_ids, lengths, ids = [], [], []
        if ids:
            yield out()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", ids_each: int = 2 << 20) -> None:
    """Write the ids of every whole text (null: empty), each followed by ``end``, to shards of about ``ids_each`` ids under ``path``.

    A very long text is in one shard whole, which is then larger. Other columns of ``docs`` are not read, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ordered = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", F.xxhash64("text"))
    files = map_arrow(ordered, _shards(tokenizer, end, ids_each), "file binary")
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        heads = np.frombuffer(b"".join(b.column(0).to_pylist()), HEAD)
        yield pa.RecordBatch.from_arrays([pa.array(heads[k].astype(np.int64)) for k in ("partition", "ids")], names=["partition", "ids"])


def _documents(starts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                head, doc_ids, null, lengths, ids = read_shard(content.as_buffer())
                start = starts.value[int(head["partition"])] + int(head["before"])
                ends = np.cumsum(lengths, dtype=np.int64)
                first = ends - lengths
                ids = ids.astype("<u4")
                for i in range(0, len(doc_ids), 2048):
                    here = slice(i, i + 2048)
                    parts = [ids[a:z] for a, z in zip(first[here].tolist(), ends[here].tolist(), strict=True)]
                    values = ids[first[i] : ends[here][-1]].view(np.int32)
                    offsets = np.append(first[here], ends[here][-1]) - first[i]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids[here], mask=null[here].astype(bool)),
                            pa.array(first[here] + start),
                            pa.array(lengths[here].astype(np.int64)),
                            pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    return run


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the documents in the shards under ``path``; an empty folder gives no rows.

    Only headers go to Python before the documents do, and the driver gets a number for each partition of the writer, however many shards there are.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    heads = map_arrow(files.select(F.substring("content", 1, HEAD.itemsize).alias("head")), _heads, "partition long, ids long")
    total, starts = 0, {}
    for partition, n in sorted(tuple(r) for r in heads.groupBy("partition").agg(F.sum("ids")).collect()):
        starts[partition] = total
        total += n
    return map_arrow(files, _documents(spark.sparkContext.broadcast(starts)), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def tokens_of(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Write the shards in the shared folder and read them back. Null and empty texts have the end id alone; an empty table has no rows."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(spark, path)
