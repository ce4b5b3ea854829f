"""WARC archives and a Merkle audit of two replicas of them.

Leaves of a tree are the records' digests, each with its offset and length; a node of level k covers an offset range of
``2^(range_bits + fan_bits * (k - 1))`` bytes and hashes its children in order of their offsets. Equal roots end the audit of an archive. Where
roots differ, only children of differing nodes are read, level by level, down to the records.

Only digests are shuffled, never contents, and every node hashes a bounded number of children: records in one range of bytes, or
``2^fan_bits`` nodes. Records are bytes: payloads need not be text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomhouse.llm.shared import map_arrow, prepare, written

CRLF = "\r\n"
BEGIN = b"WARC/1.1\r\n"
PLACE = ("archive", "offset", "length", "record")


def record_of(uri: Column, payload: Column, ident: Column) -> Column:
    """The bytes of a WARC/1.1 resource record of a payload (text or bytes; null is empty)."""
    body = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:loomhouse:"),
        F.coalesce(ident.cast("string"), F.lit("none")),
        F.lit(f">{CRLF}WARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF * 2),
    )
    return F.concat(head.cast("binary"), body, F.lit(CRLF * 2).cast("binary"))


def _lay(records_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, end = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            length = pc.binary_length(b.column("record")).cast(pa.int64()).to_numpy()
            nth = n + np.arange(len(length))
            total = end + np.cumsum(length)
            # what lies before the archive that a record is in; ``end`` is where the last record of the batch before ends in its archive
            before = np.maximum.accumulate(np.where(nth % records_each == 0, total - length, 0))
            n, end = n + len(nth), int(total[-1] - before[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + nth // records_each), pa.array(total - length - before), pa.array(length)], names=[*b.schema.names, "archive", "offset", "length"])

    return run


def archived(pages: DataFrame, ident: str = "page_id", uri: str = "url", payload: str = "html", records_each: int = 256) -> DataFrame:
    """(archive, offset, length, record and the other columns) of pages laid into archives of at most ``records_each`` records.

    Pages stay where they are read: an archive holds consecutive rows of one partition, so nothing is shuffled, and repeated rows, which
    are records of their own, spread like all others. Write the result before it is read more than once. Null ids, addresses and payloads, empty
    and very long payloads are records too; an empty table has no rows. Columns named archive, offset, length or record are replaced.
    """
    prepare(pages.sparkSession)
    kept = [c for c in pages.columns if c not in PLACE]
    names = [f"c{i}" for i in range(len(kept))]
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    read = pages.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(kept, names, strict=True)), record_of(F.col(f"`{uri}`"), F.col(f"`{payload}`"), F.col(f"`{ident}`")).alias("record"))
    schema = ", ".join([*(f"{x} {types[c]}" for c, x in zip(kept, names, strict=True)), "record binary, archive long, offset long, length long"])
    return map_arrow(read, _lay(records_each), schema).select(*PLACE, *(F.col(x).alias(c) for c, x in zip(kept, names, strict=True)))


def write_archives(records: DataFrame, path: str) -> None:
    """Write each archive's records in order of their offsets to a file of its own, in folders archive=N under ``path``.

    A file's bytes are its records' bytes: Spark's text writer sets the line feed that ends a record. Records without archive or offset have no place and are refused.
    """
    record = F.when(F.col("archive").isNull() | F.col("offset").isNull(), F.raise_error(F.lit("a record without archive or offset"))).otherwise(F.col("record"))
    body = F.substring(record, F.lit(1), F.octet_length("record") - 1).cast("string").alias("file")
    records.filter("record is not null").select("archive", "offset", body).repartition("archive").sortWithinPartitions("archive", "offset").select("archive", "file").write.partitionBy("archive").option("compression", "none").text(path)


def split_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records of an archive. Where a header is damaged, the record goes on to the next one that begins."""
    at = 0
    while at < len(data):
        end, to = data.find(b"\r\n\r\n", at), -1
        if data.startswith(BEGIN, at) and end >= 0:
            fields = dict(x.split(b":", 1) for x in data[at:end].split(b"\r\n") if b":" in x)
            size = fields.get(b"Content-Length", b"").strip()
            if size.isdigit() and data[end + 4 + int(size) : end + 8 + int(size)] == b"\r\n\r\n":
                to = end + 8 + int(size)
        if to < 0:
            to = data.find(BEGIN, at + 1)
            to = to if to > 0 else len(data)
        yield at, data[at:to]
        at = to


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for archive, content in zip(b.column("archive").to_pylist(), b.column("content"), strict=True):
            got = [*split_records(content.as_py())]
            if got:
                columns = [[archive] * len(got), [x for x, _ in got], [len(x) for _, x in got]]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array([x for _, x in got], pa.binary())], names=[*PLACE])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, length, record) of the archives in folders archive=N under ``path``; an empty folder gives no rows."""
    prepare(spark)
    schema = "archive long, offset long, length long, record binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "archive" not in files.columns:
        return spark.createDataFrame([], schema)
    return map_arrow(files.select("archive", "content"), _records, schema)


def leaves(records: DataFrame) -> DataFrame:
    """(archive, offset, length, digest, n) of records (archive, offset, record): how often each comes; a null record counts as an empty one."""
    record = F.coalesce(F.col("record").cast("binary"), F.lit("").cast("binary"))
    each = records.select(F.col("archive").cast("long").alias("archive"), F.col("offset").cast("long").alias("offset"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    return each.groupBy("archive", "offset", "length", "digest").agg(F.count(F.lit(1)).alias("n"))


def _level(nodes: DataFrame, bits: int) -> DataFrame:
    """Parents that cover 2^``bits`` units of their children's offsets: (archive, at, digest)."""
    children = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["digest"]))
    return nodes.groupBy("archive", F.shiftright("at", bits).alias("up")).agg(F.sha2(F.concat_ws(",", children), 256).alias("digest")).select("archive", F.col("up").alias("at"), "digest")


def tree(leaf: DataFrame, height: int, range_bits: int = 14, fan_bits: int = 4) -> list[DataFrame]:
    """Levels from offset ranges up to one root an archive, of leaves that have an archive and an offset. Records with equal offsets are ordered by digest."""
    first = leaf.select("archive", F.col("offset").alias("at"), F.concat_ws("/", F.col("length").cast("string"), "digest", F.col("n").cast("string")).alias("digest"))
    levels = [written(_level(first, range_bits), "merkle")]
    for _ in range(height - 1):
        levels.append(written(_level(levels[-1], fan_bits), "merkle"))
    return levels


def audit(ours: DataFrame, theirs: DataFrame, range_bits: int = 14, fan_bits: int = 4) -> DataFrame:
    """(archive, offset, state, length, digest, other_length, other_digest): the records in which two replicas differ.

    Each replica has rows (archive, offset, record); other columns are not read. state is ``corrupt`` where both have other bytes at an offset, ``missing`` where
    only the first has a record there and ``extra`` where only the second has. Records repeated at one offset are compared as often as they occur. Equal
    replicas and empty ones give no rows. Records with a null archive or offset have no place in a tree: they are compared with each other by
    archive, offset and digest, null being a value of its own.
    """
    sides = [written(leaves(x), "leaves") for x in (ours, theirs)]
    placed = [x.filter("archive is not null and offset is not null") for x in sides]
    end = max(0, *(x.agg(F.max("offset")).first()[0] or 0 for x in placed))
    height = 1
    while end >> (range_bits + fan_bits * (height - 1)):
        height += 1
    trees = [tree(x, height, range_bits, fan_bits) for x in placed]
    open_ = None
    for level in range(height - 1, -1, -1):
        a, b = (t[level] for t in trees)
        if open_ is not None:
            parent = F.shiftright("at", fan_bits)
            a, b = (x.join(open_, (x["archive"] == open_["up_archive"]) & (parent == open_["up_at"]), "left_semi") for x in (a, b))
        a, b = a.withColumnRenamed("digest", "a"), b.withColumnRenamed("digest", "b")
        differ = a.join(b, ["archive", "at"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        open_ = written(differ.select(F.col("archive").alias("up_archive"), F.col("at").alias("up_at")), "differ")
    found = []
    for x, here in zip(sides, placed, strict=True):
        within = here.join(open_, (here["archive"] == open_["up_archive"]) & (F.shiftright("offset", range_bits) == open_["up_at"]), "left_semi")
        found.append(within.unionByName(x.filter("archive is null or offset is null")))
    a, b = found[0], found[1].toDF("b_archive", "b_offset", "other_length", "other_digest", "other_n")
    at = F.col("archive").eqNullSafe(F.col("b_archive")) & F.col("offset").eqNullSafe(F.col("b_offset"))
    same = at & (F.col("digest") == F.col("other_digest")) & (F.col("n") == F.col("other_n"))
    both = a.join(b, same, "left_anti").join(b.join(a, same, "left_anti"), at, "full_outer")
    state = F.when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    there = lambda x: F.when(F.col("digest").isNull(), F.col(f"b_{x}")).otherwise(F.col(x)).alias(x)
    return both.select(there("archive"), there("offset"), state.alias("state"), "length", "digest", "other_length", "other_digest")
