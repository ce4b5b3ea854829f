"""Exact deduplication by two passes over a Bloom filter.

Pass one notes a few positions of a bit field for each text's digest. Every task sends the positions that its rows note, as sorted and compressed
gaps of two bytes or so each, and those that several of its rows note; merging carries a position that two tasks note over to the field of positions noted
twice. Pass two tests every row against that field: where one of its positions was noted once only, no other row has its digest, and it passes straight
through. The other rows, all repeated ones and a few chance hits, are shuffled and grouped by their full digests.

The field grows with the rows, at ``bits_each`` bits a row, and is cut into sections by a hash of the digest. A task merges one section; pass two
takes a bounded number of sections at a time, each time only the rows of these, which are then written in folders of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomhouse.llm import bitfields
from loomhouse.llm.shared import SPACE, broadcast_below, map_arrow, new_path, prepare, written

def digest_of(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space as one space; a null text is an empty one."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def _note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's rows note, a few million rows at a time; a row that notes a position twice notes it once."""
    held, size = [], 0
    for b in batches:
        at = np.sort(np.stack([x.to_numpy() for x in b.columns[1:]]), axis=0)
        new = np.ones(at.shape, bool)
        new[1:] = at[1:] != at[:-1]
        held.append(bitfields.at(np.broadcast_to(b.column(0).to_numpy(), at.shape)[new], at[new]))
        size += b.num_rows
        if size >= 1 << 21:
            yield bitfields.noted(held)
            held, size = [], 0
    if held:
        yield bitfields.noted(held)


def _perhaps(sent):
    @F.pandas_udf("boolean")
    def perhaps(section: pd.Series, *at: pd.Series) -> pd.Series:
        found, of = np.zeros(len(section), bool), section.to_numpy()
        for s in np.unique(of):
            mine = np.flatnonzero(of == s)
            for x in at:
                mine = mine[bitfields.are_set(sent.value[s], x.to_numpy()[mine])]
            found[mine] = True
        return pd.Series(found)

    return perhaps


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_each: int = 16, hashes: int = 3, section_rows: int = 1 << 23, max_field_bytes: int = 64 << 20, max_broadcast_groups: int = 100_000
) -> DataFrame:
    """``docs`` without the text, with keep_id, group_size, kept and text_sha256.

    Of rows whose texts are equal but for the length and kind of ASCII white space, the one with the smallest id stays; a null id comes
    after all others, and of rows that tie in the id one stays. Empty and null texts are one group; texts of any length are read whole; an empty table has no rows. The
    field takes ``bits_each`` bits a row at every size, in sections of ``section_rows`` rows; ``max_field_bytes`` of it are broadcast at a time, or one section. Columns named as
    new ones are replaced; others stay.
    """
    spark = prepare(docs.sparkSession)
    new = ("keep_id", "group_size", "kept", "text_sha256")
    kept = [c for c in docs.columns if c not in (text_col, *new)]
    names = [f"c{i}" for i in range(len(kept))]
    rows = written(docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(kept, names, strict=True)), digest_of(F.col(f"`{text_col}`")).alias("sha"), F.monotonically_increasing_id().alias("row")), "digests")
    count = rows.count()
    sections = max(1, -(-count // section_rows))
    bits = max(1 << 10, bits_each * -(-count // sections))
    section = F.pmod(F.xxhash64("sha", F.lit(-1)), F.lit(sections)).cast("int").alias("section")
    places = [F.pmod(F.xxhash64("sha", F.lit(k)), F.lit(bits)).alias(f"p{k}") for k in range(hashes)]
    noted = map_arrow(rows.select(section, *places), _note, bitfields.NOTED_SPARK)
    fields = written(noted.groupBy("part").applyInArrow(bitfields.merged(bits), bitfields.FIELD_SPARK), "fields")

    each = max(1, max_field_bytes // (bits // 8 + 1))
    passes = -(-sections // each)
    numbered = rows.withColumn("section", section)
    if passes > 1:
        numbered = written(numbered.withColumn("pass", F.floor(F.col("section") / each).cast("int")), "digests", ("pass",))
    path = new_path(spark, "flagged")
    for k in range(passes):
        got = fields.filter(F.col("part").between(k * each, k * each + each - 1)).toArrow()
        sent = spark.sparkContext.broadcast({s: np.frombuffer(x, np.uint8) for s, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)})

        mine = numbered.filter(F.col("pass") == k) if passes > 1 else numbered
        mine.select(*names, "sha", "row", _perhaps(sent)("section", *places).alias("perhaps")).write.mode("append").parquet(path)
        sent.unpersist()

    flagged = spark.read.schema(rows.withColumn("perhaps", F.lit(True)).schema).parquet(path)
    ident = F.col(names[kept.index(id_col)])
    more = flagged.filter("perhaps")
    least = F.min(F.struct(ident.isNull().alias("none"), ident.alias("id"), F.col("row").alias("row")))
    # groups are stored, so that the join sees their size: it sends them to all rows, or splits the rows of a hot one
    groups = written(more.groupBy("sha").agg(least.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("sha", "of"), "groups")
    joined = more.join(broadcast_below(groups, max_broadcast_groups), F.col("sha") == F.col("of"), "left")
    alone = F.col("n").isNull()
    out = [*(F.col(x).alias(c) for c, x in zip(kept, names, strict=True))]
    many = joined.select(
        *out,
        F.when(alone, ident).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    once = flagged.filter("not perhaps").select(*out, ident.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return once.unionByName(many)
