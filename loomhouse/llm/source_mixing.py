"""Mixing sources to target weights.

Words are added up for each source; weights share out a total, no source getting more than ``most`` times its size, the excess going to
the others by weight. A source's rate is its target over its size: each document comes floor(rate) times, and once more when a number
drawn from its hash is below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomhouse.llm.shared import WORD, broadcast_below, written

WEIGHTS = (5, 2, 1)


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(ident: Column, seed: str) -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of the seed and the id, as any engine computes it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources come by code point, null last, and take ``weights`` in turn. Ranks come from a range sort and the counts of its partitions, so
    no task sees all sources.
    """
    spark = sizes.sparkSession
    ordered = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    placed = written(ordered.select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "sources")
    before, offsets = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row for each partition of the sort
        offsets.append((r["part"], before))
        before += r["count"]
    offset = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("at") + F.col("before"), F.lit(len(weights))) + 1).cast("int"))
    weighed = placed.join(offset, "part").select("source", "source_size", weight.cast("long").alias("weight"))

    up, down = share
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    excess, free, capped = None, None, -1
    while True:
        above = F.lit(False) if free is None else whole("weight") * F.lit(excess).cast("decimal(20,0)") > whole("source_size") * F.lit(most * down * free).cast("decimal(18,0)")
        got = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("source_size"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("free"), F.count(F.when(above, 1)).alias("n")
        ).first()
        if got["n"] == capped:
            break
        capped, excess, free = got["n"], up * (got["all"] or 0) - most * down * (got["held"] or 0), got["free"] or 0
    level = excess / (down * free) if free else 0.0
    target = F.when(above, F.col("source_size") * float(most)).otherwise(F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix", keep_text: bool = True, max_broadcast_rows: int = 100_000) -> DataFrame:
    """``docs``, without the text unless ``keep_text``, with size, source_size, target and copies.

    size: the text's words (null: 0). copies: floor(target / source_size), and 1 more where the id's draw is below the fraction; 0 for a source
    without words. Rows with the same id draw alike. A null source is a source; a null id draws as an empty one. Columns named as new ones are replaced.
    """
    new = ("size", "source_size", "target", "copies")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new and (keep_text or c != text_col)]
    sized = docs.select(*kept, count_words(F.col(f"`{text_col}`")).alias("size"))
    if not keep_text:
        sized = written(sized, "sized")  # so that words are counted once
    targets = written(source_targets(sized.select(F.col(f"`{source_col}`").alias("source"), "size"), weights, share, most).withColumnRenamed("source", "__source"), "targets")
    targets = broadcast_below(targets, max_broadcast_rows)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor("__rate") + (draw(F.col(f"`{id_col}`"), seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    return sized.join(targets, sized[source_col].eqNullSafe(targets["__source"])).withColumn("__rate", rate).select(*kept, "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    columns = docs.columns
    return plan_mix(docs, **options).filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
