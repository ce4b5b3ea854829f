"""Connected components by alternating stars, every step a join in Spark and a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomhouse.llm.shared import new_path
from loomhouse.session import delete

SCHEMA = "u long, v long"


def _saved(df: DataFrame) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, "stars")
    df.write.parquet(path)
    return df.sparkSession.read.schema(SCHEMA).parquet(path), path


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them: the larger ones (``both``: edges in both directions) or the smaller ones."""
    of = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = of.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = of.join(least, "u")
    if both:
        return linked.filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
    return linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v: long), but for the roots themselves; a root is the least node of its component.

    An edge goes from its larger to its smaller end. A large star links a node's larger neighbours to its least neighbour, a small star
    its smaller ones; both keep components whole, and alternating them ends in one star for each component, after about log^2 n rounds at most.
    """
    spark = edges.sparkSession
    larger = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = _saved(larger)
    sign = None
    while True:
        seen = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
        if seen == sign or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = seen
        large, middle = _saved(_star(now, both=True))
        delete(spark, path)
        now, path = _saved(_star(large, both=False))
        delete(spark, middle)
