"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing and token output, each stage on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Each result is
written as Parquet in the shared folder and reread as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomhouse.llm.decontamination import find_leaks
from loomhouse.llm.language_id import UNKNOWN, identify
from loomhouse.llm.shared import broadcast_below, bucket_of, new_path, table, written
from loomhouse.llm.simhash_golay import near_groups
from loomhouse.llm.source_mixing import mixed
from loomhouse.llm.token_output import tokens_of
from loomhouse.session import cleared, delete

#: A document whose most probable language has a smaller mean probability is in none of the languages.
LEAST_SCORE = 0.4
#: Keys of dropped documents are broadcast up to so many (24 bytes each); beyond, the join is shuffled.
MOST_BROADCAST = 500_000


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns named anew, so that none of the documents' own meets one that an operator adds; and the names."""
    names = {c: f"doc{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(x).alias(c) for c, x in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null, empty and blank texts among them), and those in no known language, go; the others stay.

    Learnt from all rows whose id is not held out. Repeated rows stay or go alike; a table without labelled rows teaches nothing, and all goes. An empty one stays empty.
    """
    rows, c = plain(docs)
    named = identify(rows, bucket_of(F.col(c["doc_id"]), 5) != 0, c["text"], c["lang"], c["doc_id"], keep_text=True)
    return back(named.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)), c)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, null ids last; of rows equal in id and text one stays.

    Texts without words, null ones included, are one group. An empty table stays empty.
    """
    rows, c = plain(docs)
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = near_groups(numbered.select(F.col(c["doc_id"]).alias("doc_id"), F.col(c["text"]).alias("text"), "row"))
    dropped = written(groups.filter("not kept").select("row"), "dropped")
    return back(numbered.join(broadcast_below(dropped, MOST_BROADCAST), "row", "left_anti"), c)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: all rows with the id and the text of one that does.

    Null and empty texts hold none, and stay; a null id is a value like others. Without benchmark items all rows stay.
    """
    rows, c = plain(docs)
    hashed = F.xxhash64(F.coalesce(F.col(c["text"]), F.lit("")))
    leaks = find_leaks(rows.select(F.col(c["doc_id"]).alias("doc_id"), hashed.alias("hash"), F.col(c["text"]).alias("text")), table(spark, sf_dir, "benchmark"))
    dropped = broadcast_below(written(leaks.select(F.col("doc_id").alias("leak_id"), F.col("hash").alias("leak_hash")).distinct(), "dropped"), MOST_BROADCAST)
    same = F.col(c["doc_id"]).eqNullSafe(F.col("leak_id")) & (F.col("hash") == F.col("leak_hash"))
    return back(rows.withColumn("hash", hashed).join(dropped, same, "left_anti"), c)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; a null source is a source. Rows with the same id draw alike; texts without words come as their source's others do."""
    rows, c = plain(docs)
    return back(mixed(rows, id_col=c["doc_id"], source_col=c["source"], text_col=c["text"]), c)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards; what the shards hold of each document, repeated ones included. A null or empty text has the end id alone."""
    return tokens_of(docs.select("doc_id", "text")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_output", token_output),
]
#: No SQL: language ID, SimHash over Golay keys, decontamination and the tokenizer are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other. What a stage leaves in the shared folder goes when its result is written, and that when the next one's is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with cleared(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
