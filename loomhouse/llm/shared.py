"""What the corpus operators share: the cluster's shared folder, written tables and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomhouse.session import shared_path as new_path

ROOT = str(Path(__file__).resolve().parents[2])
#: ASCII white space, as a character class of Java's and of RE2's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: whole texts are sent, and Spark's own 10,000 of them take tens of MB in the JVM and again in the worker.
ROWS, ROWS_EACH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where the driver found it, and send them texts in small batches unless the session sets a size."""
    if spark.conf.get(ROWS, None) is None:
        spark.conf.set(ROWS, str(ROWS_EACH))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, and safe when executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_below(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has ``max_rows`` rows at most, else unhinted, so that a shuffled join takes it.

    ``df`` should be a written table or cheap, since its rows are counted.
    """
    return F.broadcast(df) if len(df.limit(max_rows + 1).select(F.lit(1)).toArrow()) <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: Column, buckets: int) -> Column:
    """The remainder of the CRC-32 of a key's text; a null key has remainder -1, which no rule names."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % buckets, F.lit(-1))


def _given_back(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow``; workers, which later tasks use again, give the memory that a task has freed back to the system."""
    prepare(df.sparkSession)
    return df.mapInArrow(_given_back(function), schema)
