"""The nightly snapshot job as a stream: each night is a micro-batch, and a failed night leaves the checkpoint where it was.

A nightly job polls its source. Here nights are files that arrive; ``availableNow`` takes what is new, one file a batch, and
``foreachBatch`` holds it against the last state captured. The job history stays data in a table of its own: it says which state can be
trusted, while the stream's checkpoint says which files were read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomhouse.operators.snapshots import STATE, all_changes


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and their values by day and type; later than ``late`` they no longer count. Works on batches and streams alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("day"), "event_type", "events", "value")


def run_nightly(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, failed: tuple[int, ...] = ()) -> None:
    """Take the nights (night_number, customer_id and attributes) that have come to ``source`` and write deltas and jobs under ``target``.

    Every night is held against the tracking state, the customers of the last night captured, which is a table of its own: no night reads what came before that. New
    customers are inserts, customers that a night lacks are deletes. A batch overwrites its own nights, so that one run again leaves the same rows. A night in
    ``failed`` logs a failure and captures nothing; its changes come with the next night that succeeds.
    """

    def capture(batch: DataFrame, number: int) -> None:
        nights = sorted(r[0] for r in batch.select("night_number").distinct().collect())  # a batch holds one file's nights
        for night in nights:
            if night in failed:
                _log(spark, target, night, "failed", 0)
                continue
            rows = batch.filter(F.col("night_number") == night).select("customer_id", *STATE)
            last = max((n for n in _nights(spark, f"{target}/state") if n < night), default=None)
            before = spark.read.schema(rows.schema).parquet(f"{target}/state/batch={last}") if last is not None else rows.limit(0)
            new = all_changes(rows, before).select(F.lit(night).alias("night_number"), "change_type", "customer_id", *STATE)
            new.write.mode("overwrite").parquet(f"{target}/captured/batch={night}")
            rows.write.mode("overwrite").parquet(f"{target}/state/batch={night}")
            _log(spark, target, night, "success", spark.read.parquet(f"{target}/captured/batch={night}").count())

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(capture).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _nights(spark: SparkSession, path: str) -> list[int]:
    """The nights whose folders are whole: a writer marks them when it has ended."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")) or []
    return [int(x.getPath().getParent().getName().split("=")[1]) for x in found]


def _log(spark: SparkSession, target: str, night: int, status: str, rows: int) -> None:
    spark.createDataFrame([(night, status, rows)], "night_number int, status string, rows_processed long").write.mode("overwrite").parquet(f"{target}/jobs/batch={night}")
