"""Nightly snapshots as sets: all nights at once, whole copies, deltas against the last night captured, and the history of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomhouse.functions import numbered, row_digest

STATE = ("region", "country", "segment")
NIGHTS, FAILED = 30, (12,)


def nights(spark: SparkSession, captured_only: bool = False) -> DataFrame:
    spine = spark.range(1, NIGHTS + 1).select(F.col("id").cast("int").alias("night_number"))
    return spine.filter(~F.col("night_number").isin(*FAILED)) if captured_only else spine


def change_log(baseline: DataFrame, every: int = 13) -> DataFrame:
    """Every ``every``-th customer changes once, on one of the nights 2 to 30."""
    c = F.col("customer_id")
    pick = lambda remainder, *x: F.element_at(F.array(*map(F.lit, x)), remainder.cast("int") + 1)
    chosen = numbered(baseline, "customer_id", name="rn").filter(F.col("rn") % every == 0)
    return chosen.select(
        (F.col("rn") / every).cast("long").alias("change_id"),
        "customer_id",
        (F.pmod(c * 31 + 7, F.lit(NIGHTS - 1)) + 2).cast("int").alias("night_number"),
        pick(c % 4, "North", "South", "East", "West").alias("new_region"),
        pick(c % 3, "Finland", "Sweden", "Norway").alias("new_country"),
        F.when(c % 10 < 6, "Consumer").when(c % 10 < 9, "Business").otherwise("Enterprise").alias("new_segment"),
    )


def states(baseline: DataFrame, changes: DataFrame, of: DataFrame) -> DataFrame:
    """The state of every customer in each night of ``of`` (night_number): the last change up to it, else the baseline."""
    changed = changes.withColumnRenamed("night_number", "changed_on").join(of, F.col("changed_on") <= F.col("night_number"))
    last = changed.groupBy("night_number", "customer_id").agg(F.max_by(F.struct(*(f"new_{c}" for c in STATE)), F.struct("changed_on", "change_id")).alias("new"))
    every = baseline.crossJoin(F.broadcast(of))  # a night is a row; there are a bounded number
    return every.join(last, ["night_number", "customer_id"], "left").select("night_number", "customer_id", *(F.coalesce(f"new.new_{c}", c).alias(c) for c in STATE))


def deltas(captured: DataFrame) -> DataFrame:
    """Rows that differ from their customer's row in the last captured night before: a missed night's changes come with the next."""
    order = Window.partitionBy("customer_id").orderBy("night_number")
    return captured.withColumn("hash", row_digest(*STATE)).withColumn("before", F.lag("hash").over(order)).filter("hash <> before").drop("hash", "before")


def replayed(base: DataFrame, changes: DataFrame, night: int) -> DataFrame:
    """Base and the last delta up to a night."""
    last = changes.filter(F.col("night_number") <= night).groupBy("customer_id").agg(F.max_by(F.struct(*STATE), "night_number").alias("d"))
    return base.join(last, "customer_id", "left").select("customer_id", *(F.coalesce(f"d.{c}", c).alias(c) for c in STATE))


def job_history(spark: SparkSession, customers: DataFrame, delta: DataFrame) -> DataFrame:
    """A row for each run: 30 whole copies, then 29 increments. A failed run takes 5 s and does not move the checkpoint."""
    failed = F.col("night_number").isin(*FAILED)
    total = customers.agg(F.count(F.lit(1)).alias("all_rows"))
    whole = nights(spark).crossJoin(F.broadcast(total)).select("night_number", F.lit("periodic").alias("snapshot_type"), F.when(failed, 0).otherwise(F.col("all_rows")).alias("rows_processed"), F.lit(None).cast("int").alias("checkpoint_night"), F.col("night_number").alias("job_id"))
    counts = delta.groupBy("night_number").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.coalesce(F.max(F.when(~failed, F.col("night_number"))).over(Window.orderBy("night_number").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))  # over 29 rows
    step = nights(spark).filter("night_number > 1").join(counts, "night_number", "left").select(
        "night_number", F.lit("incremental").alias("snapshot_type"), F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).alias("rows_processed"), so_far.alias("checkpoint_night"), (F.col("night_number") + NIGHTS - 1).alias("job_id")
    )
    runs = whole.unionByName(step).withColumn("status", F.when(failed, "failed").otherwise("success"))
    seconds = F.when(failed, 5).otherwise(30 + F.call_function("div", F.col("rows_processed"), F.lit(50).cast("long")))
    start = F.expr("timestamp_ntz'2024-01-01 02:00:00'") + F.make_dt_interval(F.col("night_number") - 1)
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    columns = ("job_id", "night_number", "snapshot_type", "status", F.col("rows_processed").cast("long").alias("rows_processed"), "checkpoint_night")
    return runs.select(*columns, start.alias("started_at"), end.alias("finished_at"))


def upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the source's rows in place of those with the same keys. Keys must be unique in the source, so that a retry changes nothing."""
    return target.join(source, keys, "left_anti").unionByName(source)


def changed_rows(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of ``now`` whose digest differs from that of the same customer before."""
    old = before.select("customer_id", row_digest(*STATE).alias("old"))
    return now.join(old, "customer_id").filter(row_digest(*STATE) != F.col("old")).drop("old")


def all_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(customer_id, change_type, attributes): customers that are new, have changed or are gone; the attributes are the new ones, of those gone the last ones."""
    old = before.select(F.col("customer_id").alias("old_id"), row_digest(*STATE).alias("old"), *(F.col(c).alias(f"old_{c}") for c in STATE))
    joined = now.withColumn("new", row_digest(*STATE)).join(old, F.col("customer_id") == F.col("old_id"), "full_outer").filter(~F.col("new").eqNullSafe(F.col("old")))
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    gone = F.col("new").isNull()
    return joined.select(F.coalesce("customer_id", "old_id").alias("customer_id"), kind.alias("change_type"), *(F.when(gone, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in STATE))
