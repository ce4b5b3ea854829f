"""Snapshots, checkpoints, retries, validation and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomhouse.functions import share
from loomhouse.operators import checks, history, snapshots
from loomhouse.plans.analytics import counts, union
from loomhouse.plans.warehouse import Warehouse

NIGHT, LATER = 12, 20


def n_rows() -> Column:
    return F.count(F.lit(1))

def ok() -> Column:
    return F.col("status") == "success"


def _of_night(w: Warehouse, night: int) -> DataFrame:
    one = w.spark.range(night, night + 1).select(F.col("id").cast("int").alias("night_number"))
    return snapshots.states(w.customer_baseline, w.change_log, one)


def n3_true_states(w: Warehouse) -> DataFrame:
    return snapshots.states(w.customer_baseline, w.change_log, snapshots.nights(w.spark))


def n8_tracking_state(w: Warehouse) -> DataFrame:
    """The state that the next increment is held against: that of the last captured night."""
    last = w.periodic_snapshots.agg(F.max("night_number").alias("night_number"))
    return w.periodic_snapshots.join(last, "night_number", "left_semi").drop("night_number")


def n10_storage(w: Warehouse) -> DataFrame:
    whole = w.periodic_snapshots.agg(n_rows().alias("periodic_rows"))
    step = w.incremental_base_snapshot.select("customer_id").unionByName(w.incremental_deltas.select("customer_id")).agg(n_rows().alias("incremental_rows"))
    return whole.crossJoin(step).withColumn("storage_ratio", share(F.col("periodic_rows"), F.col("incremental_rows")))


def c1_storage_rows(w: Warehouse) -> DataFrame:
    return counts({"periodic": w.periodic_snapshots, "incremental_base": w.incremental_base_snapshot, "incremental_deltas": w.incremental_deltas})


def c2_gaps(w: Warehouse) -> DataFrame:
    """Nights without a successful run of either kind; night 1, which has no increment, is one."""
    done = lambda kind: F.max(F.when(ok() & (F.col("snapshot_type") == kind), 1).otherwise(0))
    joined = snapshots.nights(w.spark).join(w.snapshot_job_history.select("night_number", "snapshot_type", "status"), "night_number", "left")
    return joined.groupBy("night_number").agg(done("periodic").alias("periodic_success"), done("incremental").alias("incremental_success")).filter("periodic_success = 0 or incremental_success = 0")


def c2b_gaps_anti(w: Warehouse) -> DataFrame:
    """Nights without any successful run."""
    return snapshots.nights(w.spark).join(w.snapshot_job_history.filter(ok()), "night_number", "left_anti")


def c3a_exact_night(w: Warehouse, night: int = NIGHT) -> DataFrame:
    return w.periodic_snapshots.filter(F.col("night_number") == F.lit(night)).agg(n_rows().alias("rows_returned"))


def c3b_fallback(w: Warehouse, night: int = NIGHT) -> DataFrame:
    last = w.periodic_snapshots.filter(F.col("night_number") <= F.lit(night)).agg(F.max("night_number").alias("night_number"))
    return w.periodic_snapshots.join(F.broadcast(last), "night_number").withColumnRenamed("night_number", "reconstructed_as_of_night")


def c3c_replay(w: Warehouse, night: int = NIGHT) -> DataFrame:
    return snapshots.replayed(w.incremental_base_snapshot, w.incremental_deltas, night)


def _naive(w: Warehouse) -> DataFrame:
    missing = w.incremental_deltas.filter(F.col("night_number") == NIGHT).select("customer_id")
    return w.incremental_base_snapshot.select("customer_id").subtract(missing).agg(n_rows().alias("delta_rows"))


def c4_naive_delta(w: Warehouse) -> DataFrame:
    return _naive(w)


def c5_defensive_delta(w: Warehouse) -> DataFrame:
    return w.incremental_deltas.filter(F.col("night_number") == NIGHT + 1).agg(n_rows().alias("delta_rows"))


def c6_verification(w: Warehouse) -> DataFrame:
    """Customers whose captured state on a later night isn't the true one: by region alone, and by all attributes."""
    true = _of_night(w, LATER).select("customer_id", *(F.col(c).alias(f"true_{c}") for c in snapshots.STATE))
    joined = w.periodic_snapshots.filter(F.col("night_number") == LATER).join(true, "customer_id")
    differs = [F.col(c) != F.col(f"true_{c}") for c in snapshots.STATE]
    return joined.agg(F.count_if(differs[0]).alias("region_mismatches"), F.count_if(differs[0] | differs[1] | differs[2]).alias("mismatches"))


def c7_health(w: Warehouse) -> DataFrame:
    point = w.snapshot_job_history.filter(ok() & (F.col("snapshot_type") == "incremental")).agg(F.max("checkpoint_night").alias("checkpoint_night"))
    twice = checks.duplicate_keys(w.incremental_deltas, "customer_id", "night_number").withColumnRenamed("violations", "duplicate_deltas")
    ratio = n10_storage(w).select("storage_ratio", (F.col("storage_ratio") > 5).alias("storage_healthy"))
    return point.crossJoin(ratio).crossJoin(c6_verification(w).select("mismatches")).crossJoin(twice)


JOB = ("night_number", "status", "rows_processed", "checkpoint_night")


def _increments(w: Warehouse) -> DataFrame:
    return w.snapshot_job_history.filter(F.col("snapshot_type") == "incremental")


def k1_around_failure(w: Warehouse) -> DataFrame:
    return w.snapshot_job_history.filter(F.col("night_number").between(9, 14)).select("job_id", "snapshot_type", *JOB)


def k2_first_successes(w: Warehouse) -> DataFrame:
    return _increments(w).filter(ok()).select(*JOB).orderBy("night_number").limit(10)


def k3_checkpoint_at_failure(w: Warehouse) -> DataFrame:
    return _increments(w).filter(F.col("night_number").isin(11, 12, 13)).select(*JOB)


def k4_checkpoints(w: Warehouse) -> DataFrame:
    return _increments(w).select(*JOB)


def k5_safe_checkpoint(w: Warehouse) -> DataFrame:
    return _increments(w).filter(ok() & (F.col("checkpoint_night") <= NIGHT)).agg(F.max("checkpoint_night").alias("safe_checkpoint_to_use"))


def r0_changed_rows(w: Warehouse) -> DataFrame:
    return snapshots.changed_rows(_of_night(w, LATER).drop("night_number"), _of_night(w, NIGHT - 1).drop("night_number"))


def r0_all_changes(w: Warehouse) -> DataFrame:
    """Between two nights of a population that is not fixed: customers came, went and changed."""
    now, before = (_of_night(w, night).drop("night_number").filter(F.col("customer_id") % k != 0) for night, k in ((LATER, 7), (NIGHT - 1, 5)))
    return snapshots.all_changes(now, before)


def _retry(w: Warehouse) -> DataFrame:
    return r0_changed_rows(w).select("customer_id", F.lit(LATER).alias("night_number"), *snapshots.STATE)


def r1_append(w: Warehouse) -> DataFrame:
    return _retry(w)


def r2_naive_retry(w: Warehouse) -> DataFrame:
    """What appending twice leaves: pairs of customer and night that come more than once."""
    return checks.duplicate_keys(_retry(w).unionByName(_retry(w)), "customer_id", "night_number").withColumnRenamed("violations", "duplicate_pairs")


def r3_idempotent_retry(w: Warehouse) -> DataFrame:
    """Rows after one, two and three upserts of the same batch: as many each time."""
    keys = ["customer_id", "night_number"]
    target, out = _retry(w).limit(0), {}
    for n in (1, 2, 3):
        target = snapshots.upserted(target, _retry(w), keys)
        out[f"run_{n}"] = target
    return counts(out, "attempt")


def _sizes(w: Warehouse) -> DataFrame:
    return w.incremental_deltas.groupBy("night_number").agg(n_rows().alias("n"))


def v1_delta_bound(w: Warehouse) -> DataFrame:
    total = w.customer_baseline.agg(n_rows().alias("customers"))
    largest = _sizes(w).agg(F.max("n").alias("max_delta"))
    return largest.crossJoin(total).withColumn("passed", F.col("max_delta") * 20 < F.col("customers"))


def v2_duplicates(w: Warehouse) -> DataFrame:
    named = {"incremental_deltas": w.incremental_deltas, "retry_deltas": _retry(w).unionByName(_retry(w))}
    return union([checks.duplicate_keys(df, "customer_id", "night_number").select(F.lit(k).alias("table_name"), "violations", (F.col("violations") == 0).alias("passed")) for k, df in named.items()])


def v3_checksum(w: Warehouse) -> DataFrame:
    columns = ("customer_id", *snapshots.STATE)
    true = checks.checksum(_of_night(w, LATER), *columns).withColumnRenamed("checksum", "independent")
    kept = checks.checksum(w.periodic_snapshots.filter(F.col("night_number") == LATER), *columns).withColumnRenamed("checksum", "official")
    return true.crossJoin(kept).select(F.col("independent").cast("long").alias("independent"), F.col("official").cast("long").alias("official"), F.col("independent").eqNullSafe(F.col("official")).alias("passed"))


def v4_anomaly(w: Warehouse) -> DataFrame:
    got = _sizes(w).agg(F.max("n").alias("max_delta"), F.sum("n").alias("total"), n_rows().alias("nights"))
    average = share(F.col("total"), F.col("nights"))
    bar = F.greatest(average * 5, F.lit(10.0))
    return got.select("max_delta", average.alias("avg_delta"), bar.alias("threshold"), (F.col("max_delta") < bar).alias("passed"), (F.col("max_delta") < average * 5).alias("passed_without_floor"))


def v5_naive_flagged(w: Warehouse) -> DataFrame:
    return _naive(w).crossJoin(v4_anomaly(w).select("threshold")).withColumn("passed", F.col("delta_rows") < F.col("threshold"))


def _fresh(w: Warehouse, day: int) -> DataFrame:
    """Whether the last successful copy had ended within a day before the morning of a night's day."""
    done = w.snapshot_job_history.filter(ok() & (F.col("snapshot_type") == "periodic") & (F.col("night_number") <= day))
    return checks.freshness(done, "finished_at", F.expr(f"timestamp_ntz'2024-01-01 06:00:00' + make_dt_interval({day - 1})"), F.make_dt_interval(F.lit(1)))


def v6_freshness(w: Warehouse) -> DataFrame:
    """On the last day, and on the day of the night that failed."""
    return union([_fresh(w, day).select(F.lit(day).alias("day"), "latest", "passed") for day in (snapshots.NIGHTS, NIGHT)])


def v0_checks(w: Warehouse) -> DataFrame:
    """All checks in one table: label, status (PASS, FAIL or SKIP) and detail."""
    flags = {
        "delta bound": (v1_delta_bound(w), F.col("max_delta")),
        "checksum of a night": (v3_checksum(w), F.col("official")),
        "anomaly": (v4_anomaly(w), F.col("max_delta")),
        "naive delta": (v5_naive_flagged(w), F.col("delta_rows")),
        "fresh on the last day": (_fresh(w, snapshots.NIGHTS), F.date_format("latest", "yyyy-MM-dd")),
        "fresh on the failed day": (_fresh(w, NIGHT), F.date_format("latest", "yyyy-MM-dd")),
    }
    rows = [checks.outcome(k, df, F.col("passed"), detail) for k, (df, detail) in flags.items()]
    tables = {"duplicates in deltas": w.incremental_deltas, "duplicates after a naive retry": _retry(w).unionByName(_retry(w)), "duplicates in an absent table": None}
    rows += [checks.no_duplicates(w.spark, k, df, "customer_id", "night_number") for k, df in tables.items()]
    return union([*rows, history.integrity(w.dim_customer_scd2).select(F.concat(F.lit("history "), "check_name").alias("label"), F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), F.concat(F.col("violations").cast("string"), F.lit(" violations")).alias("detail"))])


def d1_status(w: Warehouse) -> DataFrame:
    return w.snapshot_job_history.agg(F.max("checkpoint_night").alias("current_checkpoint"), F.count_if(ok()).alias("successful_jobs"), F.count_if(F.col("status") == "failed").alias("failed_jobs"))


def d2_storage(w: Warehouse) -> DataFrame:
    return n10_storage(w)


def d3_latest_activity(w: Warehouse) -> DataFrame:
    return _sizes(w).agg(F.max("night_number").alias("latest_snapshot"), F.max_by("n", "night_number").alias("rows_changed"))


def d4_warnings(w: Warehouse) -> DataFrame:
    return w.snapshot_job_history.filter(F.col("status") == "failed").select("night_number", "snapshot_type", "status")


def d5_health(w: Warehouse) -> DataFrame:
    failed = w.snapshot_job_history.agg(F.count_if(F.col("status") == "failed").alias("failed_jobs"))
    twice = checks.duplicate_keys(w.periodic_snapshots, "customer_id", "night_number").withColumnRenamed("violations", "duplicate_rows")
    last = w.periodic_snapshots.agg(F.max("night_number").alias("latest_snapshot"))
    well = (F.col("failed_jobs") == 0) & (F.col("duplicate_rows") == 0)
    return failed.crossJoin(twice).crossJoin(last).withColumn("status", F.when(well, "HEALTHY").otherwise("ATTENTION REQUIRED"))


QUERIES = {
    **{k: (lambda w, t=t: getattr(w, t)) for k, t in (("n1_customer_baseline", "customer_baseline"), ("n2_change_log", "change_log"), ("n4_job_history", "snapshot_job_history"), ("n5_periodic_snapshots", "periodic_snapshots"), ("n6_base_snapshot", "incremental_base_snapshot"), ("n7_incremental_deltas", "incremental_deltas"))},
    "n9_checkpoint_advance": lambda w: _increments(w).select("night_number", "status", "checkpoint_night"),
    **{f.__name__: f for f in (n3_true_states, n8_tracking_state, n10_storage, c1_storage_rows, c2_gaps, c2b_gaps_anti, c3a_exact_night, c3b_fallback, c3c_replay, c4_naive_delta, c5_defensive_delta, c6_verification, c7_health, k1_around_failure, k2_first_successes, k3_checkpoint_at_failure, k4_checkpoints, k5_safe_checkpoint, r0_changed_rows, r0_all_changes, r1_append, r2_naive_retry, r3_idempotent_retry, v1_delta_bound, v2_duplicates, v3_checksum, v4_anomaly, v5_naive_flagged, v6_freshness, v0_checks, d1_status, d2_storage, d3_latest_activity, d4_warnings, d5_health)},
}
