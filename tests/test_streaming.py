from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomhouse.plans.warehouse import warehouse
from loomhouse.streaming import daily_counts, run_nightly

SF = "/root/testdata/sf0.001"


def test_nightly_stream_equals_the_window_form(spark, tmp_path):
    states = entry.queries()["n3_true_states"](spark, SF).filter("night_number in (1, 11, 12, 13, 14)").select("night_number", "customer_id", "region", "country", "segment")
    for night in (1, 11, 12, 13, 14):
        states.filter(F.col("night_number") == night).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_nightly(spark, f"{tmp_path}/in", states.schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint", failed=(12,))
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/captured").filter("night_number > 11").select("night_number", "customer_id", "region", "country", "segment").collect()}
    want = {tuple(r) for r in warehouse(spark, SF).incremental_deltas.filter("night_number between 12 and 14").select("night_number", "customer_id", "region", "country", "segment").collect()}
    assert got == want
    jobs = {r["night_number"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/out/jobs").collect()}
    assert jobs == {1: "success", 11: "success", 12: "failed", 13: "success", 14: "success"}


def test_customers_that_come_and_go(spark, tmp_path):
    """A night run twice leaves the same rows; every night is held against the last one captured alone."""
    schema = "night_number int, customer_id long, region string, country string, segment string"
    nights = {1: [(1, "a"), (2, "a")], 2: [(1, "b"), (2, "a"), (3, "a")], 3: [(1, "c"), (3, "a")], 4: [(2, "a"), (3, "a")]}
    for night, state in nights.items():
        spark.createDataFrame([(night, c, r, "x", "y") for c, r in state], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for checkpoint in ("one", "two") if night == 4 else ("one",):
            run_nightly(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", failed=(3,))
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/captured").select("night_number", "change_type", "customer_id", "region").collect())
    assert got == [(1, "insert", 1, "a"), (1, "insert", 2, "a"), (2, "insert", 3, "a"), (2, "update", 1, "b"), (4, "delete", 1, "b")]


def test_daily_counts_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    stream = daily_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted((r["day"], r["event_type"], r["events"], round(r["value"], 6)) for r in df.collect())
    assert key(spark.table("daily")) == key(daily_counts(events))
