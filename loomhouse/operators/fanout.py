"""Join fan-out: showing how a one-to-many join inflates a sum, and joins that don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class InflationError(AssertionError):
    """A join that changes the number of rows."""


def promotions(customers: DataFrame, start: str = "1997-01-01", days: int = 90) -> DataFrame:
    """None, one, two or three promotions a customer, by the remainder of the customer's key."""
    bucket = F.col("customer_key") % 20
    count = F.when(bucket < 10, 0).when(bucket < 16, 1).when(bucket < 19, 2).otherwise(3)
    nth = customers.withColumn("n", count).filter("n > 0").select("customer_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    begin = F.date_add(F.lit(start).cast("date"), F.pmod(F.col("customer_id") * 37 + F.col("i") * 101, F.lit(300)).cast("int"))
    pick = lambda *x: F.element_at(F.array(*x), F.col("i") + 1)
    return nth.select(
        "customer_id", pick(F.lit("PROMO_A"), F.lit("PROMO_B"), F.lit("PROMO_C")).alias("promo_code"), pick(*(F.expr(f"cast({x} as decimal(3,2))") for x in ("0.10", "0.15", "0.20"))).alias("discount_pct"),
        begin.alias("promo_start"), F.date_add(begin, days).alias("promo_end"),
    )


def latest(promos: DataFrame) -> DataFrame:
    """Each customer's promotion that starts last; the larger code breaks ties."""
    order = Window.partitionBy("customer_id").orderBy(F.desc("promo_start"), F.desc("promo_code"))
    return promos.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def summarised(promos: DataFrame) -> DataFrame:
    return promos.groupBy("customer_id").agg(F.count(F.lit(1)).alias("promo_count"), F.max("discount_pct").alias("max_discount"))


def attributed(fact: DataFrame, promos: DataFrame) -> DataFrame:
    """Each line with the promotion that was running at its date, the last to start, or none. One row a line.

    A customer's promotions, a few, meet its lines as one array, so that lines are joined once and never ranked.
    """
    of = promos.groupBy(F.col("customer_id").alias("promo_of")).agg(F.collect_list(F.struct("promo_start", *(c for c in promos.columns if c not in ("customer_id", "promo_start")))).alias("promos"))
    running = F.filter("promos", lambda p: (F.col("order_date") >= p["promo_start"]) & (F.col("order_date") < p["promo_end"]))
    joined = fact.join(of, F.col("customer_id") == F.col("promo_of"), "left").withColumn("promo", F.array_max(running))
    return joined.select(*fact.columns, *(F.col(f"promo.{c}").alias(c) for c in promos.columns if c != "customer_id"))


def assert_no_inflation(base: DataFrame, joined: DataFrame, label: str) -> None:
    """Raise if a join has changed the number of rows."""
    before, after = base.count(), joined.count()
    if before != after:
        raise InflationError(f"{label}: {before} rows before the join, {after} after it")
