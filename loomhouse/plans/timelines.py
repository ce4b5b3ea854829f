"""Type 2 history, point-in-time joins, and join fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomhouse.functions import MONEY, cents, rounded, share
from loomhouse.operators import fanout, history
from loomhouse.plans.analytics import counts, union
from loomhouse.plans.warehouse import Warehouse

YEAR, SEGMENT, CUSTOMER = 1996, "BUILDING", 10


def n_rows() -> Column:
    return F.count(F.lit(1))


def s0_enriched_fact(w: Warehouse) -> DataFrame:
    return w.fct_orders.drop("line_id")


def s2_current(w: Warehouse) -> DataFrame:
    return history.current(w.dim_customer_scd2)


def s3_integrity_initial(w: Warehouse) -> DataFrame:
    return history.integrity(w.initial_scd2)


def s5_integrity(w: Warehouse) -> DataFrame:
    return history.integrity(w.dim_customer_scd2)


def s5_integrity_of_faulty(w: Warehouse) -> DataFrame:
    return history.integrity(history.faulty(w.initial_scd2))


def _summary(df: DataFrame) -> DataFrame:
    return df.agg(n_rows().alias("total_rows"), F.count_distinct("customer_id").alias("distinct_customers"), F.count_if("is_current").alias("current_records"), F.count_if(F.col("valid_to").isNull()).alias("open_records"))


def s6_load_summary(w: Warehouse) -> DataFrame:
    return _summary(w.initial_scd2)


def s8_change_detection(w: Warehouse) -> DataFrame:
    return history.detected(w.initial_scd2, w.feed)


def s9_unmatched_feed(w: Warehouse) -> DataFrame:
    return history.unmatched(w.initial_scd2, w.feed).agg(n_rows().alias("violations"))


def s9_unmatched_of_feed(w: Warehouse) -> DataFrame:
    """Records of a feed for customers that have no history: with them the feed is refused."""
    more = w.feed.withColumn("customer_id", F.when(F.col("customer_id") % 20 == 0, F.col("customer_id") + 10_000_000).otherwise(F.col("customer_id")))
    return history.unmatched(w.initial_scd2, more).select("seq", "customer_id")


def s9_point_lookup(w: Warehouse, customer: int = CUSTOMER) -> DataFrame:
    return history.current(w.dim_customer_scd2).filter(F.col("customer_id") == F.lit(customer)).select("customer_id", "region", "country", "segment")


def s10_next_key(w: Warehouse) -> DataFrame:
    return w.dim_customer_scd2.agg((F.max("customer_key") + 1).alias("next_customer_key"))


def _versions(df: DataFrame) -> DataFrame:
    return df.groupBy("customer_id").agg(n_rows().alias("version_count"))


def s13_change_summary(w: Warehouse) -> DataFrame:
    most = _versions(w.dim_customer_scd2).agg(F.max("version_count").alias("max_versions"))
    return _summary(w.dim_customer_scd2).crossJoin(most)


def s13_versions_of_changed(w: Warehouse) -> DataFrame:
    return _versions(w.dim_customer_scd2).join(w.feed.select("customer_id"), "customer_id", "left_semi")


def _at_order(w: Warehouse, inclusive: bool = False) -> DataFrame:
    return history.as_of(w.fct_orders, w.dim_customer_scd2, inclusive=inclusive)


def _t1(w: Warehouse, inclusive: bool) -> DataFrame:
    got = _at_order(w, inclusive).select("order_id", "line_id", "order_date", "net_revenue", F.col("region").alias("region_at_order"), F.col("country").alias("country_at_order"), F.col("segment").alias("segment_at_order"))
    return got.orderBy("line_id").limit(20)


def t1_at_order(w: Warehouse) -> DataFrame:
    return _t1(w, False)


def t1_at_order_inclusive(w: Warehouse) -> DataFrame:
    return _t1(w, True)


def t1_coverage(w: Warehouse) -> DataFrame:
    """Lines that the strict, the inclusive and the unbounded join find."""
    broken = w.fct_orders.join(w.dim_customer_scd2.select("customer_id"), "customer_id")
    return counts({"all": w.fct_orders, "strict": _at_order(w), "inclusive": _at_order(w, True), "unbounded": broken}, "form")


def _t2(w: Warehouse, inclusive: bool) -> DataFrame:
    joined = _at_order(w, inclusive).join(w.dim_date.select("date_key", "year"), "date_key")
    return joined.groupBy(F.col("region").alias("region_at_order"), "year").agg(F.sum("net_revenue").alias("net_revenue"), F.count_distinct("order_id").alias("order_count"))


def t2_region_year(w: Warehouse) -> DataFrame:
    return _t2(w, False)


def t2_region_year_inclusive(w: Warehouse) -> DataFrame:
    return _t2(w, True)


def t3_one_customer(w: Warehouse, customer: int = CUSTOMER) -> DataFrame:
    return _at_order(w).filter(F.col("customer_id") == F.lit(customer)).select("order_id", "line_id", "order_date", "net_revenue", F.col("segment").alias("segment_at_order"), "valid_from", "valid_to")


def t3_one_customer_first(w: Warehouse) -> DataFrame:
    return t3_one_customer(w).orderBy("order_date", "line_id").limit(15)


def t4_unbounded(w: Warehouse) -> DataFrame:
    """Deliberately wrong: every version of a customer meets every order."""
    joined = w.fct_orders.join(w.dim_customer_scd2.select("customer_id", "region"), "customer_id")
    return joined.groupBy("region").agg(F.sum("net_revenue").alias("inflated_revenue"), n_rows().alias("row_count"))


def t5_inflation(w: Warehouse) -> DataFrame:
    changed = w.feed.select("customer_id").distinct()
    facts = w.fct_orders.join(changed, "customer_id", "left_semi")
    right = history.as_of(facts, w.dim_customer_scd2).groupBy("customer_id").agg(n_rows().alias("correct_row_count"), F.sum("net_revenue").alias("correct_revenue"))
    versions = _versions(w.dim_customer_scd2).withColumnRenamed("version_count", "scd2_versions")
    wrong = facts.join(w.dim_customer_scd2.select("customer_id"), "customer_id").groupBy("customer_id").agg(n_rows().alias("inflated_row_count"), F.sum("net_revenue").alias("inflated_revenue"))
    return right.join(wrong, "customer_id").join(versions, "customer_id").withColumn("inflation_factor", rounded(cents(F.col("inflated_revenue")), cents(F.col("correct_revenue")), 2))


def t6_segment_year(w: Warehouse, segment: str = SEGMENT, year: int = YEAR) -> DataFrame:
    joined = _at_order(w).filter(F.col("segment") == F.lit(segment)).join(w.dim_date.filter(F.col("year") == F.lit(year)).select("date_key", "year"), "date_key")
    return joined.groupBy("year").agg(F.sum("net_revenue").alias("net_revenue"), F.count_distinct("order_id").alias("order_count"))


def t7_journey(w: Warehouse) -> DataFrame:
    several = _versions(w.dim_customer_scd2).filter("version_count > 1")
    versions = w.dim_customer_scd2.join(several, "customer_id", "left_semi")
    lines = w.fct_orders.select(F.col("customer_id").alias("buyer"), "order_id", "order_date", "net_revenue")
    joined = versions.join(lines, (F.col("customer_id") == F.col("buyer")) & history.valid_at(F.col("order_date")), "left")
    return joined.groupBy("customer_id", "segment", "region", "valid_from", "valid_to", "is_current").agg(F.coalesce(F.sum("net_revenue"), F.lit(0).cast("decimal(38,2)")).alias("revenue_during_period"), F.count("order_id").alias("orders_during_period"))


def t8_current_by_segment(w: Warehouse) -> DataFrame:
    return history.current(w.dim_customer_scd2).groupBy("segment", "region").agg(n_rows().alias("customer_count"))


def t9_health(w: Warehouse) -> DataFrame:
    most = _versions(w.dim_customer_scd2).agg(F.max("version_count").alias("max_versions_single_customer"))
    odd = w.dim_customer_scd2.agg(F.count_if(F.col("is_current") & F.col("valid_to").isNotNull()).alias("is_current_but_has_valid_to"))
    return _summary(w.dim_customer_scd2).crossJoin(most).crossJoin(odd).withColumn("avg_versions_per_customer", rounded(F.col("total_rows"), F.col("distinct_customers"), 4))


def t10_many_versions(w: Warehouse) -> DataFrame:
    return _versions(w.dim_customer_scd2).filter("version_count > 1")


def t10_histories(w: Warehouse) -> DataFrame:
    return w.dim_customer_scd2.join(w.feed.select("customer_id"), "customer_id", "left_semi")


def i2_distribution(w: Warehouse) -> DataFrame:
    return w.promotions.groupBy("customer_id").agg(n_rows().alias("promo_count")).groupBy("promo_count").agg(n_rows().alias("customer_count"))


def i2_coverage(w: Warehouse) -> DataFrame:
    total, having = w.dim_customer.agg(n_rows().alias("total_customers")), w.promotions.agg(F.count_distinct("customer_id").alias("with_promo"))
    return total.crossJoin(having).withColumn("without_promo", F.col("total_customers") - F.col("with_promo"))


def _broken(w: Warehouse) -> DataFrame:
    return w.fct_orders.join(w.promotions.select("customer_id"), "customer_id", "left")


def i3_broken_revenue(w: Warehouse) -> DataFrame:
    return _broken(w).agg(F.sum("net_revenue").alias("total_revenue"))


def i4_row_counts(w: Warehouse) -> DataFrame:
    return counts({"baseline": w.fct_orders, "joined": _broken(w)}, "stage")


def i5_affected_customers(w: Warehouse) -> DataFrame:
    """Customers by their number of promotions, and how many rows each of their lines becomes."""
    return i2_distribution(w).withColumn("inflates", F.col("promo_count") > 1)


def i6_inflation(w: Warehouse) -> DataFrame:
    right = w.fct_orders.agg(n_rows().alias("correct_row_count"), F.sum("net_revenue").alias("correct_revenue"))
    wrong = _broken(w).agg(n_rows().alias("inflated_row_count"), F.sum("net_revenue").alias("inflated_revenue"))
    more = (F.col("inflated_revenue") - F.col("correct_revenue")).cast("decimal(38,2)")
    return right.crossJoin(wrong).withColumns({"phantom_rows": F.col("inflated_row_count") - F.col("correct_row_count"), "inflation_amount": more}).withColumn("inflation_pct", rounded(cents(F.col("inflation_amount")), cents(F.col("correct_revenue")), 2, 100))


def i7_worst_customers(w: Warehouse) -> DataFrame:
    """Sums before joins: a customer's lines times its promotions are its inflated rows."""
    right = w.fct_orders.groupBy("customer_id").agg(n_rows().alias("correct_rows"), F.sum("net_revenue").alias("correct_revenue"))
    wrong = _broken(w).groupBy("customer_id").agg(n_rows().alias("inflated_rows"), F.sum("net_revenue").alias("inflated_revenue"))
    promos = w.promotions.groupBy("customer_id").agg(n_rows().alias("promo_count")).filter("promo_count >= 2")
    got = right.join(promos, "customer_id").join(wrong, "customer_id").withColumn("inflation_factor", rounded(cents(F.col("inflated_revenue")), cents(F.col("correct_revenue")), 2))
    return got.orderBy(F.desc_nulls_last("inflation_factor"), "customer_id").limit(10)


def _total(df: DataFrame, *more) -> DataFrame:
    return df.agg(F.sum("net_revenue").alias("total_revenue"), *more)


def f1_latest(w: Warehouse) -> DataFrame:
    return _total(w.fct_orders.join(fanout.latest(w.promotions), "customer_id", "left"))


def f1_attribution(w: Warehouse) -> DataFrame:
    joined = w.fct_orders.join(fanout.latest(w.promotions), "customer_id", "left")
    return joined.groupBy("promo_code").agg(n_rows().alias("row_count"), F.sum("net_revenue").alias("total_revenue"))


def f2_summarised(w: Warehouse) -> DataFrame:
    """The average weighs customers by their lines and leaves out those without promotions."""
    joined = w.fct_orders.join(fanout.summarised(w.promotions), "customer_id", "left")
    return _total(joined, F.sum("promo_count").alias("promos"), F.count("promo_count").alias("lines")).select("total_revenue", share(F.col("promos"), F.col("lines")).alias("line_weighted_avg_promos"))


def f3_running(w: Warehouse) -> DataFrame:
    return _total(fanout.attributed(w.fct_orders, w.promotions))


def f3_attribution(w: Warehouse) -> DataFrame:
    return fanout.attributed(w.fct_orders, w.promotions).groupBy("promo_code").agg(n_rows().alias("row_count"), F.sum("net_revenue").alias("total_revenue"))


def f4_baseline(w: Warehouse) -> DataFrame:
    return _total(w.fct_orders)


def f5_verification(w: Warehouse) -> DataFrame:
    forms = {"baseline": f4_baseline(w), "broken": i3_broken_revenue(w), "latest": f1_latest(w), "summarised": f2_summarised(w), "running": f3_running(w)}
    rows = union([df.select(F.lit(k).alias("form"), "total_revenue") for k, df in forms.items()])
    base = f4_baseline(w).withColumnRenamed("total_revenue", "baseline_revenue")
    diff = F.abs(F.col("total_revenue") - F.col("baseline_revenue"))
    return rows.crossJoin(base).select("form", "total_revenue", (diff < F.lit(0.01).cast(MONEY)).alias("matches"), rounded(cents(F.col("total_revenue")) - cents(F.col("baseline_revenue")), cents(F.col("baseline_revenue")), 2, 100).alias("inflation_pct"))


def f6_row_guard(w: Warehouse) -> DataFrame:
    """Row counts before and after each join, and whether the guard would let it pass."""
    joins = {"broken": _broken(w), "latest": w.fct_orders.join(fanout.latest(w.promotions), "customer_id", "left"), "running": fanout.attributed(w.fct_orders, w.promotions)}
    base = w.fct_orders.agg(n_rows().alias("base_rows"))
    return counts(joins, "join_name").crossJoin(base).select("join_name", "base_rows", F.col("row_count").alias("joined_rows"), (F.col("row_count") == F.col("base_rows")).alias("passed"))


QUERIES = {
    "s1_initial_load": lambda w: w.initial_scd2,
    "s7_feed": lambda w: w.feed,
    "s11_history": lambda w: w.dim_customer_scd2,
    "i1_promotions": lambda w: w.promotions,
    **{f.__name__: f for f in (s0_enriched_fact, s2_current, s3_integrity_initial, s5_integrity, s5_integrity_of_faulty, s6_load_summary, s8_change_detection, s9_unmatched_feed, s9_unmatched_of_feed, s9_point_lookup, s10_next_key, s13_change_summary, s13_versions_of_changed, t1_at_order, t1_at_order_inclusive, t1_coverage, t2_region_year, t2_region_year_inclusive, t3_one_customer, t3_one_customer_first, t4_unbounded, t5_inflation, t6_segment_year, t7_journey, t8_current_by_segment, t9_health, t10_many_versions, t10_histories, i2_distribution, i2_coverage, i3_broken_revenue, i4_row_counts, i5_affected_customers, i6_inflation, i7_worst_customers, f1_latest, f1_attribution, f2_summarised, f3_running, f3_attribution, f4_baseline, f5_verification, f6_row_guard)},
}
