"""Generation, star schema, analytics, wide against narrow, and schema evolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomhouse.functions import cents, rounded, share
from loomhouse.operators import checks, star
from loomhouse.plans.warehouse import Warehouse

YEAR, SEGMENT, SUBCATEGORY = 1997, "BUILDING", "Brand#1"
TIERS = {"AUTOMOBILE": "Bronze", "MACHINERY": "Silver", "BUILDING": "Gold"}
BRANDS = {"ECONOMY": "TechCorp", "STANDARD": "HomeStyle", "PROMO": "SportMax"}
LIFETIMES = {"BUILDING": "High Value", "MACHINERY": "Medium Value"}


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def counts(tables: dict[str, DataFrame], name: str = "table_name") -> DataFrame:
    return union([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(k).alias(name), "row_count") for k, df in tables.items()])


def g4_generation_checks(w: Warehouse) -> DataFrame:
    keys = {"raw_orders": "order_id", "raw_customers": "customer_id", "raw_products": "product_id"}
    return union([getattr(w, t).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(k).isNull()).alias("null_keys")).select(F.lit(t).alias("table_name"), "row_count", "null_keys") for t, k in keys.items()])


def m4_fct_orders(w: Warehouse) -> DataFrame:
    return w.fct_orders.select("order_id", "date_key", "customer_key", "product_key", "quantity", "unit_price", "gross_revenue", "is_refunded", "net_revenue")


def m5_build_checks(w: Warehouse) -> DataFrame:
    rows = counts({t: getattr(w, t) for t in ("raw_orders", "dim_date", "dim_customer", "dim_product", "fct_orders")}, "check_name").withColumnRenamed("row_count", "value")
    lost = [checks.orphans(w.fct_orders, getattr(w, d), k).select(F.lit(f"orphan_{k}").alias("check_name"), F.col("violations").alias("value")) for d, k in (("dim_date", "date_key"), ("dim_customer", "customer_key"), ("dim_product", "product_key"))]
    return union([rows, *lost])


def _revenue(name: str = "net_revenue"):
    return F.sum(name)


def a1_category_quarter(w: Warehouse) -> DataFrame:
    got = (
        w.fct_orders.join(w.dim_product.select("product_key", "category"), "product_key").join(w.dim_date.select("date_key", "year", "quarter"), "date_key")
        .groupBy("category", "year", "quarter")
        .agg(F.count_distinct("order_id").alias("order_count"), _revenue().alias("net_revenue"), F.count(F.lit(1)).alias("n"))
    )
    return got.select("category", "year", "quarter", "order_count", "net_revenue", (rounded(cents(F.col("net_revenue")), F.col("n"), 0) * F.expr("0.01BD")).cast("decimal(18,2)").alias("avg_order_revenue"))


def a2_top_customers(w: Warehouse) -> DataFrame:
    days = w.dim_date.filter(F.col("year") == YEAR).select("date_key")
    best = w.fct_orders.join(days, "date_key").groupBy("customer_key").agg(F.count_distinct("order_id").alias("order_count"), _revenue().alias("net_revenue"))
    named = best.join(w.dim_customer, "customer_key").select("customer_id", "region", "segment", "order_count", "net_revenue")
    return named.orderBy(F.desc("net_revenue"), "customer_id").limit(10)


def a3_weekend_share(w: Warehouse) -> DataFrame:
    got = (
        w.fct_orders.join(w.dim_customer.select("customer_key", "region"), "customer_key").join(w.dim_date.select("date_key", "is_weekend"), "date_key")
        .groupBy("region", "is_weekend")
        .agg(F.count_distinct("order_id").alias("order_count"), _revenue().alias("net_revenue"))
        .withColumn("of_region", F.sum("net_revenue").over(Window.partitionBy("region")))
    )
    return got.select("region", F.when(F.col("is_weekend"), "Weekend").otherwise("Weekday").alias("day_type"), "order_count", "net_revenue", rounded(cents(F.col("net_revenue")), cents(F.col("of_region")), 1, 100).alias("pct_of_region_revenue"))


def a4_monthly_growth(w: Warehouse) -> DataFrame:
    monthly = w.fct_orders.join(w.dim_product.select("product_key", "category"), "product_key").join(w.dim_date.select("date_key", "year", "month"), "date_key").groupBy("category", "year", "month").agg(_revenue().alias("revenue"))
    before = monthly.withColumn("previous_month_revenue", F.lag("revenue").over(Window.partitionBy("category").orderBy("year", "month")))
    return before.withColumn("revenue_growth_pct", share(F.col("revenue") - F.col("previous_month_revenue"), F.col("previous_month_revenue")) * 100)


def a5_refunds(w: Warehouse) -> DataFrame:
    got = w.fct_orders.join(w.dim_product.select("product_key", "category"), "product_key").groupBy("category").agg(F.sum("gross_revenue").alias("gross_revenue"), _revenue().alias("net_revenue"))
    refund = (F.col("gross_revenue") - F.col("net_revenue")).cast("decimal(38,2)")
    return got.withColumn("refund_value", refund).withColumn("refund_rate_pct", rounded(cents(F.col("refund_value")), cents(F.col("gross_revenue")), 2, 100))


def a6_margins(w: Warehouse) -> DataFrame:
    got = (
        w.fct_orders.join(w.dim_product.select("product_key", "category", "subcategory", "cost_price"), "product_key")
        .groupBy("category", "subcategory")
        .agg(_revenue().alias("net_revenue"), F.sum((F.col("quantity") * F.col("cost_price")).cast("decimal(18,2)")).alias("total_cost"))
    )
    return got.withColumn("margin_pct", rounded(cents(F.col("net_revenue")) - cents(F.col("total_cost")), cents(F.col("net_revenue")), 1, 100))


def w3_reconciliation(w: Warehouse) -> DataFrame:
    return counts({t: getattr(w, t) for t in ("fct_orders", "wide_orders", "dim_date", "dim_customer", "dim_product")})


def w4_attribute_bytes(w: Warehouse) -> DataFrame:
    of = {"wide_orders": ("region", "country", "segment", "category", "subcategory"), "dim_customer": ("region", "country", "segment"), "dim_product": ("category", "subcategory"), "fct_orders": ()}
    size = lambda cs: F.sum(sum((F.length(c) for c in cs), F.lit(0)).cast("long")) if cs else F.lit(None).cast("long")
    return union([getattr(w, t).agg(F.count(F.lit(1)).alias("row_count"), size(cs).alias("dim_attribute_bytes")).select(F.lit(t).alias("table_name"), "row_count", "dim_attribute_bytes") for t, cs in of.items()])


def _narrow(w: Warehouse, customer: tuple = (), product: tuple = (), date: tuple = ()) -> DataFrame:
    df = w.fct_orders.drop("customer_id")
    for dim, key, columns in ((w.dim_customer, "customer_key", customer), (w.dim_product, "product_key", product), (w.dim_date, "date_key", date)):
        df = df.join(dim.select(key, *columns), key) if columns else df
    return df


def _b1(df: DataFrame, year: str) -> DataFrame:
    return df.filter(F.col(year) == YEAR).groupBy("category").agg(_revenue().alias("revenue"))


def _b2(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_refunded")).groupBy("region", "category", F.trunc("date", "MM").alias("m")).agg(_revenue().alias("revenue"), F.count_distinct("customer_id").alias("distinct_customers"))


def _b3(df: DataFrame) -> DataFrame:
    chosen = df.filter((F.col("segment") == SEGMENT) & (F.col("subcategory") == SUBCATEGORY))
    return chosen.groupBy("product_name").agg(_revenue().alias("revenue")).orderBy(F.desc("revenue"), "product_name").limit(20)


def _b4(df: DataFrame) -> DataFrame:
    got = df.groupBy("region", "segment", "category").agg(_revenue().alias("revenue"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("avg_revenue", share(F.col("revenue"), F.col("n"))).drop("n")


def b1_wide(w: Warehouse) -> DataFrame:
    return _b1(w.wide_orders, "order_year")


def b1_narrow(w: Warehouse) -> DataFrame:
    return _b1(_narrow(w, product=("category",), date=("year",)), "year")


def b2_wide(w: Warehouse) -> DataFrame:
    return _b2(w.wide_orders)


def b2_narrow(w: Warehouse) -> DataFrame:
    return _b2(_narrow(w, ("region", "customer_id"), ("category",), ("date",)))


def b3_wide(w: Warehouse) -> DataFrame:
    return _b3(w.wide_orders)


def b3_narrow(w: Warehouse) -> DataFrame:
    return _b3(_narrow(w, ("segment",), ("subcategory", "name")).withColumnRenamed("name", "product_name"))


def b4_wide(w: Warehouse) -> DataFrame:
    return _b4(w.wide_orders)


def b4_narrow(w: Warehouse) -> DataFrame:
    return _b4(_narrow(w, ("region", "segment"), ("category",)))


def e1_brand(w: Warehouse) -> DataFrame:
    return star.propagated(w.wide_orders, star.evolved(w.dim_product, "brand", "category", BRANDS, "FashionCo"), "product_id", "brand").groupBy("brand", "category").agg(F.count(F.lit(1)).alias("row_count"), _revenue().alias("revenue"))


def e1_dim_product(w: Warehouse) -> DataFrame:
    return star.evolved(w.dim_product, "brand", "category", BRANDS, "FashionCo")


def e2_lifetime_segment(w: Warehouse) -> DataFrame:
    return star.propagated(w.wide_orders, star.evolved(w.dim_customer, "customer_lifetime_segment", "segment", LIFETIMES, "Standard"), "customer_id", "customer_lifetime_segment").groupBy("customer_lifetime_segment", "segment").agg(F.count(F.lit(1)).alias("row_count"))


def e3_tier(w: Warehouse) -> DataFrame:
    """The new column replaces the old one; segments without a tier get none."""
    return star.evolved(w.dim_customer, "customer_tier", "segment", TIERS, None).drop("segment")


def e3_wide_tier(w: Warehouse) -> DataFrame:
    return star.evolved(w.wide_orders, "customer_tier", "segment", TIERS, None).drop("segment").groupBy("customer_tier").agg(F.count(F.lit(1)).alias("row_count"))


def e4_propagation(w: Warehouse) -> DataFrame:
    """Rows that each change touches, from the tables themselves."""
    wide = w.wide_orders.agg(F.count(F.lit(1)).alias("wide_rows_touched"))
    rows = [(1, "Add product brand", w.dim_product), (2, "Add customer_lifetime_segment", w.dim_customer), (3, "Replace segment with customer_tier", w.dim_customer)]
    narrow = union([df.agg(F.count(F.lit(1)).alias("narrow_rows_touched")).select(F.lit(n).alias("change_number"), F.lit(what).alias("description"), "narrow_rows_touched") for n, what, df in rows])
    return narrow.crossJoin(wide).withColumn("propagation_multiplier", rounded(F.col("wide_rows_touched"), F.col("narrow_rows_touched"), 1).cast("decimal(18,1)"))


QUERIES = {
    **{f"{k}_{t}": (lambda w, t=t: getattr(w, t)) for k, t in (("g1", "raw_orders"), ("g2", "raw_customers"), ("g3", "raw_products"), ("m1", "dim_date"), ("m2", "dim_customer"), ("m3", "dim_product"), ("w2", "wide_orders"))},
    **{f.__name__: f for f in (g4_generation_checks, m4_fct_orders, m5_build_checks, a1_category_quarter, a2_top_customers, a3_weekend_share, a4_monthly_growth, a5_refunds, a6_margins, w3_reconciliation, w4_attribute_bytes, b1_wide, b1_narrow, b2_wide, b2_narrow, b3_wide, b3_narrow, b4_wide, b4_narrow, e1_brand, e1_dim_product, e2_lifetime_segment, e3_tier, e3_wide_tier, e4_propagation)},
}
