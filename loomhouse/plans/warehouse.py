"""Tables of the warehouse, built once for each input folder and session and then read from Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomhouse import sources
from loomhouse.operators import fanout, history, snapshots, star
from loomhouse.session import stored

EPOCH = "1995-01-01"
#: Small plans over stored tables, which are not stored again.
VIEWS = {"raw_customers", "raw_products", "initial_scd2", "customer_baseline", "incremental_base_snapshot"}
_built: dict[tuple[str, str], Warehouse] = {}


class Warehouse:
    """Attributes are tables; each is built when first asked for, from the tables that it needs, and stored in the shared folder, but for ``VIEWS``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.tables = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _BUILD:
            raise AttributeError(name)
        if name not in self.tables:
            by = ("order_year",) if name == "wide_orders" else ()
            made = _BUILD[name](self)
            self.tables[name] = made if name in VIEWS else stored(made, name, by)
        return self.tables[name]


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The session's warehouse over a folder; input files are taken not to change meanwhile."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = Warehouse(spark, sf_dir)
    return _built[key]


def feed(w: Warehouse) -> DataFrame:
    """Two records for every tenth customer, on the days after their first and last order, one that changes nothing, and blank attributes to carry forward."""
    seen = w.fct_orders.groupBy("customer_id").agg(F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    tenth = seen.filter("customer_id % 10 = 0")
    none, blank = F.lit(None).cast("string"), F.lit("")
    one = tenth.select((F.col("customer_id") * 2 + 1).alias("seq"), "customer_id", none.alias("region"), blank.alias("country"), F.lit("TIER_1").alias("segment"), F.date_add("first", 1).alias("change_date"))
    two = tenth.select((F.col("customer_id") * 2 + 2).alias("seq"), "customer_id", F.lit("NEW_REGION").alias("region"), none.alias("country"), blank.alias("segment"), F.date_add("last", 1).alias("change_date"))
    same = w.dim_customer.filter("customer_id = 5").select((F.col("customer_id") * 2 + 1).alias("seq"), "customer_id", "region", blank.alias("country"), "segment", F.lit("1996-01-01").cast("date").alias("change_date"))
    return one.unionByName(two).unionByName(same)


_BUILD: dict[str, Callable[[Warehouse], DataFrame]] = {
    "raw_orders": lambda w: sources.order_lines(w.spark, w.sf_dir),
    "raw_customers": lambda w: sources.customers(w.spark, w.sf_dir, w.raw_orders),
    "raw_products": lambda w: sources.products(w.spark, w.sf_dir, w.raw_orders),
    "dim_date": lambda w: star.date_dimension(w.raw_orders),
    "dim_customer": lambda w: star.keyed(w.raw_customers, "customer_id", "customer_key"),
    "dim_product": lambda w: star.keyed(w.raw_products.withColumnRenamed("product_name", "name"), "product_id", "product_key"),
    "fct_orders": lambda w: star.fact(w.raw_orders, w.dim_customer, w.dim_product),
    "wide_orders": lambda w: star.wide(w.fct_orders, w.dim_date, w.dim_customer, w.dim_product),
    "initial_scd2": lambda w: history.initial_load(w.dim_customer, EPOCH),
    "feed": feed,
    "dim_customer_scd2": lambda w: history.apply_feed(w.initial_scd2, w.feed),
    "promotions": lambda w: fanout.promotions(w.dim_customer),
    "customer_baseline": lambda w: history.current(w.dim_customer_scd2).select("customer_id", *history.TRACKED),
    "change_log": lambda w: snapshots.change_log(w.customer_baseline),
    "periodic_snapshots": lambda w: snapshots.states(w.customer_baseline, w.change_log, snapshots.nights(w.spark, captured_only=True)),
    "incremental_base_snapshot": lambda w: w.periodic_snapshots.filter("night_number = 1").drop("night_number"),
    "incremental_deltas": lambda w: snapshots.deltas(w.periodic_snapshots),
    "snapshot_job_history": lambda w: snapshots.job_history(w.spark, w.customer_baseline, w.incremental_deltas),
}
