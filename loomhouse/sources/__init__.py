"""Order lines, customers and products from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomhouse.functions import MONEY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order line. ``line_id`` numbers an order's lines by all their columns; it and the join share one shuffle by order."""
    line, order = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    rest = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*rest))
    price = F.call_function("div", F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long"))
    return (
        line.withColumn("nth", nth)
        .join(order.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            (F.col("l_orderkey") * 1000 + F.col("nth")).alias("line_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            (price.cast("decimal(16,0)") * F.expr("0.01BD")).cast(MONEY).alias("unit_price"),
            (F.col("l_returnflag") == "R").alias("is_refunded"),
        )
    )


def customers(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Customers that appear in the lines, with region, country and segment."""
    place = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = read(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    named = known.select(F.col("c_custkey").alias("customer_id"), F.col("r_name").alias("region"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("segment"))
    return named.join(lines.select("customer_id"), "customer_id", "left_semi")


def products(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Products that appear in the lines."""
    named = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.concat(F.lit("Product_"), F.col("p_partkey").cast("string")).alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.col("p_retailprice").cast(MONEY).alias("cost_price"),
    )
    return named.join(lines.select("product_id"), "product_id", "left_semi")


def generated_lines(spark: SparkSession, rows: int, seed: int = 42, customers: int = 10_000, products: int = 500) -> DataFrame:
    """Random order lines, the same for the same seed: dates over 730 days from 2022, 1-10 pieces, prices 5-205, one in twenty refunded."""
    draw = lambda k: F.rand(seed + k)
    return spark.range(1, rows + 1).select(
        F.col("id").alias("order_id"),
        F.date_add(F.lit("2022-01-01").cast("date"), F.floor(draw(1) * 730).cast("int")).alias("order_date"),
        (F.floor(draw(2) * customers) + 1).alias("customer_id"),
        (F.floor(draw(3) * products) + 1).alias("product_id"),
        (F.floor(draw(4) * 10) + 1).cast("int").alias("quantity"),
        F.round(draw(5) * 200 + 5, 2).cast(MONEY).alias("unit_price"),
        (draw(6) < 0.05).alias("is_refunded"),
    )
