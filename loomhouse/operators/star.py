"""Star schema: dimensions with sequential keys, a fact with governed metrics, and the wide table that joins them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomhouse.functions import MONEY, numbered, weekday


def date_dimension(lines: DataFrame) -> DataFrame:
    """A row for each date that occurs; days without orders have none."""
    d = F.col("date")
    return (
        lines.select(F.col("order_date").alias("date"))
        .distinct()
        .select(
            F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
            "date",
            F.year(d).alias("year"),
            F.quarter(d).alias("quarter"),
            F.month(d).alias("month"),
            F.dayofmonth(d).alias("day"),
            weekday(d).alias("day_of_week"),
            weekday(d).isin(0, 6).alias("is_weekend"),
        )
    )


def keyed(entities: DataFrame, natural: str, key: str) -> DataFrame:
    """``entities`` with a surrogate key 1, 2, ... in order of their natural key."""
    return numbered(entities, natural, name=key)


def fact(lines: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with surrogate keys, gross revenue, and net revenue, which is zero where refunded."""
    gross = (F.col("quantity") * F.col("unit_price")).cast(MONEY)
    return (
        lines.join(products.select("product_id", "product_key"), "product_id")
        .join(customers.select("customer_id", "customer_key"), "customer_id")
        .select(
            "order_id",
            "line_id",
            F.date_format("order_date", "yyyyMMdd").cast("int").alias("date_key"),
            "customer_key",
            "product_key",
            "quantity",
            "unit_price",
            gross.alias("gross_revenue"),
            "is_refunded",
            F.when(F.col("is_refunded"), F.lit(0).cast(MONEY)).otherwise(gross).alias("net_revenue"),
            "order_date",
            "customer_id",
        )
    )


def wide(fact: DataFrame, dates: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """The fact with the attributes of all its dimensions."""
    return (
        fact.drop("customer_id", "order_date")
        .join(products, "product_key")
        .join(customers, "customer_key")
        .join(dates, "date_key")
        .select(
            "order_id", "date", F.col("year").alias("order_year"), F.col("quarter").alias("order_quarter"), F.col("month").alias("order_month"), "is_weekend",
            "customer_id", "region", "country", "segment", "product_id", F.col("name").alias("product_name"), "category", "subcategory", "cost_price",
            "quantity", "unit_price", "gross_revenue", "is_refunded", "net_revenue",
        )
    )


def evolved(dimension: DataFrame, column: str, source: str, values: dict[str, str], otherwise: str | None) -> DataFrame:
    """A dimension with a new column, derived from another by a table of values."""
    case = F.lit(None).cast("string") if otherwise is None else F.lit(otherwise)
    for k, v in reversed(values.items()):
        case = F.when(F.col(source) == k, v).otherwise(case)
    return dimension.withColumn(column, case)


def propagated(wide_table: DataFrame, dimension: DataFrame, key: str, column: str) -> DataFrame:
    """The wide table with a column of a dimension; rows without a match keep a null."""
    return wide_table.join(dimension.select(key, column), key, "left")
