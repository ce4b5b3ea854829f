"""Checks as rows and as assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomhouse.functions import portable_hash


def assert_check(label: str, violations: DataFrame, expected: int = 0) -> None:
    """Raise unless the single number of ``violations`` is the expected one."""
    found = violations.first()[0]
    if found != expected:
        raise ValueError(f"{label}: expected {expected}, found {found}")


def checksum(df: DataFrame, *columns: str) -> DataFrame:
    """A sum of row hashes, whatever the order of rows; it is exact, so it never overflows."""
    return df.agg(F.sum(portable_hash(*(F.col(c).cast("string") for c in columns)).cast("decimal(20,0)")).alias("checksum"))


def orphans(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """The number of fact rows whose key the dimension lacks; a null key counts."""
    return fact.join(dimension.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("violations"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))


def outcome(label: str, found: DataFrame, passed: Column, detail: Column) -> DataFrame:
    """(label, status, detail) of a frame of one row; a check that finds nothing to compare (null) fails."""
    return found.select(F.lit(label).alias("label"), F.when(passed, "PASS").otherwise("FAIL").alias("status"), detail.cast("string").alias("detail"))


def skipped(spark: SparkSession, label: str, why: str) -> DataFrame:
    """The row of a check whose table does not exist."""
    return spark.range(1).select(F.lit(label).alias("label"), F.lit("SKIP").alias("status"), F.lit(why).alias("detail"))


def no_duplicates(spark: SparkSession, label: str, df: DataFrame | None, *keys: str) -> DataFrame:
    """Whether no two rows share their keys; without a table the check is skipped."""
    if df is None:
        return skipped(spark, label, "no such table")
    return outcome(label, duplicate_keys(df, *keys), F.col("violations") == 0, F.concat(F.col("violations").cast("string"), F.lit(" duplicates")))


def freshness(df: DataFrame, moment: str, as_of: Column, most: Column) -> DataFrame:
    """(latest, passed): whether the latest moment of a table is not older than ``most`` (an interval) at ``as_of``; an empty table is not fresh."""
    return df.agg(F.max(moment).alias("latest")).withColumn("passed", F.coalesce(F.col("latest") >= as_of - most, F.lit(False)))
