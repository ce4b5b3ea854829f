"""Column functions with the same result in every engine: exact decimals, half-up rounding, null-safe ratios, sequential keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomhouse.session import stored

MONEY = "decimal(18,2)"


def cents(money: Column) -> Column:
    """A sum of money as whole cents."""
    return (money * 100).cast("decimal(38,0)")


def rounded(numerator: Column, denominator: Column, digits: int, times: int = 1) -> Column:
    """times * numerator / denominator of whole numbers, half away from zero at ``digits``; null where the denominator isn't positive."""
    top, bottom = F.abs(numerator).cast("decimal(30,0)"), denominator.cast("decimal(30,0)")
    whole = F.call_function("div", F.lit(2 * times * 10**digits) * top + bottom, F.lit(2) * bottom)
    signed = F.when(numerator < 0, -whole).otherwise(whole).cast("decimal(20,0)")
    return F.when(denominator > 0, (signed * F.expr(f"cast({10**-digits:.{digits}f} as decimal({digits + 1},{digits}))")).cast(f"decimal(18,{digits})"))


def share(numerator: Column, denominator: Column) -> Column:
    """An unrounded ratio: one division of two exact sums; null for a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def row_digest(*columns: str | Column) -> Column:
    """MD5 of the columns joined by bars; null columns are skipped."""
    return F.md5(F.concat_ws("|", *columns))


def portable_hash(*columns: str | Column) -> Column:
    """The first 32 bits of a row's digest as a whole number, alike in every engine."""
    return F.conv(F.substring(row_digest(*columns), 1, 8), 16, 10).cast("long")


def weekday(date: Column) -> Column:
    """Sunday 0 to Saturday 6."""
    return F.dayofweek(date) - 1


def numbered(df: DataFrame, *order: str, name: str = "row_number", after: int = 0) -> DataFrame:
    """``df`` with the numbers after+1, after+2, ... in order of columns that no two rows share, without one task seeing all rows.

    Rows are range sorted and stored; a partition's first number is one more than the rows before it.
    """
    placed = stored(df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before, starts = after, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("__part").count().collect()):  # a row for each partition
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __before long")
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__before") + 1).drop("__part", "__at", "__before")
