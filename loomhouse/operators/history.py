"""Type 2 history: applying a feed of changes as one window, and joins at a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomhouse.functions import numbered, row_digest
from loomhouse.session import stored

TRACKED = ("region", "country", "segment")
COLUMNS = ("customer_key", "customer_id", *TRACKED, "valid_from", "valid_to", "is_current")


def initial_load(dimension: DataFrame, epoch: str) -> DataFrame:
    """One open version of each customer, valid from the epoch on."""
    return dimension.select(
        "customer_key", "customer_id", *TRACKED, F.lit(epoch).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current")
    )


def current(history: DataFrame) -> DataFrame:
    return history.filter("is_current")


def detected(history: DataFrame, feed: DataFrame) -> DataFrame:
    """Each feed record beside its customer's current state, and whether it differs; blank attributes carry the current ones forward."""
    now = current(history).select("customer_id", *(F.col(c).alias(f"old_{c}") for c in TRACKED))
    joined = feed.join(now, "customer_id")
    filled = joined.select("seq", "customer_id", "change_date", *(f"old_{c}" for c in TRACKED), *(F.coalesce(F.nullif(F.col(c), F.lit("")), f"old_{c}").alias(c) for c in TRACKED))
    old, new = row_digest(*(f"old_{c}" for c in TRACKED)), row_digest(*TRACKED)
    return filled.select("seq", "customer_id", "change_date", old.alias("current_hash"), new.alias("incoming_hash"), F.when(old != new, "CHANGE DETECTED").otherwise("no change").alias("status"))


def unmatched(history: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed records of customers that the dimension doesn't have; these must not be applied silently."""
    return feed.join(history, "customer_id", "left_anti")


def current_state(history: DataFrame, customer: int) -> dict[str, object]:
    """The open version of one customer; an error if there is none."""
    got = current(history).filter(F.col("customer_id") == F.lit(customer)).select("customer_id", *TRACKED, "customer_key").first()
    if got is None:
        raise ValueError(f"customer {customer} has no current version")
    return got.asDict()


def apply_feed(history: DataFrame, feed: DataFrame, skip_unmatched: bool = False) -> DataFrame:
    """The history after all records of a feed, taken in order of ``seq``, as if one after the other.

    Records of customers without a current version are an error, unless ``skip_unmatched`` leaves them out.

    A record's blank attributes carry on from the state before it. A record that changes nothing leaves no version. A change closes the version before on
    the day before and opens the next; new versions get the keys after the largest one, in feed order. Customers without records keep their versions, whatever
    their number; the feed builds on open ones.
    """
    if not skip_unmatched and (lost := unmatched(current(history), feed).limit(5).collect()):
        raise ValueError(f"feed records of customers without a current version, such as {sorted(r['customer_id'] for r in lost)}")
    touched = feed.select("customer_id").distinct()
    base = current(history).join(touched, "customer_id", "left_semi").select("customer_id", F.lit(0).cast("long").alias("seq"), "customer_key", *TRACKED, "valid_from")
    records = feed.join(current(history), "customer_id", "left_semi").select(
        "customer_id", "seq", F.lit(None).cast("long").alias("customer_key"), *(F.nullif(F.col(c), F.lit("")).alias(c) for c in TRACKED), F.col("change_date").alias("valid_from")
    )
    order = Window.partitionBy("customer_id").orderBy("seq")
    filled = base.unionByName(records).withColumns({c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in TRACKED})
    hashed = filled.withColumn("hash", row_digest(*TRACKED))
    kept = hashed.withColumn("before", F.lag("hash").over(order)).filter("before is null or hash <> before")
    following = F.lead("valid_from").over(order)
    versions = stored(kept.withColumns({"valid_to": F.date_sub(following, 1), "is_current": following.isNull()}), "versions")
    largest = history.agg(F.max("customer_key")).first()[0] or 0
    fresh = numbered(versions.filter("seq > 0").drop("customer_key"), "seq", name="customer_key", after=largest)
    marked = history.join(touched.withColumn("touched", F.lit(True)), "customer_id", "left").filter("touched is null or not is_current")
    return stored(marked.select(*COLUMNS), "untouched").unionByName(versions.filter("seq = 0").select(*COLUMNS)).unionByName(fresh.select(*COLUMNS))


def valid_at(date: Column, inclusive: bool = False) -> Column:
    """Whether a version holds on a date. Ends are the last valid day; the strict form, kept for parity, loses that day."""
    end = date <= F.col("valid_to") if inclusive else date < F.col("valid_to")
    return (date >= F.col("valid_from")) & (end | F.col("valid_to").isNull())


def as_of(fact: DataFrame, history: DataFrame, date: str = "order_date", inclusive: bool = False, how: str = "inner") -> DataFrame:
    """The fact with the version of its customer at its date: an equi-join with the range as its residual condition."""
    versions = history.withColumnsRenamed({"customer_id": "version_of", "customer_key": "version_key"})
    return fact.join(versions, (F.col("customer_id") == F.col("version_of")) & valid_at(F.col(date), inclusive), how)


def integrity(history: DataFrame) -> DataFrame:
    """(check_name, violations) of a history. Ends are the last valid day, so that a version that starts on another's last day overlaps it.

    ``overlapping_ranges`` counts pairs in which one starts later than another and by its end at the latest; open versions and equal starts are not
    looked at. ``shared_days`` counts all pairs of versions that share a day.
    """
    one = history.select("customer_key", "customer_id", "valid_from", "valid_to")
    two = one.withColumnsRenamed({"customer_key": "k", "customer_id": "c", "valid_from": "f", "valid_to": "t"})
    pair = F.col("customer_id") == F.col("c")
    overlap = pair & (F.col("customer_key") != F.col("k")) & (F.col("f") > F.col("valid_from")) & (F.col("f") <= F.col("valid_to"))
    far = F.lit("9999-12-31").cast("date")
    shared = pair & (F.col("customer_key") < F.col("k")) & (F.col("f") <= F.coalesce("valid_to", far)) & (F.col("valid_from") <= F.coalesce("t", far))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    return (
        count(current(history).groupBy("customer_id").count().filter("count > 1"), "duplicate_current")
        .unionByName(count(history.filter("valid_to is null and not is_current"), "open_not_current"))
        .unionByName(count(one.join(two, overlap), "overlapping_ranges"))
        .unionByName(count(one.join(two, shared), "shared_days"))
        .unionByName(count(history.filter("valid_to < valid_from"), "inverted_ranges"))
    )


def faulty(history: DataFrame) -> DataFrame:
    """An initial history with planted faults, by the last digit of a customer's number: 1 a day in two versions, 2 equal starts, 3 one version
    inside another, 4 an end before its start, 5 two current versions, 6 an open version that is not current."""
    digit, day = F.col("customer_id") % 10, lambda d: F.lit(d).cast("date")
    first_end = F.when(digit == 1, day("1996-06-30")).when(digit == 2, day("1995-12-31")).when(digit == 3, day("1997-12-31")).when(digit == 4, day("1994-12-31"))
    first = history.withColumns({"valid_to": first_end, "is_current": (digit == 5) | ~digit.isin(1, 2, 3, 4, 6)})
    second_start = F.when(digit == 1, day("1996-06-30")).when(digit == 2, day("1995-01-01")).when(digit == 3, day("1996-01-01")).otherwise(day("1998-01-01"))
    second = history.filter(digit.isin(1, 2, 3, 5)).withColumns(
        {"customer_key": F.col("customer_key") + 1_000_000, "valid_from": second_start, "valid_to": F.when(digit == 3, day("1996-12-31")), "is_current": digit != 3}
    )
    return first.unionByName(second)
