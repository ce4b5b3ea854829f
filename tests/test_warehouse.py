"""Every warehouse query against its DuckDB oracle, and the invariants that hold between them."""

import datetime
import random
from decimal import Decimal
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomhouse import session
from loomhouse.functions import numbered, rounded
from loomhouse.operators import checks, fanout, history, snapshots, timing
from loomhouse.plans import analytics, nightly, timelines
from loomhouse.plans.oracle import DECIMALS
from loomhouse.plans.warehouse import warehouse

SF = "/root/testdata/sf0.001"
NAMES = sorted(analytics.QUERIES | timelines.QUERIES | nightly.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    return v.date() if isinstance(v, datetime.datetime) and v.time() == datetime.time() else v


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.oracle_sql())
    assert set(DECIMALS) <= set(NAMES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_wide_equals_narrow(spark):
    q = entry.queries()
    for n in (1, 2, 3, 4):
        assert rows(q[f"b{n}_wide"](spark, SF)) == rows(q[f"b{n}_narrow"](spark, SF))


def test_fixes_equal_the_baseline_and_broken_joins_inflate(spark):
    got = {r["form"]: r for r in entry.queries()["f5_verification"](spark, SF).collect()}
    assert all(got[k]["matches"] for k in ("baseline", "latest", "summarised", "running"))
    assert not got["broken"]["matches"] and got["broken"]["inflation_pct"] > 0
    w = warehouse(spark, SF)
    with pytest.raises(fanout.InflationError):
        fanout.assert_no_inflation(w.fct_orders, w.fct_orders.join(w.promotions, "customer_id", "left"), "promotions")
    fanout.assert_no_inflation(w.fct_orders, fanout.attributed(w.fct_orders, w.promotions), "running")


def test_last_valid_day_belongs_to_the_inclusive_join_only(spark):
    day = lambda s: datetime.date.fromisoformat(s)
    versions = spark.createDataFrame(
        [(1, 7, "a", "b", "c", day("2020-01-01"), day("2020-02-28"), False), (2, 7, "a", "b", "d", day("2020-02-29"), None, True)],
        "customer_key long, customer_id long, region string, country string, segment string, valid_from date, valid_to date, is_current boolean",
    )
    fact = spark.createDataFrame([(7, day(d)) for d in ("2020-02-27", "2020-02-28", "2020-02-29")], "customer_id long, order_date date")
    assert history.as_of(fact, versions).count() == 2
    assert sorted(r["segment"] for r in history.as_of(fact, versions, inclusive=True).collect()) == ["c", "c", "d"]


def test_feed_equals_one_record_after_the_other(spark):
    rng = random.Random(5)
    base = [(k + 1, k, rng.choice("NS"), rng.choice("xy"), rng.choice("AB")) for k in range(12)]
    start = datetime.date(2020, 1, 1)
    feed = [(i + 1, rng.randrange(12), *(rng.choice([None, "", *pool]) for pool in ("NS", "xy", "AB")), start + datetime.timedelta(rng.randrange(400))) for i in range(40)]
    versions = [[k, c, r, n, s, start, None, True] for k, c, r, n, s in base]
    for _, customer, *new, date in feed:
        now = next(v for v in versions if v[1] == customer and v[7])
        filled = [a or b for a, b in zip(new, now[2:5], strict=True)]
        if filled != now[2:5]:
            now[6], now[7] = date - datetime.timedelta(1), False
            versions.append([max(v[0] for v in versions) + 1, customer, *filled, date, None, True])
    dim = spark.createDataFrame(base, "customer_key long, customer_id long, region string, country string, segment string")
    records = spark.createDataFrame(feed, "seq long, customer_id long, region string, country string, segment string, change_date date")
    got = history.apply_feed(history.initial_load(dim, "2020-01-01"), records).select(*history.COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, versions))
    half = records.filter("seq <= 20"), records.filter("seq > 20")
    twice = history.apply_feed(history.apply_feed(history.initial_load(dim, "2020-01-01"), half[0]), half[1])
    assert sorted(map(tuple, twice.select(*history.COLUMNS).collect())) == sorted(map(tuple, versions))


def test_deltas_and_replay_equal_the_nightly_loop(spark):
    w = warehouse(spark, SF)
    state = {n: {} for n in range(1, 31)}
    for r in entry.queries()["n3_true_states"](spark, SF).collect():
        state[r["night_number"]][r["customer_id"]] = (r["region"], r["country"], r["segment"])
    tracked, found = dict(state[1]), set()
    for night in range(2, 31):
        if night in snapshots.FAILED:
            continue
        for c, s in state[night].items():
            if tracked[c] != s:
                found.add((night, c, *s))
                tracked[c] = s
    assert {tuple(r[c] for c in ("night_number", "customer_id", "region", "country", "segment")) for r in w.incremental_deltas.collect()} == found
    for night in (11, 13, 30):
        replay = snapshots.replayed(w.incremental_base_snapshot, w.incremental_deltas, night)
        assert {r["customer_id"]: (r["region"], r["country"], r["segment"]) for r in replay.collect()} == state[night]


def test_upsert_is_idempotent(spark):
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, n long, v string")
    two = spark.createDataFrame([(2, 1, "c"), (3, 1, "d")], "k long, n long, v string")
    once = snapshots.upserted(one, two, ["k", "n"])
    assert rows(once) == rows(snapshots.upserted(once, two, ["k", "n"])) == [(1, 1, "a"), (2, 1, "c"), (3, 1, "d")]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    assert checks.duplicate_keys(df, "k").first()[0] == 1
    with pytest.raises(ValueError):
        checks.assert_check("unique", checks.duplicate_keys(df, "k"))
    checks.assert_check("none", checks.duplicate_keys(df, "v"))
    assert checks.checksum(df, "k", "v").first() == checks.checksum(df.orderBy(F.desc("v")), "k", "v").first()
    assert checks.orphans(df, spark.createDataFrame([(1,)], "k long"), "k").first()[0] == 1


def test_rounding_and_numbers(spark):
    df = spark.createDataFrame([(5, 2, 1), (-5, 2, 2), (1, 3, 3), (1, 0, 4), (None, 2, 5)], "n long, d long, i long")
    got = [r["x"] for r in df.orderBy("i").select(rounded(F.col("n"), F.col("d"), 0).alias("x")).collect()]
    assert got == [Decimal(3), Decimal(-3), Decimal(0), None, None]
    assert [(r["i"], r["no"]) for r in numbered(df, "i", name="no", after=10).orderBy("i").collect()] == [(i, 10 + i) for i in range(1, 6)]
    assert numbered(df.limit(0), "i").count() == 0


def test_generated_lines(spark):
    from loomhouse.sources import generated_lines

    got = generated_lines(spark, 1000)
    assert rows(got) == rows(generated_lines(spark, 1000))
    assert got.filter("quantity between 1 and 10 and unit_price between 5 and 205 and customer_id between 1 and 10000 and product_id between 1 and 500").count() == 1000


def test_integrity_counts_each_planted_fault(spark):
    """A day in two versions, equal starts, containment, inverted ends, two current versions, an open one that is not current."""
    day = datetime.date
    versions = [
        (1, 1, day(2020, 1, 1), day(2020, 2, 28), False), (2, 1, day(2020, 2, 28), None, True),
        (3, 2, day(2020, 1, 1), day(2020, 2, 28), False), (4, 2, day(2020, 1, 1), None, True),
        (5, 3, day(2020, 1, 1), day(2020, 12, 31), False), (6, 3, day(2020, 3, 1), day(2020, 4, 1), False),
        (7, 4, day(2020, 2, 1), day(2020, 1, 1), False),
        (8, 5, day(2020, 1, 1), None, True), (9, 5, day(2021, 1, 1), None, True),
        (10, 6, day(2020, 1, 1), None, False),
        (11, 7, day(2020, 1, 1), day(2020, 1, 31), False), (12, 7, day(2020, 2, 1), None, True),
    ]
    df = spark.createDataFrame(versions, "customer_key long, customer_id long, valid_from date, valid_to date, is_current boolean")
    assert {r["check_name"]: r["violations"] for r in history.integrity(df).collect()} == {"duplicate_current": 1, "open_not_current": 1, "overlapping_ranges": 2, "shared_days": 4, "inverted_ranges": 1}
    planted = {r["check_name"]: r["violations"] for r in entry.queries()["s5_integrity_of_faulty"](spark, SF).collect()}
    assert all(planted.values())


def test_a_feed_for_unknown_customers_is_refused(spark):
    w = warehouse(spark, SF)
    more = w.feed.limit(3).withColumn("customer_id", F.lit(-5).cast("long"))
    with pytest.raises(ValueError, match="-5"):
        history.apply_feed(w.initial_scd2, w.feed.unionByName(more))
    kept = history.apply_feed(w.initial_scd2, w.feed.unionByName(more), skip_unmatched=True)
    assert rows(kept) == rows(w.dim_customer_scd2)


def test_current_state(spark):
    w = warehouse(spark, SF)
    one = w.dim_customer.select("customer_id").first()[0]
    assert history.current_state(w.dim_customer_scd2, one)["customer_id"] == one
    with pytest.raises(ValueError, match="-1"):
        history.current_state(w.dim_customer_scd2, -1)


def test_all_changes(spark):
    schema = "customer_id long, region string, country string, segment string"
    before = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", "c"), (3, None, "b", "c")], schema)
    now = spark.createDataFrame([(1, "a", "b", "c"), (2, "x", "b", "c"), (4, "n", "n", "n")], schema)
    assert rows(snapshots.all_changes(now, before).select("customer_id", "change_type", "region")) == sorted([("update", 2, "x"), ("delete", 3, None), ("insert", 4, "n")], key=repr)


def test_parameters(spark):
    w = warehouse(spark, SF)
    one = w.fct_orders.agg(F.min("customer_id")).first()[0]
    assert {r["customer_id"] for r in timelines.s9_point_lookup(w, one).collect()} == {one}
    assert timelines.t6_segment_year(w, "MACHINERY", 1995).select("year").first()[0] == 1995
    assert nightly.c3b_fallback(w, 5).select("reconstructed_as_of_night").first()[0] == 5


def test_timing(spark):
    got = timing.timed(spark.range(10), runs=3, discard=1)
    assert got["mean"] > 0 and got["median"] > 0 and got["stdev"] >= 0 and timing.timed(spark.range(1), runs=1, discard=0)["stdev"] == 0.0
    assert timing.ratio(2.0, 3.0) == {"narrow_over_wide": 1.5, "winner": "wide"}
    assert timing.ratio(3.0, 1.5)["winner"] == "narrow" and timing.ratio(1.0, 1.01)["winner"] == "tie"


def test_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "a int, b int")
    assert rows(checks.no_duplicates(spark, "x", df, "a", "b")) == [("1 duplicates", "x", "FAIL")]
    assert rows(checks.no_duplicates(spark, "x", None, "a")) == [("no such table", "x", "SKIP")]
    moments = spark.createDataFrame([(datetime.datetime(2024, 1, 1),)], "at timestamp_ntz")
    fresh = lambda day, df=moments: checks.freshness(df, "at", F.expr(f"timestamp_ntz'2024-01-0{day}'"), F.make_dt_interval(F.lit(1))).first()["passed"]
    assert fresh(2) and not fresh(3) and not fresh(2, moments.limit(0))


def test_a_cluster_needs_a_shared_folder(spark):
    """A temporary folder is for local sessions alone."""
    unset = SimpleNamespace(getOrElse=lambda _: None)
    context = SimpleNamespace(master="spark://somewhere:7077", getConf=dict, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(sparkContext=context))
    with session.cleared(spark):
        path = session.shared_path(spark, "x")
        spark.range(3).write.parquet(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
