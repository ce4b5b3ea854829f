"""Each corpus operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomhouse.llm import decontamination, exact_dedup, golay, language_id, lm_scoring, shared, simhash_golay, source_mixing, substring_dedup, token_output, url_filters, warc_fixity, words
from loomhouse.llm.components import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, row string"
RNG = random.Random(3)
VOCABULARY = ["the", "The", "of", "zebra,", "été", "ÉTÉ", "x", "日本", "a.b", "don't"]
LONG = " ".join(RNG.choice(VOCABULARY) for _ in range(60_000))
PASSAGE = " ".join(f"w{i}" for i in range(70))


def case(i, text, lang="en", source="s"):
    return (i, text, lang, source, None, 7, True, "r")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, white space, ties, repeated rows, null ids, a very long text, shared passages, and columns that clash with new ones."""
    rows = [case(1, None), case(2, ""), case(3, " \t\n"), case(4, "The the THE"), case(5, "the  the\tthe"), case(5, "the  the\tthe"), case(6, LONG), case(7, "x " + LONG), case(None, "of zebra"), case(None, None), case(8, PASSAGE)]
    rows += [case(9, f"before {PASSAGE} after"), case(10, f"{PASSAGE} {PASSAGE}"), case(11, "a b c d e"), case(11, "a b c d f"), case(12, "x" * 200_000), case(13, "Été été", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# words


@pytest.mark.parametrize("piece", [1, 7, 1 << 17])
def test_words_equal_the_regular_expression(piece, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(words, "PIECE", piece)
    monkeypatch.setattr(words, "SLICE", 50)
    texts = ["a b\nc  d", "", None, " x", "y ", " z zz ", "é q  w\x0b", "long" * 40 + " y"]
    for lo, hi, w in words.slices(pa.array(texts)):
        for i in range(lo, hi):
            a, b = w.first[i - lo], w.first[i - lo + 1]
            assert [bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] == brute.words(texts[i])


def test_equal_words_alone_have_equal_keys():
    import pyarrow as pa

    texts = [str(i) * (i % 5 + 1) for i in range(3000)]
    got = {}
    for lo, _, w in words.slices(pa.array([" ".join(texts), " ".join(reversed(texts))])):
        assert lo == 0
        for s, e, k in zip(w.start, w.end, w.key, strict=True):
            got.setdefault(bytes(w.data[s:e]), set()).add(int(k))
    assert all(len(k) == 1 for k in got.values()) and len({k for ks in got.values() for k in ks}) == len(set(texts))


# 1


def scores(df):
    return sorted(((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"head_words": 2}, {"max_filter_bytes": 0, "cell_bytes": 9000, "slice_bytes": 3000}])
def test_base_scores(odd, options):
    got = lm_scoring.score_texts(odd, F.coalesce(F.col("doc_id") != 7, F.lit(True)), **options)
    rows = odd.collect()
    counts = brute.model([r["text"] for r in rows if r["doc_id"] != 7])
    want = []
    for r in rows:
        n, known, base = brute.base_score(counts, r["text"])
        want.append((r["doc_id"], n, known, round(base, 6)))
    assert scores(got) == sorted(want, key=repr)
    assert {r["train_tokens"] for r in got.collect()} == {sum(counts.values())}
    assert {"lang", "kept", "row"} <= set(got.columns)


def by_id(df):
    return sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("order", [2, 3])
def test_both_ways_give_the_same_scores(spark, odd, order):
    """The filter broadcast, or probed where its cells are, in few cells and many."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.filter("doc_id < 6 or doc_id is null").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    one = by_id(lm_scoring.score_texts(docs, F.col("doc_id") % 3 != 0, order=order, cell_bytes=20_000))
    for options in ({"max_filter_bytes": 0, "slice_bytes": 50_000}, {"max_filter_bytes": 200_000, "head_words": 2}):
        more = by_id(lm_scoring.score_texts(docs, F.col("doc_id") % 3 != 0, order=order, cell_bytes=20_000, **options))
        assert [x[:3] for x in one] == [x[:3] for x in more]
        for k in (3, 4):
            assert [x[k] for x in more] == pytest.approx([x[k] for x in one], rel=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_the_quantised_counts(spark, odd, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).unionByName(odd.filter("doc_id < 6 or doc_id in (8, 13)").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = [tuple(r) for r in docs.collect()]
    texts = [t for i, t in rows if i % 3]
    got = lm_scoring.score_texts(docs, F.col("doc_id") % 3 != 0, order=order, bits_each=4000.0)
    want = sorted((repr(i), brute.lm_score(texts, t, order, 1.5, 64.0)) for i, t in rows)
    assert [(x[0], x[4]) for x in by_id(got)] == [(i, pytest.approx(s, rel=1e-9)) for i, s in want]


def test_a_full_filter_ends(spark):
    """A filter far too small finds every key at the highest level of its cell, and there probing ends."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(50)
    for options in ({}, {"max_filter_bytes": 0}):
        assert lm_scoring.score_texts(docs, F.col("doc_id") % 2 == 0, bits_each=0.01, **options).filter("score < 0").count() == 50
    full = lm_scoring.Filter({0: (7, np.full(3, (1 << 64) - 1, np.uint64))}, 5, fold=False)
    assert full.levels(np.arange(9, dtype=np.uint64)).tolist() == [7] * 9


def test_a_cell_probes_a_key_once_however_many_slices_ask(monkeypatch):
    keys, probed, levels = np.unique(np.random.default_rng(2).integers(0, 1 << 32, 1000, dtype=np.uint32)), [], lm_scoring.Filter.levels
    monkeypatch.setattr(lm_scoring.Filter, "levels", lambda self, asked: probed.append(len(asked)) or levels(self, asked))
    rows = [(3, s, lm_scoring.GRAMS, keys[s:].tobytes(), zlib.compress(np.full(len(keys) - s, s % 2, "<u4").tobytes())) for s in range(50)]
    table = pa.Table.from_batches([lm_scoring.rows_of(lm_scoring._PARTS, rows)])
    got = lm_scoring._answer(1.5, 4000.0, 5)((pa.scalar(3),), table).to_pylist()
    counts = np.array([len([s for s in range(1, 50, 2) if s <= i]) for i in range(len(keys))])
    want = np.where(counts > 0, lm_scoring.quantised(np.maximum(counts, 1), 1.5), 0)
    assert [list(x["levels"]) for x in got if x["slice"] >= 0] == [want[s:].tolist() for s in range(50)]
    assert sum(probed) == len(keys)


def test_cells_answer_rows_are_streamed_and_columns_of_any_type_return(spark):
    """A slice's answers are neither gathered in one row nor joined; settings are as before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    typed = docs.selectExpr("*", "timestamp_seconds(doc_id) as t", "cast(doc_id as decimal(9, 2)) as d", "array(left(text, 3), null) as a", "named_struct('x', doc_id, 'y', date'2024-01-01') as s", "cast(null as binary) as b")
    settings = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = [spark.conf.get(k, None) for k in settings]
    one, more = (lm_scoring.score_texts(typed, F.col("doc_id") % 3 != 0, **options) for options in ({}, {"max_filter_bytes": 0, "slice_bytes": 20_000}))
    assert [spark.conf.get(k, None) for k in settings] == before
    plan = more._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Join" not in plan
    assert one.schema == more.schema
    assert [x[:8] for x in sorted(map(tuple, more.collect()))] == [x[:8] for x in sorted(map(tuple, one.collect()))]


def test_model_beats_the_base_on_held_out_texts_and_is_a_distribution(spark):
    got = entry.queries()["op1_lm_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    alphabet = ["a", "b", "c"]
    texts = [f"{x} {y}" for x in alphabet for y in alphabet] + ["a b"] * 5
    one = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ask = spark.createDataFrame([(100 + i, f"a {w}".strip()) for i, w in enumerate(["", *alphabet])], "doc_id long, text string")
    got = lm_scoring.score_texts(one.unionByName(ask), F.col("doc_id") < 100).filter("doc_id >= 100").collect()
    assert sum(10 ** r["score"] for r in got) <= 1


def test_filter_never_loses_a_count():
    rng, bits = np.random.default_rng(1), 10
    keys = (rng.integers(0, 1 << 32, 5000, dtype=np.uint64) << np.uint64(22)) | np.uint64(5 << 54)
    inner, counts = lm_scoring.folded(keys, bits).astype(np.uint64), rng.integers(1, 2000, 5000)
    f = lm_scoring.Filter({int(keys[0] >> np.uint64(64 - bits)): (99, lm_scoring.piece(inner, counts, 1.5, 10))}, bits, fold=True)
    level = f.levels(keys)
    assert (level >= lm_scoring.quantised(counts, 1.5)).all()
    assert (level == lm_scoring.quantised(counts, 1.5)).mean() > 0.95
    assert (lm_scoring.least(lm_scoring.quantised(counts, 1.5), 1.5) <= counts).all() and (counts <= lm_scoring.most(lm_scoring.quantised(counts, 1.5), 1.5)).all()


def test_nothing_to_learn_or_score(odd, empty):
    assert lm_scoring.score_texts(empty, F.lit(True)).count() == 0
    assert {(r["n_known"], r["train_tokens"]) for r in lm_scoring.score_texts(odd, F.lit(False)).collect()} == {(0, 0)}


# 2, 4, 5, 6 and the SQL


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    assert pairs(df, *df.columns) == sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)


def test_url_rules(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/en/1", "block"), ("a.b", "", "block"), ("a.b", "", "allow"), (None, "/", "block")], "host string, path string, action string")
    urls = [None, "", "no scheme", "http://EXAMPLE.org/en/12?q", "http://x.example.org/en/2", "http://example.org", "s://a.b#f", "s://notexample.org/en/1", "s://org.com/", "http://" + "a." * 5000 + "org/" + "p" * 50_000, "x://y://z.org/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    got = pairs(url_filters.filter_urls(pages, rules), "page_id", "rule", "verdict")
    want = [(0, None, "allow"), (1, None, "allow"), (2, None, "allow"), (3, "example.org/en/1", "block"), (3, "example.org/en/1", "block"), (4, "org/", "allow"), (5, None, "allow"), (6, "a.b", "block"), (7, "org/", "allow"), (8, None, "allow"), (9, "org/", "allow"), (10, None, "allow")]
    assert got == sorted(want, key=repr)
    assert url_filters.filter_urls(pages, rules.limit(0), default="block").filter("verdict = 'block'").count() == len(urls) + 1
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0


def test_urls_meet_rules_by_the_prefix_alone(spark, monkeypatch):
    """The join's key is the hash prefix; with a prefix that all share, the full digests still part the rules."""
    rules = spark.createDataFrame([("a", "/x", "block"), ("b", "/", "block"), ("a", "b", "block"), ("ab", "", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "s://a/xy"), (2, "s://b/"), (3, "s://c.ab"), (4, "s://c/")], "page_id long, url string")
    plans = []
    monkeypatch.setattr(url_filters, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or shared.written(df, name))
    url_filters.filter_urls(pages, rules)
    joins = [x for x in plans[0].splitlines() if "Join Inner" in x]
    assert joins and all("__prefix" in x and "__digest" not in x for x in joins)
    monkeypatch.setattr(url_filters.F, "substring", lambda c, a, n, real=url_filters.F.substring: F.lit("0") if isinstance(c, str) and c == "__digest" else real(c, a, n))
    for most in (0, 1000):
        assert pairs(url_filters.filter_urls(pages, rules, max_broadcast_sites=most), "page_id", "rule") == [(1, "a/x"), (2, "b/"), (3, "ab"), (4, None)]


@pytest.mark.parametrize("options", [{}, {"bits_each": 0}, {"section_rows": 4, "max_field_bytes": 300, "max_broadcast_groups": 0}])
def test_exact_copies(odd, empty, options):
    got = exact_dedup.mark_copies(odd, **options)
    normal = lambda t: hashlib.sha256(brute.re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = {}
    for r in odd.collect():
        groups.setdefault(normal(r["text"]), []).append(r["doc_id"])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want = [(i, least(ids), len(ids), h) for h, ids in groups.items() for i in ids]
    assert pairs(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    assert pairs(got.filter("kept"), "text_sha256") == sorted((h,) for h in groups)
    assert "row" in got.columns and exact_dedup.mark_copies(empty).count() == 0


def test_mixing(spark, odd, empty):
    plan = source_mixing.plan_mix(odd.withColumn("size", F.lit("x")))
    assert pairs(plan, "doc_id", "size") == sorted(((r["doc_id"], len(brute.words(r["text"]))) for r in odd.collect()), key=repr)
    assert source_mixing.plan_mix(empty).count() == 0
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 7) end").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"))
    plan = source_mixing.plan_mix(docs)
    by = plan.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("source_size").alias("size")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.1 * r["target"] and r["target"] <= 2 * r["size"] for r in by)
    assert abs(sum(r["target"] for r in by) - 1.5 * sum(r["size"] for r in by)) < 1
    assert plan.filter("copies > 2").count() == 0 and pairs(plan, "doc_id", "copies") == pairs(source_mixing.plan_mix(docs.repartition(3)), "doc_id", "copies")
    assert source_mixing.mixed(docs).count() == plan.agg(F.sum("copies")).first()[0]


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "body é " * (i % 40)) for i in range(700)] + [(None, None, None), (5, "http://a/5", "body é " * 5)], "page_id long, url string, html string")
    placed = warc_fixity.archived(pages, records_each=100)
    placed = shared.written(placed.select("archive", "offset", "length", "page_id", "record"), "placed")
    ends = placed.groupBy("archive").agg(F.max(F.col("offset") + F.col("length")).alias("end"), F.sum("length").alias("sum"))
    assert ends.filter("end <> sum").count() == 0
    assert warc_fixity.audit(placed, placed).count() == 0 and warc_fixity.audit(placed.limit(0), placed.limit(0)).count() == 0
    other = placed.filter("page_id is null or page_id <> 17").withColumn("record", F.when(F.col("page_id") == 400, F.concat("record", F.lit("!"))).otherwise(F.col("record")))
    extra = other.limit(1).withColumn("offset", F.lit(10**7).cast("long"))
    got = warc_fixity.audit(placed, other.unionByName(extra)).join(placed.select("archive", "offset", "page_id"), ["archive", "offset"], "left")
    assert pairs(got, "page_id", "state") == sorted([(17, "missing"), (400, "corrupt"), (None, "extra")], key=repr)
    assert warc_fixity.audit(placed.limit(0), placed).filter("state <> 'extra'").count() == 0


def test_archives_hold_every_byte(spark, odd, empty, tmp_path):
    """Payloads that are not text, clashing columns, equal rows, and archives as files."""
    rows = [(i % 3, None if i == 4 else f"http://a/{i}", bytes([i % 256, 255, 10, 13]) * (i % 7), "old", 5, i) for i in range(40)] + [(7, "u", b"same", "old", 5, 0)] * 30
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary, record string, offset int, c0 int")
    placed = shared.written(warc_fixity.archived(pages, records_each=16), "placed")
    assert placed.groupBy("archive").count().filter("count > 16").count() == 0 and placed.count() == 70 and placed.filter("c0 = 39").count() == 1
    warc_fixity.write_archives(placed, f"{tmp_path}/a")
    back = warc_fixity.read_archives(spark, f"{tmp_path}/a")
    key = lambda df: sorted((r["archive"], r["offset"], r["length"], bytes(r["record"])) for r in df.collect())
    assert key(back) == key(placed) and all(x[2] == len(x[3]) for x in key(placed))
    assert warc_fixity.audit(placed, back).count() == 0
    assert warc_fixity.archived(empty.select("doc_id", "source", "text"), "doc_id", "source", "text").count() == 0
    long = warc_fixity.archived(odd.select("doc_id", "source", "text"), "doc_id", "source", "text")
    assert long.agg(F.max("length")).first()[0] > 200_000
    warc_fixity.write_archives(placed.limit(0), f"{tmp_path}/b")
    assert warc_fixity.read_archives(spark, f"{tmp_path}/b").count() == 0


def test_a_damaged_header_costs_its_record_alone():
    whole = [b"WARC/1.1\r\nContent-Length: 3\r\n\r\n" + x + b"\r\n\r\n" for x in (b"abc", b"\r\n\r", b"xyz")]
    assert [x for _, x in warc_fixity.split_records(b"".join(whole))] == whole
    spoilt = [whole[0].replace(b"3", b"?"), whole[1], whole[2][:-1]]
    assert [x for _, x in warc_fixity.split_records(b"".join(spoilt))] == spoilt


def test_records_without_a_place(spark):
    """Null archives and offsets are compared with each other, beside real ones of -1, and the audit ends."""
    schema = "archive long, offset long, record binary"
    ours = spark.createDataFrame([(None, None, b"a"), (None, None, b"a"), (1, None, b"b"), (None, 4, b"c"), (-1, -1, b"d"), (2, -5, b"e"), (3, 1 << 50, b"f"), (1, 0, None)], schema)
    theirs = spark.createDataFrame([(None, None, b"a"), (1, None, b"B"), (None, 4, b"c"), (-1, -1, b"d"), (2, -5, b"E"), (3, 1 << 50, b"f"), (1, 0, b"")], schema)
    got = pairs(warc_fixity.audit(ours, theirs), "archive", "offset", "state")
    assert got == sorted([(None, None, "corrupt"), (1, None, "corrupt"), (2, -5, "corrupt")], key=repr)
    only = ours.filter("offset is null")
    assert warc_fixity.audit(only, only).count() == 0
    assert pairs(warc_fixity.audit(only, only.limit(0)), "archive", "offset", "state") == sorted([(None, None, "missing"), (1, None, "missing")], key=repr)


# 3


def test_best_run():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, text = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64)
        d, start = decontamination.best_run(item, text, 99)
        assert d == brute.best_run(item, text)
        assert min(brute.distance(item, text[start:e]) for e in range(start, len(text) + 1)) == d


def edited(rng, words_, n):
    out = list(words_)
    for p in sorted(rng.sample(range(len(out)), n), reverse=True):
        kind = rng.randrange(3)
        out[p : p + 1] = [[], ["zz"], [out[p], "yy"]][kind]
    return out


def test_recall_and_clean_documents(spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    clean = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rng, rows, want = random.Random(4), [], {}
    for share in (0, 0.05, 0.1, 0.2):
        for i, item in enumerate(items):
            w = brute.re.findall(r"[^\W_]+", item)
            body = " ".join(edited(rng, w, int(share * len(w))))
            host = clean[i % len(clean)].split()
            at = rng.randrange(len(host) + 1)
            want[len(rows)] = (share, i)
            rows.append((len(rows), " ".join(host[:at]) + " " + (body.upper() if i % 3 == 0 and body.isascii() else body) + ". " + " ".join(host[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()}
    for share, least in ((0, 1.0), (0.05, 1.0), (0.1, 1.0), (0.2, 1.0)):
        mine = [(d, i) for d, (s, i) in want.items() if s == share]
        assert sum(x in got for x in mine) >= least * len(mine), share
    blocks = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench, items_each=7).collect()}
    assert blocks == got


def test_every_item_at_the_similarity_is_found(spark):
    """Recall at similarity 0.8 is 1: seeds miss no item with a fifth of its words edited, short and long ones, with every kind of edit."""
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    items += [" ".join(f"v{k}x{i}" for i in range(k)) for k in (5, 6, 9, 10, 11, 14, 15, 64, 65, 130, 300)]
    index = decontamination.Index([*range(len(items))], items, decontamination.Samples(4, 10), 5)
    rng, before = random.Random(6), np.arange(1, 101, dtype=np.uint64)
    for i, item in enumerate(index.words):
        for share in (0.1, 0.15, 0.2, 0.2, 0.2):
            body = list(item)
            for at in sorted(rng.sample(range(len(body)), int(share * len(body) + 1e-9)), reverse=True):
                body[at : at + 1] = [[], [np.uint64(7)], [body[at], np.uint64(8)]][rng.randrange(3)]
            key = np.concatenate((before, np.array(body, np.uint64), before))
            got = {(t, j): d for t, j, d, _ in decontamination.matches(index, key, np.array([0, 100, 100 + len(body), len(key)]), 0.8)}
            assert got.get((1, i), 999) <= 0.2 * len(item) + 1e-9, (i, share)


def test_walks_alone_reach_their_target():
    """At least 0.9 at similarity 0.8, the contract's bound, without the seeds; no window within it is pruned."""
    items = [r.as_py() for r in pq.read_table(f"{SF}/benchmark.parquet").column("text")]
    index = decontamination.Index([*range(len(items))], [t.lower() for t in items], decontamination.Samples(4, 10), 5)
    index.seeds, rng, before = {}, random.Random(9), np.arange(1, 101, dtype=np.uint64)
    for share, least in ((0.1, 0.97), (0.15, 0.95), (0.2, 0.9)):
        found = 0
        for i, item in enumerate(index.words * 8):
            body = list(item)
            for at in sorted(rng.sample(range(len(body)), int(share * len(body) + 1e-9)), reverse=True):
                body[at : at + 1] = [[], [np.uint64(7)], [body[at], np.uint64(8)]][rng.randrange(3)]
            key = np.concatenate((before, np.array(body, np.uint64), before))
            assert index.likely(key)[100 : 101 + len(body) // 4].any()
            found += (1, i % len(items)) in {(t, j) for t, j, _, _ in decontamination.matches(index, key, np.array([0, 100, 100 + len(body), len(key)]), 0.8)}
        assert found >= least * 8 * len(items), share


def test_items_without_their_first_words_at_the_start_of_a_document(spark):
    """The implied start lies in the text before; the leak is in the text after it."""
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    index = decontamination.Index([*range(len(items))], items, decontamination.Samples(4, 10), 5)
    before, found = np.arange(1, 201, dtype=np.uint64), 0
    for i, item in enumerate(index.words):
        key = np.concatenate((before, item[3:], before))
        got = {(t, j): d for t, j, d, _ in decontamination.matches(index, key, np.array([0, 200, 200 + len(item) - 3, len(key)]), 0.8)}
        assert got.keys() <= {(1, i)} and got.get((1, i), 3) == 3
        found += len(got)
    assert found >= 0.85 * len(items)


def test_every_reported_leak_is_one_and_odd_texts(spark, odd, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "the"), (4, ""), (5, PASSAGE), (None, "The the of zebra x x")], "item_id long, text string")
    got = decontamination.find_leaks(odd, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(8, 1), (9, 5), (10, 1)}
    split = lambda t: brute.re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    texts, names = {r["doc_id"]: r["text"] for r in odd.collect()}, {1: PASSAGE, 5: PASSAGE}
    for r in got:
        if r["doc_id"] in (8, 9, 10) and r["item_id"]:
            assert r["distance"] == brute.best_run(split(names[r["item_id"]]), split(texts[r["doc_id"]]))
    assert decontamination.find_leaks(empty, items).count() == 0 and decontamination.find_leaks(odd, items.limit(0)).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "quite short"), (2, "今天的天气非常好我们一起去公园散步吧"), (3, "วันนี้อากาศดีมากเราไปเดินเล่นกัน"), (4, "alone"), (5, "...")]
    rows = [(1, "It is Quite, short."), (2, "quite very short"), (3, "他说今天的天气非常好我们去公园散步吧然后走了"), (4, "เขาพูดว่าวันนี้อากาศดีมากเราไปเดินเล่นกันแล้ว"), (5, "今天下雨"), (6, "alone"), (7, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.find_leaks(docs, bench).collect())
    assert got == [(1, 1, 0), (3, 2, 2), (4, 3, 0), (6, 4, 0)]


# 7


def test_golay():
    assert len(np.unique(golay.decode(np.arange(1 << 16)))) > 1
    x = np.random.default_rng(1).integers(0, 1 << 23, 400)
    near, first = golay.nearby(x)
    assert set(first.sum(1)) <= {1, 6}
    for a in range(23):
        for b in range(a + 1):
            other, _ = golay.nearby(x ^ (1 << a) ^ ((1 << b) if a != b else 0))
            assert all(set(p) & set(q) for p, q in zip(near[:40], other[:40], strict=True))


def test_near_groups(odd, empty):
    rows = odd.collect()
    prints = [brute.fingerprint(r["text"]) for r in rows]
    root = brute.linked(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r["doc_id"] is not None:
            least[root[p]] = min(least.get(root[p], r["doc_id"]), r["doc_id"])
    want = [(r["doc_id"], format(p, "016x"), least.get(root[p])) for r, p in zip(rows, prints, strict=True)]
    got = simhash_golay.near_groups(odd)
    assert pairs(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash_golay.near_groups(empty).count() == 0


@pytest.mark.parametrize("chunk", [1024, 6])
def test_dense_groups_of_fingerprints(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash_golay, "CHUNK", chunk)
    rng = random.Random(6)
    points = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            points.add(x)
            points.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    points = sorted(points)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    table = simhash_golay.written(spark.createDataFrame([(signed(p),) for p in points], "print long"), "points")
    got = {r["node"]: r["root"] for r in components(simhash_golay.linked(table)).collect()}
    want = brute.linked([signed(p) for p in points], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert all(got.get(p, p) == r for p, r in want.items())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (-3, 2000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[1000 + i] == 1000 for i in range(1, 50)) and got[2000] == -3
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 8


def test_languages(spark, odd, empty):
    got = entry.queries()["op8_language_id"](spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert held[0] > 0.97 and held[1] > 100
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got.collect())
    mine = {r["doc_id"]: r for r in language_id.identify(odd, F.lit(True)).collect()}
    assert all(mine[i]["lang_pred"] == "und" and mine[i]["score"] == 0 for i in (1, 2, 3)) and mine[6]["lang_pred"] == "en"
    assert language_id.identify(empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, F.lit(False)).collect()} == {"und"}


def test_a_rare_language_is_learnt_from_whole_texts(spark):
    """Rows that share id and text count once; of the rare language all rows are taken, and what tells it stands far into its texts."""
    rng = random.Random(5)
    some = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(40))
    rows = [(i, "aa", some("abcde")) for i in range(600)] + [(1000 + i, "zz", " " * 300 + some("uvwxyz")) for i in range(5)] + [(7, "aa", "equal")] * 900
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language_id.sample_texts(docs, F.lit(True), "text", "lang", "doc_id", 50)
    assert sorted({(lang, sum(x == lang for x, _ in got)) for lang, _ in got}) == [("aa", 50), ("zz", 5)]
    assert all(text.decode() in {t for _, _, t in rows} for _, text in got)
    ask = docs.limit(0).unionByName(spark.createDataFrame([(1, None, some("uvwxyz")), (2, None, some("abcde"))], docs.schema))
    network = language_id.trained(got)
    assert pairs(language_id.identify(ask, F.lit(False), model=network), "doc_id", "lang_pred") == [(1, "zz"), (2, "aa")]


def test_gradients():
    network = language_id.Network(["a", "b"], hidden=3)
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 101, (7, 4)).astype(np.intp), np.array([0, 1, 1, 0])

    def loss():
        p = network.shares(network.states(x).astype(np.float64))
        return -np.log(p[:, np.arange(4), y]).sum()

    keep = ([], [])
    states = network.states(x, keep)
    error = network.shares(states)
    error[:, np.arange(4), y] -= 1
    down = (error @ network.out.T).astype(np.float32)
    _, back = network.ways[0].learn(x, keep[0], down[:, :, :3])
    weights = network.ways[0].back
    for i, j in ((0, 1), (2, 7), (1, 4)):
        old, step = weights[i, j], 1e-2
        weights[i, j] = old + step
        up = loss()
        weights[i, j] = old - step
        down_ = loss()
        weights[i, j] = old
        assert abs((up - down_) / (2 * step) - back[i, j]) < 0.02 + 0.05 * abs(back[i, j])


def test_every_position_of_a_long_text_counts():
    network = language_id.Network(["a", "b"], hidden=4)
    data = np.frombuffer(("abc " * 500 + "zzz").encode(), np.uint8)
    whole = network.pooled(data, np.array([0, len(data)]))
    two = network.pooled(np.concatenate((data, data)), np.array([0, len(data), 2 * len(data)]))
    assert np.allclose(whole, two[0], atol=1e-5) and np.allclose(two[0], two[1], atol=1e-5) and abs(whole.sum() - 1) < 1e-5


# 9


@pytest.mark.parametrize("options", [{}, {"max_sketch_bytes": 5000, "section_counters": 1 << 14, "max_broadcast_intervals": 0}])
def test_repeats(odd, options):
    rows = [(r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["text"]) for r in odd.collect()]
    want = sorted(brute.without_repeats(rows, 50))
    got = substring_dedup.remove_repeats(odd, **options)
    mine = sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect())
    assert mine == want
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_repeats_on_short_windows_and_the_table(spark, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for window, options in ((50, {}), (4, {}), (4, {"max_sketch_bytes": 0, "section_counters": 1 << 15})):
        got = substring_dedup.remove_repeats(docs, window=window, keep_text=False, **options)
        assert pairs(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.without_repeats(rows, window), key=repr)
    assert substring_dedup.remove_repeats(empty).count() == 0


# 10


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (1, 2, 300, 49408, 2**32):
            ids = rng.integers(0, top, n).astype(np.uint32)
            ids[::17] = top - 1
            at, blocks = token_output.encode_blocks(ids)
            assert (token_output.decode_blocks(at, np.frombuffer(blocks, np.uint8), n) == ids).all()
    at, blocks = token_output.encode_blocks(ids)
    some = np.array([3, 7])
    assert (token_output.decode_blocks(at[some], np.frombuffer(blocks, np.uint8), 512) == np.concatenate((ids[768:1024], ids[1792:2048]))).all()


def test_words_encode_like_whole_texts():
    import public_tokenizers
    import pyarrow as pa

    whole, encoder, rng = tokenizer(), token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"), most=300), random.Random(2)
    signs = [*"aAbZéÉñßİıΣςσʰªº'’.,;:!-_<|>0१٣\u0301\u00a0\u2003\x1c\x85🙂日ﬁ한 \n"] + ["'s", "<|endoftext|>", "<|ENDOFTEXT|>", "..", ",."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for i in range(0, len(texts), 50):
        encoder.unchecked = 0
        ((_, _, data, bounds),) = words.texts(pa.array(texts[i : i + 50]))
        ids, n = encoder.encode(data, bounds)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in whole.encode_batch(texts[i : i + 50], add_special_tokens=False)]


def test_tokens(odd, empty):
    whole, start, want = tokenizer(), 0, []
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_output.tokens_of(odd, ids_each=1000).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes())
        start += r["n_tokens"]
        want.append((r["doc_id"], r["ids"]))
    assert sorted(map(repr, want)) == sorted(repr((i, [*whole.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    assert token_output.tokens_of(empty).count() == 0


def test_a_tokenizer_that_joins_words_over_spaces(odd):
    """Its ids are those of whole texts; ones that only look as if words could be taken apart are refused by the check on the first texts."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encoder = Tokenizer.from_file(path), token_output.Encoder(path)
    assert encoder.pattern is None
    got = token_output.tokens_of(odd, path, ids_each=1000).collect()
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for (t,) in odd.select("text").collect()]
    assert sorted(r["ids"] for r in got) == sorted(want)
    other = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    other.pattern = token_output.regex.compile(r"\S")
    ((_, _, data, bounds),) = words.texts(pa.array(["it's one 12, two"]))
    with pytest.raises(ValueError):
        other.encode(data, bounds)


def test_word_table():
    table, rng = token_output.Table(100), np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64) & ~np.uint64(0xF0))
    table.add(keys[:60], np.arange(60, dtype=np.int32))
    table.add(keys[60:], np.arange(60, len(keys), dtype=np.int32))
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys ^ np.uint64(1 << 63)) == -1).all()
