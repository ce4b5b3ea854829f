"""The pipeline's stages, each against brute force on what the stage before kept."""

import corpus_pipeline as pipeline
from loomhouse import session
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [brute.re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        out = pipeline.written(stage(spark, docs, SF), name)
        if name == "token_output":
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.collect())
            break
        assert out.columns == columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(before[i] == t for i, t in after.items())
        gone = before.keys() - after.keys()
        if name == "language_id":
            assert all(any(c.isalpha() for c in before[i]) for i in after) and len(gone) <= 0.02 * len(before)
        elif name == "simhash_near_dedup":
            prints = {i: brute.fingerprint(t) for i, t in before.items()}
            root = brute.linked(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
            least = {}
            for i, p in prints.items():
                least[root[p]] = min(least.get(root[p], i), i)
            assert set(after) == set(least.values())
        elif name == "benchmark_decontamination":
            for i in sorted(before)[:60]:
                w = brute.re.findall(r"[^\W_]+", before[i].lower())
                near = any(set(item) & set(w) and len(set(item) & set(w)) > 0.6 * len(set(item)) and brute.best_run(item, w) <= 0.2 * len(item) for item in items)
                assert near == (i in gone), i
        elif name == "source_mixing":
            assert out.count() > docs.count()
        docs, before = out, after


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string, copies string, lang_pred string, hash string, row string, c0 string, fingerprint string, __copy string"


def test_odd_rows_pass_through(spark):
    """Null columns, empty and very long texts, ties, repeated rows, empty tables, and columns named as the operators' own, which come out as they went in."""
    long = " ".join(f"the{i} and of" for i in range(40_000))
    rows = [(1, None, None, None, None), (2, "the the of and", "en", "s", 3), (2, "the the of and", "en", "s", 3), (None, "another text of the kind", "en", None, 0), (3, "", "en", "s", 0), (4, " \t\n", None, None, 0), (5, long, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *[f"own {k}" for k in range(10)]) for r in rows], CLASHES)
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in pipeline.STAGES:
            now = pipeline.written(stage(spark, now, SF), name)
            if name != "token_output":
                assert now.columns == docs.columns
                assert all(r[c] == f"own {k}" for r in now.collect() for k, c in enumerate(docs.columns[5:]))
                if table is docs:
                    assert {5, None} <= {r["doc_id"] for r in now.collect()}
        assert set(now.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    assert now.count() == 0


def test_run_leaves_nothing_but_the_last_stage(spark):
    before = {*session._made}
    out = pipeline.run(spark, SF)
    assert out.count() > 200
    left = [x.rpartition("/")[2].split("-")[0] for x in session._made if x not in before]
    assert sorted(left) == ["source_mixing", "tokens"]


def test_one_row_of_a_group_stays(spark):
    rows = [(2, "the the of and", "en", "s", 3)] * 3 + [(None, "another text of the kind", "en", None, 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((tuple(r) for r in pipeline.simhash_near_dedup(spark, docs, SF).collect()), key=repr) == sorted({*rows}, key=repr)
