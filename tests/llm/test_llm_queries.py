"""Queries with SQL against DuckDB, held-out accuracy, and the pipeline against brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changelens.llm import minhash_dedup
from changelens.llm.registry import ORACLES, QUERIES
from tests.llm.test_llm_operators import grams, linked
from tests.test_queries import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_oracle_rows(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    c.execute(ORACLES[name])
    assert mine == rows([d[0] for d in c.description], c.fetchall())


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lang = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang_pred = lang").count() >= 0.99 * lang.count()
    good = QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert good.where("predicted = quality").count() >= 0.98 * good.count()


def test_url_query_judges_every_page(spark):
    got = QUERIES["op3_url_filter"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert got.where("verdict NOT IN ('allow', 'block') OR verdict IS NULL").count() == 0


def test_lm_held_out_text_is_more_likely_than_by_words_alone(spark):
    got = QUERIES["op6_lm_score"](spark, "/root/testdata/sf0.01").where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
            assert out.join(docs, out.columns, "left_anti").count() == 0
            docs = spark.createDataFrame(out.collect(), out.schema)
    before, after = seen["near_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    want = {d for d, (_, c) in linked(texts, 5).items() if c == d}
    assert {r["doc_id"] for r in after.collect()} == want
    before, after = seen["decontaminate"]
    items = [grams(r["text"], 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in before.collect() if any(100 * len(q & grams(r["text"], 5)) >= 80 * len(q) for q in items if q)}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - leaks
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.collect()}
    lang_in, lang_out = seen["language"]
    assert lang_out.count() >= 0.99 * lang_in.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = seen["quality"][0].join(labels.where("quality = 1"), "doc_id").count()
    assert seen["quality"][1].join(labels.where("quality = 1"), "doc_id").count() >= 0.99 * good
    assert seen["quality"][1].join(labels.where("quality = 0"), "doc_id").count() <= 2


def test_pipeline_decides_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 0").first()["text"]
    base, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(None, base), (3, base + " end"), (2, base), (2, base), (2, other), (None, other), (None, item), (9, item), (9, "quite another text of this number"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs.where("text LIKE 'a0 %' OR text LIKE 'b0 %'"), SF).collect()]
    assert sorted(kept) == [(2, base), (2, other)]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate_benchmark(spark, docs, SF).collect()]
    assert kept.count((9, item)) == kept.count((None, item)) == 0 and len(kept) == len(rows) - 2


def test_verify_takes_each_text_of_a_repeated_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string").coalesce(1)
    likely = spark.createDataFrame([(1, 2), (1, 3)], "x long, y long").coalesce(1)
    assert sorted(tuple(r) for r in minhash_dedup._verify(likely, docs, 5, 80).collect()) == [(1, 2), (1, 3)]


def test_stages_take_empty_tables_and_odd_rows(spark, tmp_path):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, None, "en", "s", None), (None, "x", None, "s", 1), (2, " \n", "xx", None, 2), (3, "wort " * 30_000, "de", "s", 150_000)]
    docs = plain.unionByName(spark.createDataFrame(odd * 2, plain.schema)).withColumn("score", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("ids", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.where("false"), SF).count() == 0
        out = stage(spark, docs, SF)
        if name == "packing":
            ids = out.where("start = 0").count()
            assert ids == docs.count()
            continue
        assert out.columns == plain.columns
        texts = out.select("text").collect()
        if name == "language":
            assert all(r["text"] and r["text"].strip() for r in texts)
        if name == "near_dedup":
            assert sum(not (r["text"] or "").split() for r in texts) >= 8 and sum(r["text"] == "x" for r in texts) == 1
        if name == "decontaminate":
            assert sum(not (r["text"] or "").split() for r in texts) >= 8
