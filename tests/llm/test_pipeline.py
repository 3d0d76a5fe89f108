"""The pipeline's stages take effect, one on the other's result."""

import corpus_pipeline as P
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import ITEM
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    good = P.quality_stage(spark, docs, sf).cache()
    assert good.columns == COLUMNS and 0 < good.count() < before
    lines = P.line_stage(spark, good, sf).cache()
    want = brute_lines([(r.doc_id, r.text) for r in good.collect()], 2, 24)
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == sorted(w[:2] for w in want)
    assert lines.columns == COLUMNS and lines.where(F.col("n_chars") != F.length("text")).count() == 0
    single = P.near_duplicate_stage(spark, lines, sf).cache()
    groups = brute_groups([(r.doc_id, r.text) for r in lines.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, _, c in groups if d == c)
    clean = P.decontamination_stage(spark, single, sf).cache()
    assert clean.columns == COLUMNS and clean.count() < single.count()
    packed = P.packing_stage(spark, clean, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}


def test_odd_rows(spark, tmp_path):
    prose = "It was the best of times and it was the worst of times for all of the people in the town that is by the sea and on the hill"
    rows = [(1, prose + ", " + ITEM + " " + " ".join(f"with word{i} in it" for i in range(20)), "en", "s", 1, "a"), (2, None, None, None, None, None), (3, "", "xx", "s", 0, "b"),
            (None, None, "en", "s", 5, "c")]
    rows += [(i, " ".join(f"w{i}x{j} of the w{j}y{i} to in w{i}z{j} and a" for j in range(14)), "en", "s", 3, "d") for i in (10, 11, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = P.settle(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
    assert sorted(r.doc_id for r in docs.collect()) == [10, 11]


def test_empty(spark, sf):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        docs = P.settle(stage(spark, docs, sf), name)
    assert docs.count() == 0
