"""Base counts against a plain count, distances against numpy."""

import re
from collections import Counter

import numpy as np

from marketloom.llm import quality_rules as Q

TEXTS = ["", None, "one", "a b c a b c a b c", "x\n\nx\n \nx y\nx y", "the of # & <b> $5\tend", "q " * 300, "é ü  ñ ß z " * 5,
         " lead\x0btrail\r\n", "a b c d a b c e a b c d " * 9, "\n".join(["same line here"] * 4 + ["other"]), "w" * 5000]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    rows = [(i, t, "en" if i % 2 else None, 1) for i, t in enumerate(TEXTS)]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, w int")).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == {i: plain(t) for i, t, _, _ in rows}
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:6] for r in Q.judge(docs).collect()}
    assert got == {r.doc_id: plain(r.text) for r in docs.collect()}


def test_labelled_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    judged = Q.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rates = {r.quality: r.rate for r in judged.where("not base_failed").groupBy("quality").agg({"*": "count"}).withColumnRenamed(
        "count(1)", "rate").collect()}
    kept = {r.quality: r["count"] / rates[r.quality] for r in judged.where("kept").groupBy("quality").count().collect()}
    assert kept[1] > 0.99 and kept.get(0, 0) < 0.25


def test_distance(spark):
    p, q = [3.0, 0.0, 5.0], [1.0, 1.0, 2.0]
    a, b = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (a + b) / 2
    want = np.sqrt(sum(x * np.log2(x / y) for x, y in (*zip(a, m), *zip(b, m)) if x) / 2)
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(Q.distance(F.col("p"), F.col("q"))).first()[0]
    assert abs(got - want) < 1e-12
    none = spark.createDataFrame([(p, [0.0] * 3), ([0.0] * 3, q), ([0.0] * 3, [0.0] * 3)], "p array<double>, q array<double>")
    assert [r[0] for r in none.select(Q.distance(F.col("p"), F.col("q"))).collect()] == [None] * 3


def test_every_language_has_its_own_reference(spark):
    def text(letters, n):
        return " ".join(letters[i // 12] + letters[i % 12] + letters[i % len(letters):] + letters[:i * 7 % len(letters)] + letters[i % 5] * (i % 9) for i in range(n))

    rows = [(i, text("абвгдежзийклмнопрстуф"[i % 5:], 150), "ru") for i in range(20)]
    rows += [(100 + i, text("abcdefghijklmnopqrstuv"[i % 5:], 150), lang) for i, lang in enumerate(("pt", "pt", "nl", None, "", None))]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == 26 and all(r.kept and r.class_distance < 0.1 for r in got.values())


def test_one_long_junk_row_does_not_make_the_language(spark):
    clean = [(i, " ".join(f"{w} w{chr(97 + i)}x{'abcdefghij'[j % 10]}" for j, w in enumerate(Q.FUNCTION_WORDS["en"] * 5)), "en") for i in range(8)]
    junk = [(99, " ".join(f"#{i * 7919 % 99991}$%&" for i in range(40_000)), "en")]
    got = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert got == {**dict.fromkeys(range(8), True), 99: False}


def test_spellings_of_a_listed_language_keep_the_word_test(spark):
    rows = [(i, " ".join(f"{w} w{i}x{j}" for j, w in enumerate(Q.FUNCTION_WORDS["en"] * 4)), lang) for i, lang in enumerate(["en"] * 9 + ["EN", "en-US", "en_GB", "eng"])]
    got = {r.doc_id: r.word_distance for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all((got[i] is None) == (i == 12) for i in range(13))


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
