"""Repeated words and bytes against brute force over every window."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from marketloom.llm import relative_lz, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("the of and a in bar baz qux ro mi la so fa ti do übel née".split()) + str(r.randrange(40)) for _ in range(n))


def fixture():
    a, b, c = _prose(1, 120), _prose(2, 150), _prose(3, 90)
    half = " ".join(b.split()[30:95])
    edits = b.split()
    edits[60] = "changed"
    out = [(5, a), (3, b), (9, a), (7, half + " " + c), (11, c + "\n\n" + half), (2, " ".join(edits)), (20, ""), (21, None),
           (22, "one two"), (23, "x " * 400), (24, "x " * 90), (25, "\x0b \t" + a.replace(" ", "\n ")), (30, half), (30, half), (31, "z" * 450),
           (None, b), (12, _prose(9, 13)), (13, _prose(9, 13)), (14, _prose(9, 14)), (15, "é" * 150 + "y"), (16, "é" * 150)]
    return out + [(100 + i, _prose(50 + i % 3, 60) + " " + half[i:]) for i in range(6)]


def brute_words(rows, width):
    first = defaultdict(lambda: 1 << 62)
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in cut:
        for p in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[p:p + width])] = min(i, first[tuple(w[p:p + width])])
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p:p + width])] < i:
                gone |= set(range(p, p + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(rows, width):
    count, out = defaultdict(int), []
    cut = [(i, (t or "").encode()) for i, t in rows]
    for _, t in cut:
        for p in range(len(t) - width + 1):
            count[t[p:p + width]] += 1
    for i, t in cut:
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if count[t[p:p + width]] > 1:
                gone[p:p + width] = [True] * width
        spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in rows], "doc_id long, text string, id string, kept string").repartition(3)


@pytest.mark.parametrize("width", [13, 5])
def test_words(spark, width):
    got = relative_lz.drop_repeats(frame(spark, fixture()), width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert order(got) == order(brute_words(fixture(), width))


@pytest.mark.parametrize("width", [200, 60])
def test_bytes(spark, width):
    got = suffix_dedup.drop_repeats(frame(spark, fixture()), width).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert order(got) == order(brute_bytes(fixture(), width))


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert order(relative_lz.drop_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == order(brute_words(rows, 13))
    assert order(suffix_dedup.drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == order(brute_bytes(rows, 200))


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert relative_lz.drop_repeats(empty).count() == 0
    assert suffix_dedup.drop_repeats(empty).count() == 0


def test_kept_text_and_spans(spark):
    rows = relative_lz.drop_repeats(frame(spark, fixture()), with_text=True).where("doc_id = 9").collect()
    assert [(r.kept, r.span_starts, r.span_ends) for r in rows] == [("", [0], [120])]


@pytest.mark.parametrize("batch", [10_000, 7])
def test_factors_are_copies(spark, batch):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = relative_lz.drop_repeats(frame(spark, fixture()), with_text=True).collect()
        assert order((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == order(brute_words(fixture(), 13))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    words = {i: WORD.findall(t or "") for i, t in fixture() if i is not None}
    seen = 0
    for r in rows:
        factors = list(zip(r.factor_starts, r.factor_words, r.factor_sources, r.factor_source_starts))
        assert (r.n_factors, r.longest_factor) == (len(factors), max(r.factor_words, default=0))
        for start, size, source, at in factors:
            assert source < r.doc_id and size >= 13
            assert words[r.doc_id][start:start + size] == words[source][at:at + size]
            assert any(a <= start and start + size <= b for a, b in zip(r.span_starts, r.span_ends))
            seen += 1
        for (s, n, d, at), (s2, _, d2, at2) in zip(factors, factors[1:]):
            assert s2 > s and not (d == d2 and s2 - s == at2 - at and s2 == s + n - 12)
    assert seen > 20
    assert [(0, 120, 5, 0)] == [f for r in rows if r.doc_id == 9 for f in zip(r.factor_starts, r.factor_words, r.factor_sources, r.factor_source_starts)]


def test_long_factor(spark):
    text = _prose(77, 70_000)
    rows = relative_lz.drop_repeats(frame(spark, [(1, text), (4, "before it " + text + " after")]), with_text=True).where("doc_id = 4").collect()
    assert [(r.n_removed, r.kept) for r in rows] == [(70_000, "before it after")]
    assert sum(rows[0].factor_words) - 12 * (rows[0].n_factors - 1) > 69_950 and rows[0].longest_factor > 65_536
