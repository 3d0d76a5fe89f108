"""Searches and phrase counts against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import block_search as B
from marketloom.llm import lexical_search as L
from marketloom.llm import phrase_mining as P
from marketloom.llm import vector_search as V
from marketloom.llm.text import ready


@pytest.fixture
def small(spark, monkeypatch):
    """Many blocks, bunches and rounds on few rows."""
    ready(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(B, "FIRST", 2)
    monkeypatch.setattr(B, "GROWTH", 6)
    monkeypatch.setattr(B, "BUNCH", 3)
    monkeypatch.setattr(V, "BLOCK", 5)
    yield spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def phrases(rows, least, best):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i:i + n])] += 1
    often = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}

    def inside(c, h):
        return any(h[i:i + len(c)] == c for i in range(len(h) - len(c) + 1))

    out = []
    for lang in total:
        found = []
        for (of, c), a in often.items():
            if of != lang or any(o == lang and len(h) > len(c) and f >= a and inside(c, h) for (o, h), f in often.items()):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (counts[lang, c[:k]] * counts[lang, c[k:]]), k, counts[lang, c[:k]], counts[lang, c[k:]]) for k in range(1, len(c)))
            found.append((-score, -a, " ".join(c).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def phrase_rows():
    r = random.Random(5)
    words = ["a", "B", "é", "über", "c3", "d\x00d", "zz", "漢"]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", ". ", "\n", ","]) for _ in range(r.randrange(60)))) for _ in range(80)]
    return rows + [("en", None), ("en", ""), ("fr", " \t.,"), ("en", "a b " * 400), ("en", "a b " * 400), ("de", "x" * 20000 + " y"), (None, "a A a A a A")]


@pytest.mark.parametrize("bits,chunk", [(24, 1 << 21), (6, 100)])
def test_phrases(spark, monkeypatch, bits, chunk):
    """Two bits of a bitmap are always full: nothing is cut, results stay."""
    ready(spark)
    monkeypatch.setattr(P, "CHUNK", chunk)
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, lang, t, 1, "w") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase string").repartition(3)
    for best in (4, 2000):
        got = P.collocations(docs, least=9, best=best, bits=bits).collect()
        assert sorted(map(tuple, got)) == phrases(rows, 9, best)


def test_large_counts_keep_all_digits(spark):
    """1000 a n passes 64 bits: the decimals are as wide as 38 digits."""
    from pyspark.sql import functions as F

    one = spark.range(1).select(*(F.lit(10**13).cast("decimal(17,0)").alias(c) for c in "anlr"))
    row = one.select((F.col("a") * F.col("n") * F.lit(1000).cast("decimal(4,0)")).alias("above"), (F.col("l") * F.col("r") - 1).alias("below")).select(F.expr("above div below")).first()
    assert row[0] == 1000 * 10**26 // (10**26 - 1)


def ranked(docs, items, k):
    fold = {i: i + 32 for i in range(65, 91)}
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(term.findall((t or "").translate(fold)))) for i, t in docs]
    n, tokens = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n) // max(tokens, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in term.findall((text or "").translate(fold)) if bag[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if blank else i, -s) for rank, (s, blank, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def search_rows():
    r = random.Random(8)
    words = ["the"] * 30 + ["of"] * 20 + [f"W{i}" for i in range(40)] + ["é", "naïve_x", "3.5"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(40)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "..."), (5, docs[5][1]), (3, docs[5][1]), (None, docs[5][1]), (None, docs[9][1]), (203, "the W1 " * 3000)]
    items = [(i, " ".join(r.choice(words) for _ in range(12))) for i in range(12)] + [(50, None), (51, ""), (52, "unseen"), (53, "the THE the"), (1, "W1 w2"), (None, "W3")]
    return docs, items


def test_ranked_search(small):
    docs, items = search_rows()
    frame = small.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, query long, score string").repartition(4)
    bench = small.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    for k in (3, 200):
        got = L.rank(frame, bench, k).collect()
        assert sorted(map(tuple, got), key=repr) == ranked(docs, items, k)


def test_search_of_one_block_skips_and_stays_exact(spark):
    ready(spark)
    docs, items = search_rows()
    many = [(1000 * j + (i or 0), t) for j in range(20) for i, t in docs]
    got = L.rank(spark.createDataFrame(many, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), 20).collect()
    assert sorted(map(tuple, got), key=repr) == ranked(many, items, 20)


def nearest(rows, asks, k):
    whole = [(i, [math.floor(1024 * float(np.float32(v))) for v in x]) for i, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, (q, x) in enumerate(whole):
        if q is not None and asks(q):
            found = sorted((-sum(s * t for s, t in zip(x, y, strict=False)), i is None, i or 0) for b, (i, y) in enumerate(whole) if b != a)
            out += [(q, rank, None if blank else i, -s) for rank, (s, blank, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def test_nearest_vectors(small):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    rows += [(100, None), (101, [1.0, None, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, []), (110, []), (105, [0.5]), (None, rows[4][1]), (4, rows[4][1]), (10, rows[10][1]),
             (120, [0.0] * 6), (130, [-3.0] * 9), (140, [0.25] * 12)] + [(150 + i, [1.0] * 6) for i in range(30)]
    frame = small.createDataFrame([(i, x, 1, "q") for i, x in rows], "vec_id long, embedding array<float>, score int, query string").repartition(3)
    for k in (3, 500):
        got = V.search(frame, frame.vec_id % 10 == 0, k, level=300).collect()
        assert sorted(map(tuple, got), key=repr) == nearest(rows, lambda i: i % 10 == 0, k)


def test_huge_components_are_exact_or_the_end_of_the_range(small):
    rows = [(i, [float(2**30 + i), 1.0, -3.0]) for i in range(0, 12)] + [(20, [1e30, 1.0, 0.0])]
    frame = small.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = V.search(frame, frame.vec_id == 0, 12).orderBy("rank").collect()
    held = {i: min(sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(rows[0][1], x, strict=True)), (1 << 63) - 1) for i, x in rows[1:]}
    assert [(g.vec_id, g.score) for g in got] == sorted(held.items(), key=lambda p: (-p[1], p[0]))[:12]
    rows = [(i, [2.0**20 + i, 1.0]) for i in range(4)]  # products pass 53 bits and fit 64
    frame = small.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(g.vec_id, g.score) for g in V.search(frame, frame.vec_id == 0, 9).orderBy("rank").collect()] == [(i, (1 << 30) * ((1 << 30) + 1024 * i) + (1 << 20)) for i in (3, 2, 1)]


def test_pruning_leaves_a_superset():
    r = np.random.Generator(np.random.PCG64(1))
    import pyarrow as pa

    x = np.floor(1024 * r.normal(size=(3000, 16)))
    x[:, 0] *= 20
    place, size, dim, low, high = V.segments(x, 32)
    lists = [pa.array([v.tolist()]) for v in (place, size, dim, low, high)]
    row = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([list(range(3000))]), pa.array([[False] * 3000]), pa.array([16]), pa.array([x.tobytes()]), *lists], names=list("abcdefghij"))
    block = V.Block(row)
    for _ in range(10):
        q = np.floor(1024 * r.normal(size=16))
        may = V.members(block, q, -np.inf, 10)
        best = set(np.argsort(-(x @ q), kind="stable")[:10].tolist())
        assert best <= set(may.tolist()) and len(may) < 300


def test_nothing(spark):
    ready(spark)
    docs, items = spark.createDataFrame([], "doc_id long, lang string, text string"), spark.createDataFrame([], "item_id long, text string")
    assert P.collocations(docs).count() == 0 and L.rank(docs, items).count() == 0
    assert L.rank(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert L.rank(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.search(none, none.vec_id % 100 == 0).count() == 0
