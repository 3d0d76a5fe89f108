"""Groups against brute force over all pairs of sets."""

import random
import re

from marketloom.llm import ngram_join as N


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[root(i)] = min(groups.get(root(i), d), d)
    return sorted(((d, len(sets[i]), groups.get(root(i), d)) for i, (d, _) in enumerate(rows)), key=repr)


def fixture():
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"] + ["The", "été"]
    bases = [[r.choice(vocabulary) for _ in range(r.randrange(3, 160))] for _ in range(12)]
    common = [r.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(170):
        words = list(r.choice(bases))
        for _ in range(r.randrange(5)):
            at = r.randrange(len(words))
            words[at:at + r.randrange(3)] = [r.choice(vocabulary)] * r.randrange(3)
            words = words or ["x"]
        if i % 3 == 0:
            words += common
        rows.append((1000 - i, " ".join(w.upper() if i % 7 == 0 else w for w in words)))
    return rows + [(5, ""), (6, None), (7, " \n"), (8, "one two"), (9, "One  two"), (None, rows[3][1]), (None, None), (998, rows[2][1]), (998, rows[2][1])]


def test_groups(spark):
    for percent in (80, 60):
        rows = fixture()
        docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n int").repartition(4)
        got = N.join_groups(docs, 5, percent).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, 5, percent)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = N.join_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 5, 80)


def test_chain_of_labels(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in N.components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_nothing(spark):
    assert N.join_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
