"""Lines against brute force; the banded edit distance against the whole matrix."""

import random
import zlib

import pytest

from marketloom.llm import line_dedup as L


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_banded_distance(edits):
    r = random.Random(edits)
    pairs = [(b"", b""), (b"a", b""), (b"", b"abc"), (b"ab" * 400, b"ba" * 400)]
    for _ in range(1500):
        a = bytes(r.choice(b"abc") for _ in range(r.randrange(14)))
        b = bytearray(a)
        for _ in range(r.randrange(7)):
            at = r.randrange(len(b) + 1)
            b[at:at + r.randrange(2)] = bytes(r.choice(b"abc") for _ in range(r.randrange(2)))
        pairs.append((a, bytes(b)))
    assert L.edit_within(pairs, edits).tolist() == [edit(a, b) <= edits for a, b in pairs]


def brute(rows, edits, least):
    first = {}
    for i, t in rows:
        for n, line in enumerate((t or "").encode().split(b"\n")):
            if line.strip(b" \t\n\x0b\x0c\r"):
                at = (L.LAST if i is None else i, n)
                first[line] = min(first.get(line, at), at)
    near = {x for x in first if len(x) >= least and any(len(y) >= least and first[y] < first[x] and abs(len(x) - len(y)) <= edits
                                                      and edit(x, y) <= edits for y in first)}
    out = []
    for i, t in rows:
        kept, held = [], 0
        for n, line in enumerate((t or "").encode().split(b"\n")):
            held += line in first
            if line not in first or (first[line] == (L.LAST if i is None else i, n) and line not in near):
                kept.append(line)
        out.append((i, b"\n".join(kept).decode(), held))
    return sorted(out, key=repr)


def fixture():
    r = random.Random(3)
    base = ["".join(r.choice("abcde ") for _ in range(r.randrange(20, 44))) for _ in range(30)]

    def near(line):
        out = list(line)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(out) + 1)
            out[at:at + r.randrange(2)] = [r.choice("abcdeé")] * r.randrange(2)
        return "".join(out)

    rows = [(i, "\n".join([near(r.choice(base)) for _ in range(r.randrange(8))] + ["Menu", ""] * (i % 2))) for i in range(60)]
    return rows + [(90, None), (91, ""), (92, "\n\n \n"), (93, rows[5][1]), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, None), (94, "x" * 3000 + "\n" + "x" * 2999 + "y")]


@pytest.mark.parametrize("edits", [1, 2])
def test_lines(spark, edits):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, line int").repartition(3)
    got = L.drop_lines(docs, edits, 20).select("row.doc_id", "kept", "n_lines").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, edits, 20)


@pytest.mark.parametrize("caps", [(1, 2, None), (None,)])
def test_rounds_lose_nothing(spark, caps):
    rows = fixture()
    docs = spark.createDataFrame([(L.LAST if i is None else i, (t or "").encode()) for i, t in rows], "id long, text binary").repartition(3)
    near = {r.line for r in L.near_lines(docs, 2, 20, caps).collect()}
    assert near == {r.line for r in L.near_lines(docs, 2, 20).collect()} and near


def test_a_large_group_of_near_copies_gives_few_pairs(spark):
    """2,000 lines that are all within two edits of each other: one stays, pairs stay linear."""
    base = "the quick brown fox jumps over the lazy dog and then some more words follow it " * 2
    r = random.Random(1)
    lines = set()
    while len(lines) < 2000:
        at = r.randrange(len(base))
        lines.add(base[:at] + r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") + base[at + 1:])
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(lines, key=lambda x: zlib.crc32(x.encode())))], "doc_id long, text string").repartition(4)
    out = L.drop_lines(docs).select("row.doc_id", "n_removed").collect()
    assert {x.doc_id for x in out if not x.n_removed} == {0}
    keys = docs.selectExpr("doc_id AS id", "cast(text AS binary) AS text").mapInArrow(L._keys(2, 24), "key long, line long, census long, id long, number int").selectExpr("*", "true AS open")
    met = keys.repartition(8, keys.key - keys.key % 2).sortWithinPartitions("key", "line", "id", "number").mapInArrow(L._meet(2, 4), L.MET)
    assert met.where("key is null").select("a", "b").distinct().count() <= 2000 * 4 * 5


def test_nothing(spark):
    assert L.drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
