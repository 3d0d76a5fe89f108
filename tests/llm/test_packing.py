"""Pieces against the tokenizer itself, places against an exact round trip."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from marketloom.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "a<|endoftext|>B <|ENDOFTEXT|> x", "don't stop... it's 3.5km, “q”, Ünï İx, é́ 漢字 a.b. C.D.! foo,,bar... ﬁ K", "\n\t a,\n", "!!! ,, .",
       "Σας ΟΔΟΣ, naïve. x", "word, " * 700, "é" * 900]


def check(spark, rows, length):
    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    got = K.pack(docs, PATH, length=length).collect()
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), length)):
            part = ids[start:start + length]
            want.append((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= length
    return len(bins), sum(w[3] for w in want)


def test_odd_texts(spark):
    check(spark, list(enumerate(ODD)) + [(3, ODD[3]), (3, ODD[3]), (None, "null id")], 64)


def test_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bins, tokens = check(spark, rows, 4096)
    assert bins <= -(-tokens // 4096) * 1.1


def test_sum_of_squares_by_hand():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 11, 400)
    bins, offsets = K.sum_of_squares(sizes, 10)
    open_bins, gaps = {}, defaultdict(int)
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def cost(gap):
            after = dict(gaps)
            if gap != 10:
                after[gap] -= 1
            if gap - s:
                after[gap - s] = after.get(gap - s, 0) + 1
            return sum(n * n for n in after.values())

        choices = {g: cost(g) for g in range(s, 11) if g == 10 or gaps[g]}
        gap = open_bins.get(b, 10)
        assert o == 10 - gap and choices[gap] == min(choices.values())
        if gap != 10:
            gaps[gap] -= 1
        open_bins[b] = gap - s
        if gap - s:
            gaps[gap - s] += 1


def test_nothing(spark):
    assert K.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
