"""Ranked lexical search: term-at-a-time accumulators inside document-at-a-time skipping.

Terms are the maximal matches of `TERM`, A-Z counted as a-z. The index has one row per block
of documents: for every term of the queries the places that hold it and how often. Within a
block a query treats its short posting lists term at a time: their scores are summed into
one accumulator per touched place. From then on these accumulators are one more iterator,
bounded by its highest sum per stretch of places, beside the iterators of the long lists,
which are bounded by their highest score per stretch. Document at a time, stretches whose
bounds together cannot reach the k-th best score are skipped, and inside a stretch a place
is left as soon as what the remaining lists can add is too little. Scores are exact.

Scores are 64-bit integers but for the weight's logarithm: N documents hold a term, L is all
their terms, n a document's, df the documents with a term, tf its count in the document;
w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25nN div L, and a term of the query adds
w (10**9 tf div (1000 tf + 12m)) for each time that the query names it.

Null texts have no term, and an item without terms that are found has no rows. Only scores
above 0 are answers. Repeated rows, of documents or items, are rows of their own; equal
scores rank by ascending doc_id, a null doc_id last. Empty tables give no rows. Columns
beside ids and texts are not read, whatever their names. A text is held whole by one task,
however long. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import block_search as B
from marketloom.llm import text as T
from marketloom.session import settle

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OUTSIDE = np.array([b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
STRETCH = 64
INDEX = "block long, ids array<long>, lengths array<long>, terms array<long>, sizes array<int>, places array<int>, counts array<int>"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all terms in order, and n + 1 offsets of the texts."""
    starts, ends, first = T.runs(_OUTSIDE[data], offsets)
    return T.byte_roll(T.LOWER[data]).span(starts, ends), first


def _counted(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (name, doc) in that order, and how often."""
    order = np.lexsort((doc, names))
    names, doc = names[order], doc[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(names)), bool), (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])]))
    return names[new], doc[new], np.diff(np.append(new, len(names)))


@T.tidy
def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in T.chunks(batch):
            names, first = terms_of(data, offsets)
            name, doc, n = _counted(names, T.owners(np.diff(first)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(T.signed(name)), pa.array(n)], names=["query", "term", "times"])


def _blocks(wanted: np.ndarray):
    """One index row per Arrow batch of documents (a few megabytes, or one long text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            parts, lengths = [], []
            for a, _, data, offsets in T.chunks(batch):
                names, first = terms_of(data, offsets)
                lengths.append(np.diff(first))
                held = T.in_bitmap(names.view(np.int64), wanted)
                parts.append(_counted(names[held], a + T.owners(np.diff(first))[held]))
            if not parts:
                continue
            name, place, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, name.view(np.int64)))
            name, place, n = name.view(np.int64)[order], place[order], n[order]
            terms, sizes = np.unique(name, return_counts=True)
            one = pa.array([0, len(batch)], pa.int32())
            columns = [pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), pa.ListArray.from_arrays(one, batch.column(0))]
            for values, kind in ((np.concatenate(lengths), pa.int64()), (terms, pa.int64()), (sizes, pa.int32()), (place, pa.int32()), (n, pa.int32())):
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()))))
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "lengths", "terms", "sizes", "places", "counts"])

    return T.tidy(run)


class Block:
    """An index row, and what queries have asked of it so far."""

    def __init__(self, row: pa.RecordBatch, docs: int, tokens: int):
        self.ids = B.flat(row.column(1))
        n, self.terms, sizes, self.places, self.counts = (B.flat(row.column(i)).to_numpy() for i in range(2, 7))
        self.bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.n = len(self.ids)
        self.m = 75 + 25 * n * docs // max(tokens, 1)
        self.stretches = -(-self.n // STRETCH)
        self.dense: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores, before the weight, of the block's i-th term."""
        s = slice(self.bounds[i], self.bounds[i + 1])
        tf = self.counts[s].astype(np.int64)
        return self.places[s], 1_000_000_000 * tf // (1000 * tf + 12 * self.m[self.places[s]])

    def long_list(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores by place, padded to whole stretches, and the highest of each stretch."""
        if i not in self.dense:
            scores = np.zeros(self.stretches * STRETCH, np.int64)
            at, x = self.postings(i)
            scores[at] = x
            self.dense[i] = scores, scores.reshape(-1, STRETCH).max(axis=1)
        return self.dense[i]


def search(block: Block, terms: np.ndarray, weights: np.ndarray, least: int, k: int, short: float = 1 / 16) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the block's k best documents with a score of `least` or more;
    all that tie with the last. `terms` are distinct; a weight counts the term's repeats."""
    at = np.searchsorted(block.terms, terms)
    found = np.flatnonzero((at < len(block.terms)) & (weights > 0))
    found = found[block.terms[at[found]] == terms[found]]
    at, weights = at[found], weights[found]
    size = np.diff(block.bounds)[at]
    brief = size <= max(1, int(short * block.n))
    sums = np.zeros(block.stretches * STRETCH, np.int64)
    for i, w in zip(at[brief].tolist(), weights[brief].tolist(), strict=True):  # term at a time
        places, scores = block.postings(i)
        sums[places] += w * scores
    highest = sums.reshape(-1, STRETCH).max(axis=1)
    long = [(w, *block.long_list(i)) for i, w in zip(at[~brief].tolist(), weights[~brief].tolist(), strict=True)]
    long.sort(key=lambda x: -x[0] * int(x[2].max()))
    bound = highest + sum((w * most for w, _, most in long), np.zeros(block.stretches, np.int64))
    rest = [sum(w * most for w, _, most in long[i:]) for i in range(1, len(long))] + [np.zeros(block.stretches, np.int64)]

    def kth(scores: np.ndarray) -> int:
        return int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else 0

    least = max(least, 1, kth(sums))  # sums are scores already reached
    got_at, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ahead = np.flatnonzero(bound >= least)
    a = 0
    while a < len(ahead):  # document at a time, a few stretches together
        own = ahead[a:a + 8]
        a += 8
        own = own[bound[own] >= least]
        places = (own[:, None] * STRETCH + np.arange(STRETCH)).ravel()
        scores = sums[places]
        for i, (w, by_place, _) in enumerate(long):
            scores = scores + w * by_place[places]
            near = scores + rest[i][places // STRETCH] >= least
            places, scores = places[near], scores[near]
        near = scores >= least
        got_at, got = np.concatenate([got_at, places[near]]), np.concatenate([got, scores[near]])
        if len(got) > k:
            least = max(least, kth(got))
            near = got >= least
            got_at, got = got_at[near], got[near]
    return got_at, got


def _meet(docs: int, tokens: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1)
                block, bunch = Block(row, docs, tokens), B.flat(row.column(7))
                query, least = bunch.field("query").to_numpy(), bunch.field("least").fill_null(1).to_numpy()
                pairs = bunch.field("terms")
                bounds = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
                terms, weights = (pairs.flatten().field(x).to_numpy() for x in ("term", "weight"))
                ids, found = [], []
                for i in range(len(query)):
                    s = slice(bounds[i], bounds[i + 1])
                    places, scores = search(block, terms[s], weights[s], int(least[i]), k)
                    best = B.best_places(block.ids, places, scores, k)
                    ids.append(block.ids.take(pa.array(places[best])))
                    found.append(scores[best])
                yield B.answers(query, ids, found)

    return T.tidy(run)


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents."""
    # settled: a row's number stays the same for all that is read of it
    items = settle(items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id"), F.col("text").cast("binary").alias("text")), "items")
    named = settle(items.select("query", "text").mapInArrow(_item_terms, "query long, term long, times long"), "item-terms")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    index = settle(texts.mapInArrow(_blocks(T.bitmap(named.select("term").distinct(), "term")), INDEX), "index")
    of = F.explode("lengths").alias("n")
    whole = index.select(of).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    held = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(whole["docs"]) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighed = named.join(held, "term").groupBy("query").agg(F.collect_list(F.struct("term", (F.col("times") * weight).alias("weight"))).alias("terms"))
    found = B.top_k(index, weighed, _meet(whole["docs"], whole["tokens"], k), k)
    return found.join(items.select("query", "item_id"), "query").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def rank_sql(k: int = 20) -> str:
    """The same rows in DuckDB, every matching document scored."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"unnest(regexp_extract_all(translate(text, '{upper}', '{low}'), '{TERM}'))"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
    said AS (SELECT d, {words} AS term FROM docs),
    tf AS (SELECT d, term, count(*) AS tf FROM said GROUP BY ALL),
    sizes AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM sizes),
    items AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
    asked AS (SELECT q, {words} AS term FROM items),
    weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
    scored AS (
        SELECT q, d, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // tokens))))::BIGINT AS score
        FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (d), whole GROUP BY q, d)
    SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
    FROM scored JOIN items USING (q) JOIN docs USING (d) WHERE score > 0 QUALIFY rank <= {k}"""
