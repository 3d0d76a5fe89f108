"""Phrase collocations from a weighted de Bruijn graph of words.

Texts, A-Z counted as a-z, are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into
words `[^\\x20\\x09]+`. The graph's edges are the longest grams: at every word one gram of
`longest` words starts, or a shorter one where its piece ends. An edge joins two nodes that
overlap in all words but one, its weight counts its occurrences. Counts of shorter phrases
are not gathered from the texts: f(phrase) is the flow out of its node, the weights of the
edges that begin with it, plus the corrections for pieces that end with it, which are the
shorter grams. A node whose whole flow passes into one neighbour is a unary stretch; it is
compacted into the longer phrase and reported there alone.

Before the graph is built, pieces are cut further between two words that are proven to meet
fewer than `least` times: single words and pairs are counted by Spark under 64-bit names,
with sums per chunk before the shuffle, and a bitmap of fixed size tells the frequent ones.
No phrase of `least` occurrences spans such a cut, and every word stays a node, so the
counts of all phrases that matter are unchanged; where the bitmap saturates, fewer cuts are
made and more edges travel. Equality of grams within one chunk is that of 64-bit hashes,
beyond it that of their spelling.

A null text is empty, a null lang is `und`, repeated rows count as often as they occur, an
empty table gives no rows, and columns beside lang and text are not read, whatever their
names. A text is held whole by one task, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm import text as T
from marketloom.session import settle

_U = np.uint64
STOPS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
BLANKS = np.isin(np.arange(256), (9, 32))
BITS = 24
CHUNK = T.CHUNK


class Words:
    """The words of a chunk: bounds, text, names of grams, and which follow each other in a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salt: np.ndarray):
        self.folded = T.LOWER[data]
        stop = STOPS[data]
        self.starts, self.ends, first = T.runs(stop | BLANKS[data], offsets)
        self.doc = T.owners(np.diff(first))
        piece = np.cumsum(stop)[self.starts]
        self.joined = (self.doc[1:] == self.doc[:-1]) & (piece[1:] == piece[:-1])
        self.roll = T.Roll(T.byte_roll(self.folded).span(self.starts, self.ends))
        self.salt = salt.view(_U)[self.doc]

    def names(self, at: np.ndarray, size) -> np.ndarray:
        """64-bit names of the grams of `size` words at word `at`, by language."""
        return T.mix(self.roll.span(at, at + size) ^ self.salt[at])


def _parts(batch: pa.RecordBatch):
    salt = batch.column(1).to_numpy()
    for a, b, data, offsets in T.chunks(batch, most=CHUNK):
        yield a, b, Words(data, offsets, salt[a:b])


@T.tidy
def _singles_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of names of words and pairs per chunk (lang null), and words by lang (name null)."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        langs, which = coded.dictionary, coded.indices.to_numpy()
        for a, b, w in _parts(batch):
            every, pairs = np.arange(len(w.starts)), np.flatnonzero(w.joined)
            name, n = np.unique(np.concatenate([w.names(every, 1), w.names(pairs, 2)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(name), pa.string()), pa.array(T.signed(name)), pa.array(n)], names=["lang", "name", "n"])
            total = np.bincount(which[a:b][w.doc], minlength=len(langs))
            yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), pa.nulls(len(langs), pa.int64()), pa.array(total)], names=["lang", "name", "n"])


def _spelled(w: Words, at: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The grams, words parted by one space."""
    raw, last = w.folded.tobytes(), at + size - 1
    begin, end = w.starts[at], w.ends[last]
    lengths = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    wide = end - begin != lengths[last + 1] - lengths[at] + size - 1
    out = [raw[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
    tabs = np.concatenate([[0], np.cumsum(w.folded == 9)])
    for i in np.flatnonzero(wide | (tabs[end] > tabs[begin])).tolist():
        own = slice(at[i], last[i] + 1)
        out[i] = b" ".join(raw[s:e] for s, e in zip(w.starts[own].tolist(), w.ends[own].tolist(), strict=True))
    return out


def _edges(often: np.ndarray, longest: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, w in _parts(batch):
                n = len(w.starts)
                linked = np.zeros(n, bool)
                pairs = np.flatnonzero(w.joined)
                linked[pairs] = T.in_bitmap(w.names(pairs, 2), often, bits)
                size, alive = np.ones(n, np.int64), np.ones(n, bool)
                for step in range(longest - 1):
                    alive = alive & np.append(linked[step:], np.zeros(min(step, n), bool))
                    size += alive
                at = np.arange(n)
                held = (size > 1) | T.in_bitmap(w.names(at, 1), often, bits)
                at, size = at[held], size[held]
                _, one, n_ = np.unique(w.names(at, size), return_index=True, return_counts=True)
                at, size = at[one], size[one]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + w.doc[at])), pa.array(_spelled(w, at, size), pa.binary()).cast(pa.string()), pa.array(n_)],
                    names=["lang", "phrase", "n"])

    return T.tidy(run)


def _words(phrase: str) -> Column:
    return F.split(phrase, " ")


def _joined(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def graph(docs: DataFrame, least: int = 100, longest: int = 5, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The flow f of every phrase of up to `longest` words that occurs `least` times (lang,
    phrase, size, f), and the number of words per lang (lang, n)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), F.col("text").cast("binary").alias("text"))
    counted = docs.mapInArrow(_singles_and_pairs, "lang string, name long, n long").groupBy("lang", "name").agg(F.sum("n").alias("n"))
    counted = settle(counted.where((F.col("n") >= least) | F.col("name").isNull()), "frequent")
    often = T.bitmap(counted.where("name is not null"), "name", bits)
    edges = docs.mapInArrow(_edges(often, longest, bits), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = _words("phrase")
    out = (edges.select("lang", "n", words.alias("words"), F.explode(F.sequence(F.lit(1), F.size(words))).alias("size"))
           .groupBy("lang", _joined(F.col("words"), 1, F.col("size")).alias("phrase"), "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    return settle(out, "flow"), counted.where("name is null").select("lang", "n")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's `best` phrases of 2 to `longest` words."""
    flow, total = graph(docs, least, longest, bits)
    words, size = _words("phrase"), F.col("size")
    candidates = flow.where("size > 1")
    # a node whose flow equals that of a phrase one word longer is compacted into it
    longer = flow.where("size > 2").select("lang", F.explode(F.array(_joined(words, 1, size - 1), _joined(words, 2, size - 1))).alias("phrase"), "f").distinct()
    kept = candidates.join(longer, ["lang", "phrase", "f"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), words.alias("w"), "size").select(
        "lang", "phrase", "a", "k", _joined(F.col("w"), 1, F.col("k")).alias("head"), _joined(F.col("w"), F.col("k") + 1, size - F.col("k")).alias("tail"))
    part = flow.select("lang", "phrase", "f")
    cuts = (cuts.join(part.withColumnsRenamed({"phrase": "head", "f": "l"}), ["lang", "head"])
            .join(part.withColumnsRenamed({"phrase": "tail", "f": "r"}), ["lang", "tail"]).join(total, "lang"))
    wide = {c: F.col(c).cast("decimal(17,0)") for c in ("a", "l", "r", "n")}  # products of up to 38 digits
    cuts = cuts.select("*", (wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).alias("above"), (wide["l"] * wide["r"]).alias("below"))
    scored = cuts.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    # at most `best` of each salt reach a language's own task
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    scored = scored.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= best)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def collocations_sql(least: int = 100, longest: int = 5, best: int = 2000) -> str:
    """The same rows in DuckDB, every phrase counted by itself."""
    return f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOW}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    sizes AS (SELECT unnest(range(1, {longest + 1})) AS size),
    grams AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size),
    flow AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
    candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM flow WHERE size > 1),
    kept AS (SELECT * FROM candidates c WHERE NOT EXISTS (
        SELECT 1 FROM candidates h WHERE h.lang = c.lang AND h.size > c.size AND 100 * h.f >= 100 * c.f
        AND contains(' ' || h.phrase || ' ', ' ' || c.phrase || ' '))),
    cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
    scored AS (
        SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, t.n,
               ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score, k
        FROM cuts c JOIN flow l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
        JOIN flow r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ') JOIN total t ON t.lang = c.lang),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM lowest QUALIFY rank <= {best}"""
