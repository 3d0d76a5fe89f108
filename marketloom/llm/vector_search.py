"""Exact inner-product top-k by an impact-ordered index, score at a time.

A vector's components become floor(1024 x). The index has one row per block of vectors: the
posting segments of every dimension, each holding the places whose component falls into one
quantised level, with the lowest and highest component in it. For a query a segment's impact
is the most that its component pair can add. Segments are processed by descending impact, a
share of the postings at a time; a place's accumulator sums the impacts of its segments. Two
bounds follow: an accumulator and the highest impacts still open, by dimension, bound a
place's score from above; the accumulator less the width of the processed levels bounds it
from below. The loop stops only on proof: when all but a few places cannot reach the k-th
best lower bound, or when no segment is left. What may still belong is rescored exactly.

Queries are the rows that the caller picks; candidates are all rows but the query's own.
Vectors that are null or hold a null or a component that is not finite take no part.
Dimensions that one of two vectors lacks count as 0. Repeated rows are rows of their own,
as queries and as candidates; equal scores rank by the smaller id, a null id last. Empty
tables give no rows; columns beside id and vector are not read, whatever their names.
Where products could leave 53 bits, a block's scores are computed in whole numbers without
limit and nothing is pruned; a score beyond 64 bits is reported as the nearest one within.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm import block_search as B
from marketloom.llm import text as T
from marketloom.session import settle

INDEX = "block long, ids array<long>, asked array<boolean>, width int, parts binary, places array<int>, sizes array<int>, dims array<int>, lows array<double>, highs array<double>"
EXACT = 1 << 52
BLOCK = 4096


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of floor(1024 x), shorter vectors filled up with 0."""
    many = vectors.value_lengths().to_numpy()
    width = int(many.max(initial=0))
    out = np.zeros((len(vectors), width))
    out[T.owners(many), T.within(many)] = np.floor(1024.0 * vectors.flatten().to_numpy())
    return out


def segments(x: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Places by (dimension, level of the component), and each segment's size, dimension, lowest and highest component."""
    n, width = x.shape
    values = x.T
    step = np.floor(values / level)
    place = np.argsort(step, axis=1, kind="stable")
    step, values = np.take_along_axis(step, place, 1), np.take_along_axis(values, place, 1)
    new = np.ones((width, n), bool)
    new[:, 1:] = step[:, 1:] != step[:, :-1]
    first = np.flatnonzero(new)
    flat = values.ravel()
    if not len(first):
        return place.ravel(), first, first, np.zeros(0), np.zeros(0)
    return place.ravel(), np.diff(np.append(first, n * width)), first // n, np.minimum.reduceat(flat, first), np.maximum.reduceat(flat, first)


def _blocks(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                ids, asked, vectors = (c.slice(a, BLOCK) for c in batch.columns)
                x = _matrix(vectors)
                place, size, dim, low, high = segments(x, level)
                columns = [pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), c) for c in (ids, asked)),
                           pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())]
                columns += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kind)) for v, kind in (
                    (place, pa.int32()), (size, pa.int32()), (dim, pa.int32()), (low, pa.float64()), (high, pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])
                number += 1

    return T.tidy(run)


@T.tidy
def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, id, components) of the rows that ask."""
    for batch in batches:
        for r in range(len(batch)):
            row = batch.slice(r, 1)
            asked = np.flatnonzero(B.flat(row.column(2)).to_numpy(zero_copy_only=False))
            width = row.column(3)[0].as_py()
            x = np.frombuffer(row.column(4)[0].as_buffer(), np.float64).reshape(-1, width)[asked] if width else np.zeros((len(asked), 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(asked), row.column(0)[0].as_py())), pa.array(asked), B.flat(row.column(1)).take(pa.array(asked)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1) * width, pa.int32()), pa.array(x.ravel()))], names=["own", "place", "id", "parts"])


class Block:
    """An index row."""

    def __init__(self, row: pa.RecordBatch):
        self.number, self.ids = row.column(0)[0].as_py(), B.flat(row.column(1))
        self.n, self.width = len(self.ids), row.column(3)[0].as_py()
        self.x = np.frombuffer(row.column(4)[0].as_buffer(), np.float64).reshape(self.n, self.width)
        self.place, self.size, self.dim, self.low, self.high = (B.flat(row.column(i)).to_numpy() for i in range(5, 10))
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.most = float(max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)))

    def scores(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Exact scores of some places; `query` is as wide as the block."""
        if self.most * float(np.abs(query).max(initial=0)) * max(1, self.width) < EXACT:
            return (self.x[places] @ query).astype(np.int64)
        whole = np.array([[int(v) for v in row] for row in self.x[places]], object).reshape(len(places), self.width)
        exact = whole.dot(np.array([int(v) for v in query], object)) if self.width else np.zeros(len(places), object)
        return np.array([min(max(int(s), -(1 << 63) + 1), (1 << 63) - 1) for s in exact], np.int64)


def members(block: Block, query: np.ndarray, least: float, k: int, steps: int = 4) -> np.ndarray:
    """Places that may be among the k best with a score of `least` or more: a proven superset."""
    if not block.width or block.most * float(np.abs(query).max(initial=0)) * block.width >= EXACT:
        return np.arange(block.n)
    weight = query[block.dim]
    one, two = weight * block.low, weight * block.high
    up, down = np.maximum(one, two), np.minimum(one, two)
    floor = np.full(block.width, np.inf)
    np.minimum.at(floor, block.dim, down)
    up, down = up - floor[block.dim], down - floor[block.dim]  # every impact is 0 or more
    base = floor.sum()
    order = np.argsort(-up, kind="stable")
    done = np.cumsum(block.size[order])
    sums, slack, a = np.zeros(block.n), np.zeros(block.width), 0
    may = np.ones(block.n, bool)
    for step in range(1, steps + 1):
        b = int(np.searchsorted(done, done[-1] * step / steps)) + 1 if step < steps else len(order)
        own = order[a:b]
        if not len(own):
            continue
        sums += np.bincount(block.place[T.spread(block.start[own], block.size[own])], np.repeat(up[own], block.size[own]), block.n)
        np.maximum.at(slack, block.dim[own], up[own] - down[own])
        a = b
        ahead = np.zeros(block.width)
        np.maximum.at(ahead, block.dim[order[b:]], up[order[b:]])
        needed = max(least - base, np.partition(sums, block.n - k)[-k] - slack.sum() if block.n >= k else -np.inf)
        may = sums + ahead.sum() >= needed
        if may.sum() <= 4 * k:
            break
    return np.flatnonzero(may)


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1)
                block, bunch = Block(row), B.flat(row.column(10))
                query, own, place = (bunch.field(c).to_numpy() for c in ("query", "own", "place"))
                least = bunch.field("least").fill_null(-(1 << 63)).to_numpy()
                parts = bunch.field("parts")
                bounds = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])
                values, ids, found = parts.flatten().to_numpy(), [], []
                for i in range(len(query)):
                    x = np.zeros(block.width)
                    given = values[bounds[i]:bounds[i + 1]][:block.width]
                    x[:len(given)] = given
                    here = own[i] == block.number
                    places = members(block, x, float(least[i]), k + here)  # the query's own row may take a place
                    if here:
                        places = places[places != place[i]]
                    scores = block.scores(x, places)
                    enough = scores >= least[i]
                    places, scores = places[enough], scores[enough]
                    best = B.best_places(block.ids, places, scores, k)
                    ids.append(block.ids.take(pa.array(places[best])))
                    found.append(scores[best])
                yield B.answers(query, ids, found)

    return T.tidy(run)


def search(vectors: DataFrame, asks: Column, k: int = 10, level: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row of (vec_id, embedding) for which `asks` holds."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(whole).select(F.col("vec_id").cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asked"), F.col("embedding").cast("array<double>").alias("x"))
    index = settle(rows.mapInArrow(_blocks(level), INDEX), "index")
    queries = settle(index.select("block", "ids", "asked", "width", "parts").mapInArrow(_queries, "own long, place long, id long, parts array<double>").select(
        F.monotonically_increasing_id().alias("query"), "*"), "queries")
    found = B.top_k(index, queries.drop("id"), _meet(k), k)
    return found.join(queries.select("query", F.col("id").alias("query_id")), "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def search_sql(asks: str = "vec_id % 100 = 0", k: int = 10) -> str:
    """The same rows in DuckDB, every pair scored."""
    return f"""
    WITH rows AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT r, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rows),
    queries AS (SELECT r, vec_id FROM rows WHERE {asks}),
    products AS (SELECT q.r AS q, c.r AS c, sum(q.x * c.x)::BIGINT AS score FROM parts q JOIN parts c ON q.i = c.i AND q.r <> c.r WHERE q.r IN (SELECT r FROM queries) GROUP BY ALL),
    scored AS (SELECT q.vec_id AS query_id, q.r AS q, c.vec_id, coalesce(p.score, 0) AS score FROM queries q JOIN rows c ON q.r <> c.r LEFT JOIN products p ON p.q = q.r AND p.c = c.r)
    SELECT query_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank, vec_id, score FROM scored QUALIFY rank <= {k}"""
