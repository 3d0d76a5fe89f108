"""Exact top-k of many queries over an index kept as one row per block of items.

Blocks hold a bounded number of items, queries travel in rows of `BUNCH`; a task meets one
block with one bunch at a time. Blocks are read in rounds that grow sixteenfold, and every
round tells each query's k-th best score so far, below which later blocks neither search
nor answer: a query sends about 16 k rows a round, whatever the number of blocks.

Bunches reach the blocks by an equi-join on a salt, so each block is shuffled once and
each query once per salt; the salts follow the cluster's cores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import settle

BUNCH = 256
GROWTH = 16
FIRST = 4
FOUND = "query long, id long, score long"
_CELLS = 1 << 30


def rounds(blocks: int) -> list[tuple[int, int]]:
    """Ranges of block hashes that hold about 4, 64, 1024, ... blocks."""
    edges, n = [0], FIRST
    while n < blocks:
        edges.append(_CELLS * n // blocks)
        n *= GROWTH
    return list(zip(edges, [*edges[1:], _CELLS], strict=True))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: highest score, then smallest id, null last."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(index: DataFrame, queries: DataFrame, meet, k: int) -> DataFrame:
    """query, id, score and rank of each query's k best items.

    index: block (long) and what `meet` needs; queries: query (long, unique) and what `meet`
    needs. `meet` maps Arrow batches of (index columns, bunch: list of query structs with
    `least`, the score that an answer needs) to batches of FOUND rows.
    """
    spark = index.sparkSession
    asked = [c for c in queries.columns if c != "query"]
    blocks, many = index.count(), queries.count()
    have = spark.createDataFrame([], FOUND + ", rank int")
    if not blocks or not many:
        return have
    cell = F.pmod(F.xxhash64("block"), F.lit(_CELLS))
    salts = max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism))
    for n, (low, high) in enumerate(rounds(blocks)):
        least = have.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
        bunches = (queries.join(least, "query", "left").groupBy(F.pmod(F.xxhash64("query"), F.lit(-(-many // BUNCH))).alias("bunch_no"))
                   .agg(F.collect_list(F.struct("query", "least", *asked)).alias("bunch")))
        part = index.where((cell >= low) & (cell < high)).withColumn("salt", F.pmod(F.xxhash64("block", F.lit(1)), F.lit(salts)))
        pairs = part.join(bunches.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), "salt")
        found = pairs.drop("salt", "bunch_no").mapInArrow(meet, FOUND)
        if n:
            found = found.unionByName(have.drop("rank"))
        have = settle(best(found, k), "found")
    return have


def flat(column: pa.Array) -> pa.Array:
    """The values of a one-row list column."""
    return column.slice(0, 1).flatten()


def best_places(ids: pa.Array, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which of the places are the k best: by score, then id, null last."""
    own = ids.take(pa.array(places))
    blank = own.is_null().to_numpy(zero_copy_only=False)
    return np.lexsort((own.fill_null(0).to_numpy(), blank, -scores))[:k]


def answers(query: list, ids: list, scores: list) -> pa.RecordBatch:
    """FOUND rows of parts: a query each, its ids and their scores."""
    size = [len(x) for x in scores]
    none = pa.array([], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array(query, np.int64), size)), pa.concat_arrays([none, *ids]), pa.concat_arrays([none, *(pa.array(x, pa.int64()) for x in scores)])],
        names=["query", "id", "score"])
