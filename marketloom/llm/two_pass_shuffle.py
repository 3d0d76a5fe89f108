"""Two-pass external shuffle into shards.

Pass one scatters the rows uniformly over buckets by a seeded hash. There are as many
buckets as the bytes of all rows ask for, so a bucket stays near `bucket_bytes` at any size
of the table; counts per bucket, summed in two levels, say how many rows lie before each.
Pass two sorts each bucket by content, so that a rerun meets the same order, and shuffles
it in memory by Fisher and Yates under a seed of its own. A row's place in the whole is its
place in the bucket plus the rows before; place modulo shards is its shard, the quotient
its slot.

Law `rows`: shard counts differ by one at most, slots have no gaps. A null or empty text
has size 1. Repeated rows are rows of their own; copies of one id and text share a bucket,
and only they, or one very long text, make a larger one. An empty table gives no rows.
Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "doc_id long, text string, size long, text_crc32 long, shard int, slot long"


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform order of n rows: each place, from the last, swaps with one at or before it."""
    order = np.arange(n)
    picks = (np.random.Generator(np.random.PCG64(seed)).random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def _deal(shards: int, seed: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, before = key[0].as_py(), table["before"][0].as_py()
        table = table.take(pa.compute.sort_indices(table, [("h", "ascending"), ("doc_id", "ascending"), ("text_crc32", "ascending")]))
        table = table.take(pa.array(fisher_yates(len(table), seed * 1_000_003 + bucket)))
        place = before + np.arange(len(table))
        return pa.table([table["doc_id"], table["text"], table["size"], table["text_crc32"], pa.array((place % shards).astype(np.int32)), pa.array(place // shards)],
                        names=["doc_id", "text", "size", "text_crc32", "shard", "slot"])

    return run


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 7, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, text, size, text_crc32, shard and slot of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        "doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        # the third part tells apart rows that repeat one id; equal rows stay together
        F.xxhash64(F.lit(seed), "doc_id", text).alias("h"))
    buckets = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // bucket_bytes))
    rows = rows.withColumn("bucket", F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(buckets), 31))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.shiftright("bucket", 12))
    earlier = (Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))  # one row per 4,096 buckets
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(*earlier)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("bucket").rowsBetween(*earlier)), F.lit(0))
    plan = counts.withColumn("inside", inside).join(blocks, "block").select("bucket", (F.col("ahead") + F.col("inside")).alias("before"))
    return rows.join(plan, "bucket").groupBy("bucket").applyInArrow(_deal(shards, seed), OUT)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order."""
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").option("compression", "zstd").parquet(path))
