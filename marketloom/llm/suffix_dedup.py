"""Byte strings that occur more than once, by sampled suffixes and a distributed sort.

The difference-cover scheme: sort a sample of the suffixes such that any two positions
reach sampled ones by an equal shift, name them, and let every other suffix follow from
its own first bytes and the name of the sampled one it reaches. Here the cover is chosen
by content (`repeats`): equal strings of `width` bytes hold a sample at the same place,
and names are 64-bit fingerprints of the prefixes in place of ranks, which makes the
recursion on names local to each text. The sampled suffixes, with name and surrounding
prefix, are sorted across the cluster and adjacent prefixes compared; the remaining
suffixes beside a change are merged through the same order and compared in a second,
far smaller sort. Only suffixes whose first `width` bytes matter are told apart.

Texts are UTF-8 bytes; null is empty; strings never cross texts. Every row is a text of
its own, so repeated rows repeat each other. Ties need no order: equal strings are all
removed. Each input row gives one row; extra columns are dropped. An empty table gives no
rows. A text of any length is held whole by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.repeats import Kind, remove_repeats


def drop_repeats(docs: DataFrame, width: int = 200, k: int = 100, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; `with_text` adds the
    removed spans (byte offsets) and the kept bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(F.xxhash64("doc_id", "text").alias("id"), "doc_id", "text")
    out = remove_repeats(rows, Kind(width, min(k, width), 12, False, False), with_text)
    return out.withColumnRenamed("n_units", "n_bytes")
