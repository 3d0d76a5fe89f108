"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; it works on all rows that
its predecessor kept. `run` writes every stage's result as Parquet into the session's
shared folder and reads it back as the next stage's documents, so a lost executor costs
one stage's tasks and no stage is computed twice.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from marketloom.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules  # noqa: E402
from marketloom.llm.entries import table, word_tokenizer  # noqa: E402
from marketloom.llm.text import ready  # noqa: E402
from marketloom.session import settle  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A row is judged by its own text and language."""
    ready(spark)
    row = docs.select(F.struct("*").alias("row"))
    named = row.withColumn("key", F.xxhash64(F.col("row.doc_id").cast("long"), "row.text", "row.lang"))
    judged = quality_rules.judge(named.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"), F.col("row.lang").alias("lang")))
    bad = judged.where("not kept").select(F.col("doc_id").alias("key")).distinct()
    return named.join(bad, "key", "left_anti").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats or nearly repeats."""
    ready(spark)
    out = line_dedup.drop_lines(docs)
    kept = F.when((F.col("n_removed") == 0) & F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("kept"))
    given = {"text": kept}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        given["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept").cast(kind))
    return out.select([given[c].alias(c) if c in given else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    ready(spark)
    return ngram_join.first_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ready(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    ready(spark)
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Edit distance between all lines, tokenizing and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
