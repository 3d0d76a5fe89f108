"""Tables that others wrote, under names that SQL can use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def register(spark: SparkSession, tables: dict[str, str], kind: str = "parquet") -> DataFrame:
    """A temporary view per name over the table at its path, read where it lies.

    Returns the catalogue: `name, path, kind, columns` (each `name type`). Names are words
    of letters, digits and underscores; a name that is taken is replaced.
    """
    rows = []
    for name, path in tables.items():
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError(f"{name!r} is no table name")
        frame = spark.read.format(kind).load(path)
        frame.createOrReplaceTempView(name)
        rows.append((name, path, kind, [f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields]))
    return spark.createDataFrame(rows, "name string, path string, kind string, columns array<string>")


def spans(spark: SparkSession, names: list[str]) -> DataFrame:
    """`name, rows, first, last` of registered tables, by their first time column."""
    out = None
    for name in names:
        frame = spark.table(name)
        at = next((f.name for f in frame.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))), None)
        when = F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")
        one = frame.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.min(when).alias("first"), F.max(when).alias("last"))
        out = one if out is None else out.unionByName(one)
    return out
