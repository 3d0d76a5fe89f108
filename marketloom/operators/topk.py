"""Newest rows, latest row per key, pages and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.session import settle

def newest(df: DataFrame, n: int, keys: tuple[str, ...] = ("sym",), order: tuple[Column, ...] | None = None) -> DataFrame:
    """The n newest rows per key, ranked from 1; none for n <= 0.

    The rank filter lets Spark keep n rows per key before the shuffle.
    """
    order = order or (F.col("time").desc(), F.col("seq").desc())
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(n, 0))


def latest(df: DataFrame, keys: tuple[str, ...], order: tuple[Column, ...]) -> DataFrame:
    """One row per key: the first in `order`."""
    return newest(df, 1, keys, order).drop("rank")


def latest_tick(ticks: DataFrame, keys: tuple[str, ...] = ("sym",)) -> DataFrame:
    return latest(ticks, keys, (F.col("time").desc(), F.col("seq").desc()))


def capped(df: DataFrame, max_rows: int, order: list[Column]) -> DataFrame:
    """At most `max_rows` rows in order, each told whether rows were left out."""
    n = _rows(max_rows)
    top = df.orderBy(*order).limit(n + 1)
    # n + 1 rows at most reach this unpartitioned window.
    w = Window.partitionBy(F.lit(1))
    ranked = top.withColumn("_rn", F.row_number().over(w.orderBy(*order)))
    flagged = ranked.withColumn("truncated", F.count("*").over(w) > n)
    return flagged.filter(F.col("_rn") <= n).drop("_rn")


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(max(offset, 0)).limit(_rows(size))


def _rows(n: int) -> int:
    if n < 1:
        raise ValueError(f"{n} rows asked for")
    return n


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """The place of every row in a total order, from 1. The sorted rows are written once;
    the few rows that count each sorted part say how many lie before it."""
    rows = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg((F.max("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_n"))
    w = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return rows.join(before, "_part").withColumn(name, within + F.col("_before") + 1).drop("_at", "_part", "_before")


def by_weight(df: DataFrame, weight: str, *ties: str) -> DataFrame:
    """Largest weight first, nulls as zero."""
    return df.orderBy(F.coalesce(F.col(weight), F.lit(0.0)).desc(), *ties)


def universe_order(df: DataFrame, cap: str = "cap", code: str = "code") -> DataFrame:
    """Every row with its place: known caps first, largest first, then by code."""
    return placed(df, [F.col(cap).isNull(), F.col(cap).desc(), F.col(code)])
