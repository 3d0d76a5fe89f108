"""Comparing bar sets and tick loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scalar import bps
from marketloom.operators.topk import latest

FIELDS = ("open", "high", "low", "close", "volume")
#: Intervals from finest to coarsest (fixed values).
LADDER = ("1m", "5m", "15m", "30m", "1h", "1d")
_INF = float("inf")


def discrepancies(ours: DataFrame, theirs: DataFrame, tolerance: float = 0.01, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Fields that differ by more than the tolerance on shared stamps. A difference
    that is no finite number is kept apart (`finite` false), without basis points."""
    a = ours.select(*keys, *[F.col(c).cast("double").alias(f"_a_{c}") for c in FIELDS])
    b = theirs.select(*keys, *[F.col(c).cast("double").alias(f"_b_{c}") for c in FIELDS])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_a_{c}").alias("ours"), F.col(f"_b_{c}").alias("theirs")) for c in FIELDS])
    long = a.join(b, list(keys)).select(*keys, F.inline(pairs))
    diff = F.col("ours") - F.col("theirs")
    finite = F.coalesce(~F.isnan(diff) & (F.abs(diff) < _INF), F.lit(False))
    out = long.withColumns({"diff": diff, "finite": finite}).filter(~F.col("finite") | (F.abs("diff") > tolerance))
    return out.withColumn("bps", F.when(F.col("finite"), bps(F.col("diff"), F.col("theirs"))))


def coverage_gaps(ours: DataFrame, theirs: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Stamps only one side has."""
    a, b = ours.select(*keys), theirs.select(*keys)
    return (a.join(b, list(keys), "left_anti").withColumn("side", F.lit("ours_only"))
            .unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("theirs_only"))))


def summary(ours: DataFrame, theirs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per symbol: bars compared, discrepancies by field, largest close difference."""
    shared = ours.select("symbol", "date").join(theirs.select("symbol", "date"), ["symbol", "date"]).groupBy("symbol").agg(
        F.count("*").alias("compared"))
    diffs = discrepancies(ours, theirs, tolerance)
    size = F.when(F.col("finite") & (F.col("field") == "close"), F.abs("diff"))
    per = diffs.groupBy("symbol").agg(
        *[F.count_if(F.col("finite") & (F.col("field") == f)).alias(f) for f in FIELDS],
        F.count_if(~F.col("finite")).alias("non_finite"), F.max_by("diff", size).alias("largest_close"))
    return shared.join(per, "symbol", "left").fillna(0, [*FIELDS, "non_finite"])


def finest(available: DataFrame, wanted: str = "1m") -> DataFrame:
    """Finest interval at or above `wanted` that has rows, per symbol.

    `available(symbol, interval, rows)`; intervals without rows step down.
    """
    rank = F.array_position(F.array(*[F.lit(i) for i in LADDER]), F.col("interval"))
    usable = available.filter((F.col("rows") > 0) & (rank >= LADDER.index(wanted) + 1))
    return latest(usable, ("symbol",), (rank.asc(),)).select("symbol", "interval")


def daily_labels(bars: DataFrame) -> DataFrame:
    return bars.withColumn("date", F.date_trunc("day", "date"))


def key_diff(before: DataFrame, after: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Keys added and removed between two loads, per group."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    added = b.join(a, keys, "left_anti").groupBy(*group).agg(F.count("*").alias("added"))
    removed = a.join(b, keys, "left_anti").groupBy(*group).agg(F.count("*").alias("removed"))
    return added.join(removed, group, "full_outer").fillna(0, ["added", "removed"])


def dedupe(ticks: DataFrame, keys: tuple[str, ...] = ("sym", "time", "seq")) -> DataFrame:
    """One tick per key within a fetched span."""
    return ticks.dropDuplicates(list(keys))


def counts_by_day(expected: DataFrame, stored: DataFrame, group: tuple[str, ...] = ("symbol",), time: str = "date") -> DataFrame:
    """Row counts of both sides per group and day, and whether they agree."""
    # Both sides are counted in one aggregate, so no joined side is sorted or held besides.
    def n(df: DataFrame, expected: int, stored: int) -> DataFrame:
        return df.select(*group, F.to_date(time).alias("day"), F.lit(expected).alias("_e"), F.lit(stored).alias("_s"))

    both = n(expected, 1, 0).unionByName(n(stored, 0, 1)).groupBy(*group, "day").agg(F.sum("_e").alias("expected"), F.sum("_s").alias("stored"))
    return both.withColumn("ok", F.col("expected") == F.col("stored"))


def observed(df: DataFrame, name: str, **checks: Column) -> tuple[DataFrame, object]:
    """`df` that counts rule breaks while it is written, without another pass."""
    from pyspark.sql import Observation

    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in checks.items()]), obs
