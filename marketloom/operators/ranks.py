"""Quantiles and distinct counts of groups that no task could hold.

`exact_quantiles` selects ranks by counting: a group's values are counted by range, the one
range that holds a wanted rank is counted by narrower ranges, until it holds one value.
`day_sketches` keeps per key and day what can be added up: values counted by bins of a
constant ratio (quantiles within a stated relative error) and a distinct-count sketch.
`roll_up` merges any days without reading their rows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.series import beside
from marketloom.session import settle

#: Ranges that one range is cut into a round; also the most rows that a range's own task reads.
CELLS = 65_536


def exact_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Each group's `wanted` quantiles: column -> (share, kind). `cont` lies between two values, `disc` is the
    first value whose rank reaches the share, `low` the lower of the two values around `cont`.

    Nulls and values that are not finite are left out; null keys are a group. Every round
    reads the values once and counts them with sums before the shuffle; on smooth data each
    divides the open rows by `CELLS`, and it always sets the lowest and highest apart.
    """
    v = F.col(value).cast("double")
    base = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    groups = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    groups = settle(groups, "groups")

    def ranks(share: float, kind: str) -> list[Column]:
        if kind == "disc":
            at = F.greatest(F.ceil(F.lit(float(share)) * F.col("_n")) - 1, F.lit(0))
            return [at, at]
        at = F.lit(float(share)) * (F.col("_n") - 1)
        return [F.floor(at), F.ceil(at) if kind == "cont" else F.floor(at)]

    if not keys:
        raise ValueError("groups need a key")
    rank = F.explode(F.array_distinct(F.array(*[r.cast("long") for q in wanted.values() for r in ranks(*q)])))
    open_ = groups.select(*keys, rank.alias("_rank"), F.lit(0).cast("long").alias("_skip"), "_lo", "_hi")
    done = None
    while True:
        open_ = settle(open_, "ranks")
        found = open_.where("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_value"))
        done = found if done is None else done.unionByName(found)
        open_ = open_.where("_lo < _hi")
        if open_.isEmpty():
            break
        spans = open_.select(*keys, "_lo", "_hi").distinct()
        renamed = spans.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same &= base[k].eqNullSafe(renamed[f"_r_{k}"])
        inside = base.join(renamed, same & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        half = lambda c: F.col(c) / 2  # noqa: E731  # the width of all doubles overflows, half of it does not
        cell = F.least(F.floor((half("_v") - half("_lo")) / (half("_hi") - half("_lo")) * CELLS), F.lit(CELLS - 1))
        counted = inside.groupBy(*keys, "_lo", "_hi", cell.alias("_cell")).agg(F.count("*").alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        upto = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_before", F.coalesce(F.sum("_m").over(upto), F.lit(0)))
        held = beside(open_, counted, [*keys, "_lo", "_hi"])
        here = F.col("_rank") - F.col("_skip")
        open_ = held.where((here >= F.col("_before")) & (here < F.col("_before") + F.col("_m"))).select(
            *keys, "_rank", (F.col("_skip") + F.col("_before")).alias("_skip"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"))
    values = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_values"))
    out = beside(groups, values, keys)

    def at(share: float, kind: str) -> Column:
        low, high = (F.element_at("_values", r.cast("long")) for r in ranks(share, kind))
        if kind != "cont":
            return low
        part = F.lit(float(share)) * (F.col("_n") - 1)
        return low + (part - F.floor(part)) * (high - low)

    return out.select(*keys, *[at(*q).alias(name) for name, q in wanted.items()])


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def day_sketches(df: DataFrame, keys: list[str], day: Column, value: str, member: str, error: float = 0.01, precision: int = 14) -> DataFrame:
    """`keys, day, bins (bin -> count), n, members`: one row per key and day, of values above 0.

    A bin holds the values of one ratio (1 + error) / (1 - error), so it has at most a few
    thousand entries whatever the rows. `members` is a HyperLogLog sketch of `member`, with a
    standard error of about 1.04 / sqrt(2 ** precision).
    """
    bin_ = F.ceil(F.log(F.col(value)) / math.log(_gamma(error))).cast("int")
    rows = df.where(F.col(value) > 0).withColumn("_day", day)
    counted = rows.groupBy(*keys, "_day", bin_.alias("_bin")).agg(F.count("*").alias("_m"), F.hll_sketch_agg(member, F.lit(precision)).alias("_s"))
    return counted.groupBy(*keys, F.col("_day").alias("day")).agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", "_m"))).alias("bins"), F.sum("_m").alias("n"), F.hll_union_agg("_s").alias("members"))


def roll_up(sketches: DataFrame, keys: list[str], shares: dict[str, float], error: float = 0.01) -> DataFrame:
    """`keys`, rows, distinct members and quantiles of all days of `sketches` together. A
    quantile is the ordered value of rank floor(share (n - 1)), within the relative `error`."""
    gamma = _gamma(error)
    bins = sketches.select(*keys, F.explode("bins").alias("bin", "m")).groupBy(*keys, "bin").agg(F.sum("m").alias("m"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.sum("m").over(upto))
    whole = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("members")).alias("members"))
    middle = 2 * F.pow(F.lit(gamma), F.col("bin")) / (gamma + 1)
    joined = beside(whole, bins, keys)
    return joined.groupBy(*keys, "n", "members").agg(*[
        F.min(F.when(F.col("upto") > F.floor(F.lit(share) * (F.col("n") - 1)), middle)).alias(name) for name, share in shares.items()])
