"""As-of reads, stitching, time-range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import intervals
from marketloom.operators import series
from marketloom.operators.series import Layout, Prefix


def backward(requests: DataFrame, facts: DataFrame, keys: tuple[str, ...] = ("sym",), time: str = "time",
             tie: str | None = "seq", layout: Layout | None = None) -> DataFrame:
    """Each request with the last fact at or before it, per key; null before the first.

    Both sides are merged once and the last fact is carried forward by a bucketed
    scan, so neither a long key nor many requests land in one task. Facts at the
    request's own time count.
    """
    layout = (layout or Layout(bucket_seconds=3600)).with_(keys=keys, order=(time, "_side", "_tie"))
    own = [c for c in requests.columns if c not in (*keys, time)]
    value = [c for c in facts.columns if c not in (*keys, time)]
    f = facts.select(*keys, time, F.lit(0).alias("_side"),
                     (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"),
                     F.struct(F.col(time).alias("fact_time"), *value).alias("_fact"))
    q = requests.select(*keys, time, F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"),
                        F.struct(*own, F.lit(1).alias("_q")).alias("_req"))
    merged = f.unionByName(q, allowMissingColumns=True)
    hit = series.scan(merged, layout, {"_hit": Prefix("last", F.col("_fact"))})
    return hit.filter("_side = 1").select(
        *keys, time, *[F.col(f"_req.{c}").alias(c) for c in own],
        *[F.col(f"_hit.{c}").alias(c) for c in ("fact_time", *value)])


def seam(first_tick: Column, interval: str) -> Column:
    """First bucket edge at or after the first tick."""
    width = intervals.width_seconds(interval) * 1_000_000
    return F.timestamp_micros((F.ceil(F.unix_micros(first_tick) / F.lit(width)) * width).cast("long"))


def stitch(history: DataFrame, ticks: DataFrame, interval: str) -> DataFrame:
    """History strictly before each symbol's seam, tick-built bars from it on."""
    from marketloom.operators import bars

    edge = (ticks.groupBy(F.col("sym").alias("symbol")).agg(F.min("time").alias("_first"))
            .select("symbol", seam(F.col("_first"), interval).alias("_seam")))
    live = (bars.from_ticks(ticks, interval).withColumnRenamed("sym", "symbol").join(edge, "symbol")
            .filter(F.col("date") >= F.col("_seam")).drop("_seam"))
    # A symbol keeps its whole history until a live bar takes over.
    taken = live.select("symbol").distinct().join(edge, "symbol")
    old = (history.join(taken, "symbol", "left")
           .filter(F.col("_seam").isNull() | (F.col("date") < F.col("_seam"))).drop("_seam"))
    return old.withColumn("source", F.lit("history")).unionByName(
        live.withColumn("source", F.lit("ticks")), allowMissingColumns=True)


def trailing_sum(bars: DataFrame, amounts: DataFrame, days: int, amount: str = "amount",
                 keys: tuple[str, ...] = ("symbol",), date: str = "date") -> DataFrame:
    """`bars` plus the sum of `amounts` with bar day - days < day <= bar day.

    Both sides are reduced to one row per key and day. Every amount goes to its own
    slice of `days` days and to the next, so a slice holds all a day in it can reach
    and never more than a few hundred rows; the day's sum is then joined to its bars.
    """
    paid = (amounts.groupBy(*keys, F.to_date(date).alias("_paid")).agg(F.sum(amount).alias("_amount"))
            .withColumn("_day", F.unix_date("_paid"))
            .withColumn("_slice", F.explode(F.array(*[
                (F.floor(F.col("_day") / F.lit(days)) + i).cast("long") for i in (0, 1)])))
            .drop("_paid"))
    dated = bars.withColumn("_day", F.unix_date(F.to_date(date)))
    asked = dated.select(*keys, "_day").distinct().withColumns(
        {"_slice": F.floor(F.col("_day") / F.lit(days)).cast("long"), "_bar": F.lit(True)})
    w = Window.partitionBy(*keys, "_slice").orderBy("_day").rangeBetween(-(days - 1), 0)
    sums = (asked.unionByName(paid, allowMissingColumns=True)
            .withColumn("trailing", F.coalesce(F.sum("_amount").over(w), F.lit(0.0)))
            .filter("_bar").select(*keys, "_day", "trailing"))
    return dated.join(sums, [*keys, "_day"], "left").drop("_day")


def tenure_weeks(tenures: DataFrame, weeks: DataFrame, key: str = "code", start: str = "start",
                 end: str = "end", guard_days: int = 14) -> DataFrame:
    """Members whose tenure overlaps each Monday-to-Friday week, with `in_tenure`:
    the whole week inside and the end at least `guard_days` past its Friday.

    Tenures are unrolled into the Mondays they touch and joined by equality. An
    open end reaches the last week asked for.
    """
    last = weeks.agg(F.max("monday")).scalar()
    # A week overlaps if its Friday is at or after the start.
    first = F.date_trunc("week", F.date_add(start, 2)).cast("date")
    rows = (tenures.withColumns({"_from": first, "_last": last})
            .withColumn("_until", F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last")))
            .filter(F.col("_from") <= F.col("_until"))
            .withColumn("monday", F.explode(F.sequence("_from", "_until", F.expr("INTERVAL 7 DAYS")))))
    inside = (F.col(start) <= F.col("monday")) & (
        F.col(end).isNull() | (F.date_sub(end, guard_days) >= F.date_add("monday", 4)))
    return (rows.join(weeks.select("monday").distinct(), "monday")
            .select(key, "monday", F.col(start), F.col(end), inside.alias("in_tenure")))


def vendor_series(bars: DataFrame, vendor: DataFrame, fields: dict[str, str], suffix: str = "",
                  key: str = "symbol") -> tuple[DataFrame, list[str]]:
    """Left-join a vendor's per-day fields onto bars by the date part.

    `fields` maps vendor field to output; fields the vendor table lacks become
    null columns and are returned as the second value.
    """
    absent = [out for f, out in fields.items() if f not in vendor.columns]
    picks = [F.col(f).try_cast("double").alias(o + suffix) for f, o in fields.items() if f in vendor.columns]
    side = vendor.select(key, F.to_date("date").alias("_day"), *picks)
    out = bars.withColumn("_day", F.to_date("date")).join(side, [key, "_day"], "left").drop("_day")
    return out.withColumns({o + suffix: F.lit(None).cast("double") for o in absent}), absent
