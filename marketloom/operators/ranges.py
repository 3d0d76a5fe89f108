"""Coverage ranges: coalesce, subtract, trim, plan what to fetch.

Ranges are `(keys..., s, e)` with both ends inclusive; `step` is one bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import intervals
from marketloom.operators import series
from marketloom.operators.series import Layout, Prefix
from marketloom.session import settle

#: Bars the last gap reaches back into coverage, to notice rewritten history (fixed value).
OVERLAP_BARS = 3
#: A price that moved by more than this was revised (fixed value).
REVISION = 1e-6
#: Columns that are not prices, and prices best first (fixed values).
NON_PRICE = ("volume", "t", "date", "vwap_count")
PRICE_ORDER = ("adj_close", "close", "open", "high", "low")


def pieces(ranges: DataFrame, step: str, keys: tuple[str, ...], layout: Layout) -> DataFrame:
    """Ranges merged within each (key, time bucket of their start): one shuffle, and few
    rows are left where ranges lie close. Pieces of neighbouring buckets may still touch."""
    b = series.BUCKET
    rows = ranges.select(*keys, "s", "e").where("s <= e")
    rows = rows.withColumn(b, layout.bucket(rows))
    inside = Window.partitionBy(*keys, b).orderBy("s", "e")
    reach = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", _opens(reach, step).cast("int"))
    rows = rows.withColumn("_piece", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, b, "_piece").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*keys, "s", "e")


def _opens(reach: Column, step: str) -> Column:
    """Does a range that starts at `s` leave a hole behind what reaches to `reach`?"""
    return reach.isNull() | (F.col("s") - intervals.step_literal(step) > reach)


def coalesce(ranges: DataFrame, step: str, keys: tuple[str, ...] = ("sym",), layout: Layout | None = None) -> DataFrame:
    """Merge ranges that overlap or lie within one step. A range that ends before it
    starts is left out. The ranges are shuffled once; the two scans read merged pieces."""
    layout = (layout or Layout(bucket_seconds=30 * 86400)).with_(keys=keys, order=("s", "e"))
    reach = series.scan(pieces(ranges, step, keys, layout), layout, {"_reach": Prefix("max", F.col("e"), False)})
    flagged = reach.withColumn("_new", _opens(F.col("_reach"), step).cast("long"))
    island = series.scan(flagged, layout, {"_island": Prefix("sum", F.col("_new"))})
    return (island.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island"))


def subtract(requests: DataFrame, covered: DataFrame, step: str, keys: tuple[str, ...] = ("sym",),
             layout: Layout | None = None, slice_seconds: int = 30 * 86400) -> DataFrame:
    """Parts of each request (`request`, unique; keys, `start`, `end`) that `covered` lacks.

    One sweep in time over covered pieces and request starts carries how far coverage
    reaches. A piece that starts beyond it closes a hole; a request that starts beyond it
    begins in one. A request meets the holes with an edge inside it on equal time slices;
    no request is paired with a whole key's coverage.
    """
    layout = (layout or Layout(bucket_seconds=365 * 86400)).with_(keys=keys, order=("s", "_request", "e"))
    one = intervals.step_literal(step)
    stamp = F.lit(None).cast("timestamp")
    have = pieces(covered, step, keys, layout)
    req = requests.select("request", *keys, F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("end")).where("start <= end")
    # at one instant coverage comes before the requests that start there
    events = have.select(*keys, "s", "e", F.lit(False).alias("_request"), F.lit(None).cast(req.schema["request"].dataType).alias("request"), stamp.alias("end")).unionByName(
        req.select(*keys, F.col("start").alias("s"), stamp.alias("e"), F.lit(True).alias("_request"), "request", "end"))
    swept = settle(series.scan(events, layout, {"_reach": Prefix("max", F.col("e"), False)}), "swept")
    opened = swept.where(~F.col("_request") & _opens(F.col("_reach"), step)).select(*keys, F.col("_reach").alias("lo"), F.col("s").alias("hi"))
    last = swept.where(~F.col("_request")).groupBy(*keys).agg(F.max("e").alias("lo")).withColumn("hi", stamp)
    holes = opened.unionByName(last)
    asked = swept.where("_request").select("request", *keys, F.col("s").alias("start"), "end", "_reach")

    def part(c: Column) -> Column:
        return F.floor(F.unix_seconds(c) / F.lit(slice_seconds)).cast("long")

    # a struct finds keys that are null, too
    key = F.struct(*keys).alias("_k")
    spread = asked.select("*", key).withColumn("_slice", F.explode(F.sequence(part(F.col("start")), part(F.col("end")))))
    # Holes that open inside a request, at its start included.
    inner = (spread.join(holes.where("lo is not null").select(key, "lo", "hi", part(F.col("lo")).alias("_slice")), ["_k", "_slice"])
             .where("start <= lo AND lo < end").select("request", *keys, "start", "end", (F.col("lo") + one).alias("s"), "hi"))
    # The hole that a request starts in may close inside it.
    begun = spread.where("_reach is null OR _reach < start")
    closing = opened.select(key, F.col("hi").alias("_hi"), part(F.col("hi")).alias("_slice"))
    first = (begun.join(closing, ["_k", "_slice"], "left").groupBy("request", *keys, "start", "end")
             .agg(F.min(F.when((F.col("_hi") > F.col("start")) & (F.col("_hi") <= F.col("end")), F.col("_hi"))).alias("hi"))
             .select("request", *keys, "start", "end", F.col("start").alias("s"), "hi"))
    stop = F.when(F.col("hi").isNull() | (F.col("hi") > F.col("end")), F.col("end")).otherwise(F.col("hi") - one)
    return first.unionByName(inner).select("request", *keys, "start", "end", "s", stop.alias("e")).where("s <= e")


def trim_tail(ranges: DataFrame, boundary: Column) -> DataFrame:
    """Clip at the last complete bar; ranges that start after it go."""
    return ranges.filter(F.col("s") <= boundary).withColumn("e", F.least(F.col("e"), boundary))


def plan(requests: DataFrame, covered: DataFrame, interval: str, now: Column,
         keys: tuple[str, ...] = ("sym",), layout: Layout | None = None) -> DataFrame:
    """The fetches each request needs, one row per gap.

    Coverage counts only up to the last complete bar at `now`. The last gap of a
    request reaches `OVERLAP_BARS` bars back into coverage (`compare`), never past
    its start; intraday fetches are widened to whole days.
    """
    trimmed = trim_tail(covered, intervals.last_complete(interval, now))
    gaps = subtract(requests, trimmed, interval, keys, layout)
    last = gaps.groupBy("request").agg(F.max("s").alias("_last"))
    floor = trimmed.groupBy(*keys).agg(F.min("s").alias("_floor"))
    one = intervals.step(interval)
    back = F.col("s") - F.make_dt_interval(secs=F.lit(one.total_seconds() * OVERLAP_BARS).cast("decimal(18,6)"))
    reach = F.greatest("_floor", back)
    compare = (F.col("s") == F.col("_last")) & F.col("_floor").isNotNull() & (reach < F.col("s"))
    out = gaps.join(last, "request").join(floor, list(keys), "left").withColumns({
        "compare": F.coalesce(compare, F.lit(False))}).withColumn(
        "fetch_start", F.when(F.col("compare"), reach).otherwise(F.col("s")))
    wire_start, wire_end = F.col("fetch_start"), F.col("e")
    if one.total_seconds() < 86400:
        wire_start = F.date_trunc("day", wire_start)
        wire_end = F.date_trunc("day", wire_end) + F.expr("INTERVAL 1 DAY") - intervals.step_literal(interval)
    return out.select("request", *keys, F.col("s").alias("gap_start"), F.col("e").alias("gap_end"),
                      "fetch_start", wire_start.alias("wire_start"), wire_end.alias("wire_end"), "compare")


def coverage_status(requests: DataFrame, covered: DataFrame, interval: str, now: Column,
                    keys: tuple[str, ...] = ("sym",), layout: Layout | None = None) -> DataFrame:
    """hit, partial or miss per request, and its number of gaps."""
    trimmed = trim_tail(covered, intervals.last_complete(interval, now))
    gaps = (subtract(requests, trimmed, interval, keys, layout).groupBy("request")
            .agg(F.count("*").alias("gaps")))
    known = trimmed.select(*keys).distinct().withColumn("_known", F.lit(True))
    n = F.coalesce("gaps", F.lit(0).cast("long"))
    status = F.when(n == 0, "hit").when(F.col("_known"), "partial").otherwise("miss")
    return (requests.join(gaps, "request", "left").join(known, list(keys), "left")
            .select("request", *keys, n.alias("gaps"), status.alias("status")))


def served_rows(served: DataFrame, fetched: DataFrame, keys: tuple[str, ...] = ("sym",), time: str = "t") -> DataFrame:
    """Rows served from the cache and from fresh fetches, per key."""
    fresh = fetched.select(*keys, time).distinct().withColumn("_fresh", F.lit(True))
    return (served.join(fresh, [*keys, time], "left").groupBy(*keys)
            .agg(F.count_if(F.col("_fresh").isNull()).alias("from_cache"),
                 F.count_if(F.col("_fresh")).alias("from_upstream")))


def comparable_column(cached: DataFrame, fresh: DataFrame) -> str | None:
    """A numeric price column both sides have, the preferred one first."""
    shared = [f.name for f in cached.schema if f.name in fresh.columns and f.name not in NON_PRICE
              and f.dataType.typeName() in ("double", "float", "integer", "long")
              and fresh.schema[f.name].dataType.typeName() in ("double", "float", "integer", "long")]
    return next((c for c in PRICE_ORDER if c in shared), shared[0] if shared else None)


def revised_history(cached: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("sym",), time: str = "t") -> DataFrame:
    """Per key with shared bars: did any already known price change?"""
    price = comparable_column(cached, fresh)
    if price is None:
        return cached.select(*keys).distinct().withColumn("revised", F.lit(False))
    both = cached.select(*keys, time, F.col(price).alias("_old")).join(
        fresh.select(*keys, time, F.col(price).alias("_new")), [*keys, time])
    moved = F.coalesce(F.abs(F.col("_old") - F.col("_new")) > REVISION, F.lit(False))
    return both.groupBy(*keys).agg(F.bool_or(moved).alias("revised"))


def missing_weekdays(requests: DataFrame, held: DataFrame, keys: tuple[str, ...] = ("listing_id",),
                     policy: str = "missing_only", layout: Layout | None = None) -> DataFrame:
    """Spans of each request (`request`, keys, `start`, `end` dates) to fetch.

    A missing weekday opens a span and the next held day closes it; a hole that
    is only a weekend opens none. `refresh` and `force` want the whole request.
    """
    if policy in ("refresh", "force"):
        return requests.select("request", *keys, F.col("start").alias("s"), F.col("end").alias("e"))
    as_ts = requests.withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})
    days = held.select(*keys, F.col("day").cast("timestamp").alias("s")).distinct().withColumn("e", F.col("s"))
    gaps = subtract(as_ts, days, "1d", keys, layout)
    s, e = F.to_date("s"), F.to_date("e")
    # weekday(): Monday is 0; Saturday and Sunday move on to Monday.
    opens = F.date_add(s, F.when(F.weekday(s) == 5, 2).when(F.weekday(s) == 6, 1).otherwise(0))
    return gaps.select("request", *keys, opens.alias("s"), e.alias("e")).filter(F.col("s") <= F.col("e"))


def request_span(gaps: DataFrame, keys: tuple[str, ...] = ("listing_id",)) -> DataFrame:
    """One span per key that holds all its gaps."""
    return gaps.groupBy(*keys).agg(F.min("s").alias("start"), F.max("e").alias("end"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("sym", "interval", "t"),
           seq: str = "write_seq") -> DataFrame:
    """Bars with the last write per stamp."""
    from marketloom.operators.topk import latest

    return latest(stored.unionByName(incoming, allowMissingColumns=True), keys, (F.col(seq).desc(),))
