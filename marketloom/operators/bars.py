"""Ticks to bars, bars to coarser bars, per-symbol summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import intervals
from marketloom.operators import series
from marketloom.operators import sessions

#: Columns that can hold a trade's price or size, best first (fixed values).
PRICE_NAMES = ("price", "last", "close", "trade_price", "p")
SIZE_NAMES = ("size", "volume", "qty", "quantity", "amount", "v")


def arrival(time: str = "time", seq: str | None = "seq") -> Column:
    """Ordering key for first/last: time, then arrival number.

    One decimal instead of a struct keeps min_by/max_by in a hash aggregate, so
    partials need no sort; `seq=None` (times unique) orders by time alone.
    """
    if seq is None:
        return F.col(time)
    return (F.unix_micros(time).cast("decimal(20,0)") * F.lit(10 ** 18).cast("decimal(19,0)")
            + F.col(seq))


def ohlcv(order: Column, price: str = "price", size: str | None = "size", vwap: bool = True) -> list[Column]:
    out = [F.min_by(price, order).alias("open"), F.max(price).alias("high"),
           F.min(price).alias("low"), F.max_by(price, order).alias("close")]
    if size:
        out.append(F.sum(size).alias("volume"))
        if vwap:
            traded = F.sum(F.col(price) * F.col(size))
            # No size traded means no trade price, never a made-up one.
            out.append(F.when(F.sum(size) != 0, traded / F.sum(size)).alias("vwap"))
    return out


def from_ticks(ticks: DataFrame, interval: str, keys: tuple[str, ...] = ("sym",), seq: str | None = "seq",
               session: str = "all", anchor: Column | None = None, count: bool = False) -> DataFrame:
    """OHLCV and trade-weighted price per key and bucket; empty buckets do not exist.

    `session="regular"` keeps exchange-local [09:30, 16:00). `anchor` moves the
    bucket grid off the epoch.
    """
    src = ticks if session == "all" else ticks.filter(sessions.in_regular(F.col("time")))
    start = intervals.floor_to(F.col("time"), intervals.width_seconds(interval), anchor)
    extra = [F.count("*").alias("trades")] if count else []
    return src.groupBy(*keys, start.alias("date")).agg(*ohlcv(arrival("time", seq)), *extra)


def anchored_ticks(ticks: DataFrame, interval: str, keys: tuple[str, ...] = ("sym",)) -> DataFrame:
    """Buckets counted from the start of each key's first day."""
    first = ticks.groupBy(*keys).agg(F.date_trunc("day", F.min("time")).alias("_anchor"))
    joined = ticks.join(first, list(keys))
    return from_ticks(joined, interval, keys, anchor=F.col("_anchor"))


def coarsen(bars: DataFrame, interval: str, keys: tuple[str, ...] = ("symbol",), vwap: bool = True) -> DataFrame:
    """Bars to coarser bars; weeks carry their Sunday, months their last day.

    A bar without vwap still adds its volume below the line, as a zero trade sum
    would; a bucket without volume has no vwap.
    """
    count, unit = intervals.parse(interval)
    src, first = bars, None
    if unit in ("w", "mo") and count > 1:
        src = bars.join(bars.groupBy(*keys).agg(F.min("date").alias("_first")), list(keys))
        first = F.col("_first")
    label = intervals.period_label(F.col("date"), interval, first)
    return _roll(src, label, keys, vwap)


def daily_local(bars: DataFrame, feed: str = "us", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Daily bars on exchange-local calendar days, labelled at UTC midnight."""
    return _roll(bars, sessions.session_date(F.col("date"), feed).cast("timestamp"), keys, True)


def _roll(bars: DataFrame, label: Column, keys: tuple[str, ...], vwap: bool) -> DataFrame:
    aggs = [F.min_by("open", "date").alias("open"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.max_by("close", "date").alias("close")]
    if "volume" in bars.columns:
        aggs.append(F.sum("volume").alias("volume"))
        if vwap and "vwap" in bars.columns:
            traded = F.coalesce(F.sum(F.col("vwap") * F.col("volume")), F.lit(0.0))
            aggs.append(F.when(F.sum("volume") != 0, traded / F.sum("volume")).alias("vwap"))
    return bars.withColumn("_label", label).groupBy(*keys, F.col("_label").alias("date")).agg(*aggs)


def resolve_role(columns: list[str], names: tuple[str, ...]) -> str | None:
    """First of `names` the table carries, in the table's own spelling."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[n] for n in names if n in by_lower), None)


def resample(df: DataFrame, interval: str, keys: tuple[str, ...] = ("symbol",), time: str = "date",
             tie: str | None = None, vwap: bool = False) -> DataFrame:
    """OHLCV of any table: bars are coarsened, anything with a price is rolled up."""
    lower = {c.lower(): c for c in df.columns}
    if {"open", "high", "low", "close"} <= set(lower):
        cols = [F.col(lower[c]).alias(c) for c in ("open", "high", "low", "close", "volume", "vwap") if c in lower]
        return coarsen(df.select(*keys, F.col(time).alias("date"), *cols), interval, keys, vwap)
    price = resolve_role(df.columns, PRICE_NAMES)
    if price is None:
        raise ValueError("cannot resample: no OHLC columns and no price column")
    size = resolve_role(df.columns, SIZE_NAMES)
    count, unit = intervals.parse(interval)
    first = None
    if unit in ("w", "mo") and count > 1:
        df = df.join(df.groupBy(*keys).agg(F.min(time).alias("_first")), list(keys))
        first = F.col("_first")
    label = intervals.period_label(F.col(time), interval, first)
    return (df.withColumn("_label", label).groupBy(*keys, F.col("_label").alias("date"))
            .agg(*ohlcv(arrival(time, tie), price, size, vwap)))


def stats(ticks: DataFrame, keys: tuple[str, ...] = ("sym",)) -> DataFrame:
    """Last time, last price and number of ticks per key."""
    return ticks.groupBy(*keys).agg(F.max("time").alias("last_time"),
                                    F.max_by("price", arrival()).alias("last_price"),
                                    F.count("*").alias("ticks"))


def span(ticks: DataFrame, keys: tuple[str, ...] = ("sym",)) -> DataFrame:
    """First and last tick time; a key without ticks has no row."""
    return ticks.groupBy(*keys).agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"))


def anchored_vwap(ticks: DataFrame, anchor: str, interval: str, keys: tuple[str, ...] = ("sym",)) -> DataFrame:
    """Trade-weighted price since `anchor`, thinned to the last point per bucket.

    An anchor that cannot be read selects nothing, never everything. Only bucket
    sums are carried: the value at a bucket's end is the cumulative sum of sums,
    and the point keeps the time of the bucket's last trade.
    """
    at = F.expr("try_to_timestamp(:a)".replace(":a", _quote(anchor.replace("Z", "+00:00"))))
    start = intervals.floor_to(F.col("time"), intervals.width_seconds(interval))
    sums = (ticks.filter(F.col("time") >= at).groupBy(*keys, start.alias("bucket"))
            .agg(F.max("time").alias("time"), F.sum(F.col("price") * F.col("size")).alias("pv"),
                 F.sum("size").alias("vol")))
    # A year of one-second points is cut into spans of 20,000 buckets before sums are carried.
    layout = series.Layout(keys=keys, order=("bucket",), bucket_seconds=20_000 * intervals.width_seconds(interval))
    run = series.scan(sums, layout, {"_pv": series.Prefix("sum", F.col("pv")), "_vol": series.Prefix("sum", F.col("vol"))})
    return run.select(*keys, "bucket", "time", F.when(F.col("_vol") != 0, F.col("_pv") / F.col("_vol")).alias("avwap"))


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
