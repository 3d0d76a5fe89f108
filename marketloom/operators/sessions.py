"""Exchange sessions: regular hours, session dates, session roll-ups, and
indicators on business-day windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.classify import feed_of
from marketloom.functions.intervals import is_intraday

#: Regular session per feed: zone, open, close, half-open (fixed values).
SESSIONS = {"us": ("America/New_York", "09:30:00", "16:00:00")}


def local_time(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def in_regular(ts: Column, feed: str = "us") -> Column:
    """Inside the feed's session by exchange-local wall time, across DST."""
    if feed not in SESSIONS:
        return F.lit(True)
    zone, opens, closes = SESSIONS[feed]
    clock = F.date_format(local_time(ts, zone), "HH:mm:ss")
    return (clock >= opens) & (clock < closes)


def regular_only(bars: DataFrame, interval: str, symbol: str = "symbol") -> DataFrame:
    """Drop intraday bars outside their feed's session. Bars without a readable
    date, other feeds, and daily or coarser bars all stay."""
    if not is_intraday(interval):
        return bars
    has_session = feed_of(F.col(symbol)).isin(list(SESSIONS))
    return bars.filter(F.col("date").isNull() | ~has_session | in_regular(F.col("date")))


def session_date(ts: Column, feed: str = "us") -> Column:
    """Exchange-local calendar date; feeds without a session use UTC days."""
    zone = SESSIONS.get(feed, ("UTC",))[0]
    return F.to_date(local_time(ts, zone))


def session_date_of(symbol: Column, ts: Column) -> Column:
    """Session date where each row's own symbol decides the feed."""
    return F.when(feed_of(symbol) == "us", session_date(ts, "us")).otherwise(session_date(ts, "utc"))


def closes(bars: DataFrame, feed: str = "us", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per session: its bars rolled up, dated by its last bar."""
    how = {
        "date": F.max("date"), "open": F.min_by("open", "date"), "high": F.max("high"),
        "low": F.min("low"), "close": F.max_by("close", "date"),
        "adj_close": F.max_by("adj_close", "date"), "volume": F.sum("volume"),
        "vwap": F.max_by("vwap", "date"),
    }
    return (bars.withColumn("session_date", session_date(F.col("date"), feed))
            .groupBy(*keys, "session_date")
            .agg(*[c.alias(n) for n, c in how.items() if n in bars.columns]))


def running_session(bars: DataFrame, feed: str = "us", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """First bar of each key's last session."""
    first = bars.groupBy(*keys, session_date(F.col("date"), feed).alias("session_date")).agg(
        F.min("date").alias("first_bar"))
    return first.groupBy(*keys).agg(F.max("session_date").alias("session_date"),
                                    F.max_by("first_bar", "session_date").alias("first_bar"))


def business_days(bars: DataFrame, requests: list, interval: str, feed: str = "us", layout=None) -> DataFrame:
    """Requests whose windows count business days: computed on session closes and
    read back by every bar of the session. On daily bars they are plain bars."""
    from marketloom.operators.indicators import compute
    from marketloom.operators.series import Layout

    layout = layout or Layout()
    if not is_intraday(interval):
        return compute(bars, requests, layout)
    keys = list(layout.keys)
    rolled = compute(closes(bars, feed, layout.keys), requests, layout)
    names = list(dict.fromkeys(c for r in requests for c in r.columns()))
    picked = rolled.select(*keys, "session_date", *[F.col(f"`{c}`") for c in names])
    return (bars.withColumn("session_date", session_date(F.col("date"), feed))
            .join(picked, [*keys, "session_date"], "left").drop("session_date"))
