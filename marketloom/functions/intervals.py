"""Interval strings: widths, bucket floors, period-end labels, boundaries."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds per fixed-width unit; `M` is not `m`, months are `mo` (fixed values).
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
#: Spellings of each unit (fixed values).
SPELLINGS = {
    "s": ("s", "sec", "secs", "second", "seconds"),
    "m": ("m", "min", "mins", "minute", "minutes", "t"),
    "h": ("h", "hr", "hour", "hours"),
    "d": ("d", "day", "days"),
    "w": ("w", "wk", "week", "weeks"),
    "mo": ("mo", "mon", "month", "months", "mth"),
}
_UNITS = {word: unit for unit, words in SPELLINGS.items() for word in words}
_SHAPE = re.compile(r"^(\d*)\s*([a-zA-Z]+)$")


def parse(interval: str) -> tuple[int, str]:
    """`5m` -> (5, 'm'); no count means one; capital `M` is a month."""
    found = _SHAPE.match(str(interval).strip())
    unit = found and ("mo" if found[2] == "M" else _UNITS.get(found[2].lower()))
    count = int(found[1] or 1) if found else 0
    if not unit or count < 1:
        raise ValueError(f"unsupported interval {interval!r}")
    return count, unit


def width_seconds(interval: str) -> int:
    """Width of a fixed interval; weeks and months have none here."""
    count, unit = parse(interval)
    if unit not in ("s", "m", "h", "d"):
        raise ValueError(f"{interval!r} has no fixed width")
    return count * SECONDS[unit]


def step(interval: str) -> timedelta:
    """One bar; a month counts as 30 days."""
    count, unit = parse(interval)
    return timedelta(days=30 * count) if unit == "mo" else timedelta(seconds=count * SECONDS[unit])


def step_literal(interval: str) -> Column:
    return F.make_dt_interval(secs=F.lit(step(interval).total_seconds()).cast("decimal(18,6)"))


def is_intraday(interval: str) -> bool:
    return bool(re.match(r"^\d+[smh]$", str(interval).strip()))


def floor_to(ts: Column, seconds: int, anchor: Column | None = None) -> Column:
    """Floor an instant to a width, counted from the epoch or from `anchor`."""
    width = F.lit(seconds * 1_000_000)
    micros = F.unix_micros(ts)
    off = micros if anchor is None else micros - F.unix_micros(anchor)
    return F.timestamp_micros(micros - F.pmod(off, width))


def bucket_start(ts: Column, interval: str) -> Column:
    """Start of the bucket that holds `ts`; weeks start on Monday."""
    count, unit = parse(interval)
    if unit == "w" and count == 1:
        return F.date_trunc("week", ts)
    if unit == "mo" and count == 1:
        return F.date_trunc("month", ts)
    return floor_to(ts, width_seconds(interval))


def period_label(ts: Column, interval: str, first: Column | None = None) -> Column:
    """Label of the bucket that holds `ts`: the start for fixed widths, the closing
    Sunday for weeks, the month's last day for months. Several weeks or months are
    counted from the bucket of `first`, the first row of the series."""
    count, unit = parse(interval)
    if unit == "w":
        end = F.date_add(F.date_trunc("week", ts).cast("date"), 6)
        if count > 1:
            base = F.date_add(F.date_trunc("week", first).cast("date"), 6)
            weeks = F.floor(F.datediff(end, base) / 7)
            end = F.date_add(base, (F.ceil(weeks / count) * 7 * count).cast("int"))
        return end.cast("timestamp")
    if unit == "mo":
        end = F.last_day(ts)
        if count > 1:
            base = F.last_day(first)
            months = (F.year(end) - F.year(base)) * 12 + F.month(end) - F.month(base)
            end = F.last_day(F.add_months(base, (F.ceil(months / count) * count).cast("int")))
        return end.cast("timestamp")
    return floor_to(ts, width_seconds(interval))


def last_complete(interval: str, now: Column) -> Column:
    """Stamp of the newest bar that is over at `now`."""
    count, unit = parse(interval)
    if unit == "mo":
        return F.add_months(F.date_trunc("month", now), -count).cast("timestamp")
    if unit == "w":
        return F.date_trunc("week", now) - F.expr(f"INTERVAL {7 * count} DAYS")
    if unit == "d":
        return F.date_trunc("day", now) - F.expr(f"INTERVAL {count} DAYS")
    return floor_to(now, width_seconds(interval)) - F.expr(f"INTERVAL {width_seconds(interval)} SECONDS")
