"""Weekly load bookkeeping: pending, retries, settling, completion, blocklists."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.topk import latest

#: Weeks of failures that block a symbol; days a daily block lasts (fixed values).
BLOCK_WEEKS, BLOCK_DAYS = 5, 21


def record(progress: DataFrame, results: DataFrame) -> DataFrame:
    """Progress after an attempt: newest outcome per (week, symbol), retries counted.

    Both hold `week, symbol, attempt, status, rows, error, at`; a load without rows is
    `empty`, an error is `failed`.
    """
    status = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("rows", F.lit(0)) == 0, "empty").otherwise("done")
    both = progress.unionByName(results.withColumn("status", status), allowMissingColumns=True)
    tries = both.groupBy("week", "symbol").agg(F.count_if(F.col("status") == "failed").alias("retries"))
    return latest(both, ("week", "symbol"), (F.col("attempt").desc(),)).join(tries, ["week", "symbol"])


def pending(universe: DataFrame, state: DataFrame) -> DataFrame:
    """Members not yet done or known empty."""
    settled = state.filter("status in ('done', 'empty')")
    return universe.join(settled.select("week", "symbol"), ["week", "symbol"], "left_anti")


def retryable(state: DataFrame, retry_max: int) -> DataFrame:
    return state.filter((F.col("status") == "failed") & (F.col("retries") < retry_max))


def retry_due(weeks: DataFrame, state: DataFrame, retry_max: int, now: Column) -> DataFrame:
    """Finished weeks with something to retry and no retry in the last 24 hours."""
    again = retryable(state, retry_max).select("week").distinct()
    rested = F.col("retried_at").isNull() | (F.col("retried_at") <= now - F.expr("INTERVAL 24 HOURS"))
    return weeks.filter(F.col("finished").isNotNull() & rested).join(again, "week", "left_semi")


def settle_due(weeks: DataFrame, lag_days: int, now: Column) -> DataFrame:
    """Finished, unsettled weeks first fetched before their settle point, which has passed."""
    at = (F.date_add("week", 4).cast("timestamp") + F.expr(f"INTERVAL {int(lag_days)} DAYS"))
    return weeks.filter(F.col("finished").isNotNull() & F.col("settled").isNull() & F.col("started").isNotNull()
                        & (F.col("started") < at) & (at <= now))


def completion(daily: DataFrame, members: DataFrame, today: date) -> DataFrame:
    """Weeks judged from daily records.

    `daily(symbol, day, rows)`, `members(week, symbol)`. A week whose Saturday has come
    is judged: a trading day is one on which any member has rows; a member with a record
    for each is done, else failed with the days it lacks. `settled` from Friday plus 7.
    """
    week = F.date_trunc("week", "day").cast("date")
    have = daily.withColumn("week", week).join(members, ["week", "symbol"]).filter(
        F.date_diff("day", F.col("week")) <= 4)
    due = have.filter(F.date_add("week", 5) <= F.lit(today))
    trading = due.filter("rows > 0").select("week", "day").distinct()
    spine = members.join(trading, "week")
    kept = due.groupBy("week", "symbol", "day").agg(F.max("rows").alias("rows"))
    joined = spine.join(kept, ["week", "symbol", "day"], "left")
    # A week has at most five days per member.
    out = joined.groupBy("week", "symbol").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.array_sort(F.collect_list(F.when(F.col("rows").isNull(), F.col("day")))).alias("missing"))
    return out.withColumns({"status": F.when(F.size("missing") == 0, "done").otherwise("failed"),
                            "settled": F.date_add("week", 11) <= F.lit(today)})


def blocklist(failures: DataFrame, tenure: DataFrame | None = None, threshold: int = BLOCK_WEEKS) -> DataFrame:
    """Symbols unservable in at least `threshold` weeks, blocked up to the newest.

    `failures(symbol, week, error)`; only `unservable...` errors count, and with
    `tenure(symbol, week, in_tenure)` only weeks inside the symbol's membership.
    """
    hard = failures.filter(F.startswith("error", F.lit("unservable")))
    if tenure is not None:
        outside = tenure.filter(~F.col("in_tenure")).select("symbol", "week")
        hard = hard.join(outside, ["symbol", "week"], "left_anti")
    return (hard.groupBy("symbol").agg(F.count_distinct("week").alias("weeks"), F.max("week").alias("blocked_to"))
            .filter(F.col("weeks") >= threshold))


def blocked_for_week(blocks: DataFrame, week: date) -> DataFrame:
    return blocks.filter(F.lit(week) <= F.col("blocked_to"))


def blocked_daily(blocks: DataFrame, today: date) -> DataFrame:
    return blocks.filter(F.col("blocked_to") >= F.date_sub(F.lit(today), BLOCK_DAYS))


def latest_complete_monday(now: datetime) -> date:
    """Monday of the newest week whose Friday is served: from Saturday 08:00 UTC."""
    monday = now.date() - timedelta(days=now.weekday())
    early = now.weekday() < 5 or (now.weekday() == 5 and now.hour < 8)
    return monday - timedelta(days=7) if early else monday


def daily_due(local_now: datetime, finished: set[date]) -> date | None:
    """The exchange-local day a daily pass is due for: after 02:05, Tuesday to Saturday,
    once a day."""
    if (local_now.hour, local_now.minute) < (2, 5) or local_now.weekday() in (6, 0):
        return None
    return None if local_now.date() in finished else local_now.date()


def newest_complete_week(now: Column) -> Column:
    """The same Monday as `latest_complete_monday`, of each instant (UTC) of a column."""
    monday, day = F.date_trunc("week", now).cast("date"), F.weekday(now)
    return F.when((day < 5) | ((day == 5) & (F.hour(now) < 8)), F.date_sub(monday, 7)).otherwise(monday)


def days_due(passes: DataFrame, finished: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """The exchange-local days that daily passes at `now` (UTC) are due for, each once:
    after 02:05, Tuesday to Saturday, and not among `finished(day)`."""
    local = F.from_utc_timestamp("now", zone)
    open_ = (F.hour(local) * 60 + F.minute(local) >= 125) & F.weekday(local).between(1, 5)
    days = passes.filter(open_).select(F.to_date(local).alias("day")).distinct()
    return days.join(finished.select("day"), "day", "left_anti")
