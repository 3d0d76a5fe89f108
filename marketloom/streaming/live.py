"""Live ticks as streams: normalise, quote state, bars, anchored VWAP, retention.

Functions take and return streaming (or batch) frames; `start` and `drain` attach
sinks. State is bounded by the watermark or by the number of symbols.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marketloom.functions import intervals
from marketloom.functions import scalar as x
from marketloom.operators import bars, topk
from marketloom.session import scratch_path

#: Wire fields of one message: symbol, price, size (two spellings), bid, ask, epoch ms (fixed values).
MESSAGE = "s string, p string, q string, v string, b string, a string, t double"
#: Seconds of silence that make a feed stale; ticks a new subscriber gets; default lease
#: and emission period (fixed values).
STALE_SECONDS, SNAPSHOT_ROWS, EMIT_EVERY = 300, 500, "250 milliseconds"


def normalise(messages: DataFrame, arrival: Column | None = None) -> DataFrame:
    """`feed, payload` text to ticks. Forex has a bid, an ask or both and no size; the
    others a price and `q`, else `v`. Without a price there is no tick."""
    m = F.from_json("payload", MESSAGE)
    rows = messages.select("feed", *[c for c in messages.columns if c not in ("feed", "payload")], m.alias("m"))
    fx = F.col("feed") == "forex"
    bid, ask = x.number(F.col("m.b")), x.number(F.col("m.a"))
    size = F.coalesce(x.number(F.col("m.q")), x.number(F.col("m.v")))
    stamp = F.timestamp_millis(F.col("m.t").cast("long"))
    out = rows.select(
        "feed", *[c for c in rows.columns if c not in ("feed", "m")], F.col("m.s").alias("sym"),
        F.coalesce(stamp, arrival if arrival is not None else F.current_timestamp()).alias("time"),
        F.when(fx, x.mid(bid, ask)).otherwise(x.number(F.col("m.p"))).alias("price"),
        F.when(~fx, size).alias("size"), F.when(fx, bid).alias("bid"), F.when(fx, ask).alias("ask"))
    return out.filter("sym <> '' and price is not null")


def dedupe(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """One tick per (sym, time, seq); state is dropped `delay` behind the newest tick."""
    keys = ["sym", "time", "seq"]
    if ticks.isStreaming:
        return ticks.withWatermark("time", delay).dropDuplicatesWithinWatermark(keys)
    return ticks.dropDuplicates(keys)


def live_bars(ticks: DataFrame, interval: str, delay: str = "1 day") -> DataFrame:
    """Tumbling OHLCV bars; a late tick inside `delay` revises its bar."""
    width = f"{intervals.width_seconds(interval)} seconds"
    src = ticks.withWatermark("time", delay) if ticks.isStreaming else ticks
    grouped = src.groupBy("sym", F.window("time", width)).agg(*bars.ohlcv(bars.arrival()), F.count("*").alias("trades"))
    return grouped.select("sym", F.col("window.start").alias("date"), "open", "high", "low", "close", "volume", "vwap", "trades")


def quote_state(ticks: DataFrame, delay: str = "2 days") -> DataFrame:
    """Latest price, sides and size per symbol and day, with the day's range so far.

    In update mode each batch emits only the symbols it touched.
    """
    at = bars.arrival()
    src = ticks.withWatermark("time", delay) if ticks.isStreaming else ticks
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    have = [c for c in ("bid", "ask") if c in ticks.columns]
    out = src.groupBy("sym", F.window("time", "1 day")).agg(
        F.max_by("price", at).alias("price"), F.min_by("price", at).alias("day_open"),
        F.max("price").alias("day_high"), F.min("price").alias("day_low"),
        F.max_by("size", F.when(F.col("size").isNotNull(), at)).alias("last_size"), *[last(c) for c in have],
        F.max("time").alias("updated_at"))
    return out.select("sym", F.to_date("window.start").alias("day"), "price", "day_open", "day_high", "day_low", "last_size",
                      *have, "updated_at")


def seeded(quotes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Quotes with the snapshot's range widened by live prices, and change against its
    previous close. Symbols without a tick show the snapshot."""
    snap = snapshots.select("sym", *[F.col(c).alias(f"_s_{c}") for c in ("price", "day_high", "day_low", "prev_close")])
    out = quotes.join(snap, "sym", "full_outer")
    price = F.coalesce("price", "_s_price")
    return out.select(
        "sym", price.alias("price"), F.greatest("day_high", "_s_day_high").alias("day_high"),
        F.least("day_low", "_s_day_low").alias("day_low"), F.when(F.col("_s_prev_close") != 0, price - F.col("_s_prev_close")).alias("change"),
        x.change_percent(price, F.col("_s_prev_close")).alias("change_percent"), "updated_at")


def avwap_state(ticks: DataFrame, anchor: str) -> DataFrame:
    """Trade-weighted price since the anchor, one running row per symbol. The state is
    two sums; an unreadable anchor yields nothing."""
    at = F.try_to_timestamp(F.lit(anchor))
    sums = ticks.filter(F.col("time") >= at).groupBy("sym").agg(
        F.sum(F.col("price") * F.col("size")).alias("pv"), F.sum("size").alias("vol"), F.max("time").alias("time"))
    return sums.select("sym", "time", F.when(F.col("vol") != 0, F.col("pv") / F.col("vol")).alias("avwap"))


def subscribed(ticks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Only ticks of subscribed symbols."""
    return ticks.join(subscriptions.select("sym").distinct(), "sym", "left_semi")


def snapshot(history: DataFrame, subscriptions: DataFrame, rows: int = SNAPSHOT_ROWS) -> DataFrame:
    """What a new subscriber gets first: the newest ticks of its symbols."""
    return topk.newest(subscribed(history, subscriptions), rows).drop("rank")


def retained(ticks: DataFrame, now: Column, window: str = "1 day") -> DataFrame:
    return ticks.filter(F.col("time") >= now - F.expr(f"INTERVAL {window}"))


def leases(renewals: DataFrame, now: Column, ttl_seconds: int = 60) -> DataFrame:
    """Symbols somebody still wants: newest renewal plus its span is ahead of `now`.
    `renewals(sym, at, ttl)`; a null ttl takes the default."""
    span = F.make_dt_interval(secs=F.coalesce("ttl", F.lit(ttl_seconds)).cast("decimal(18,6)"))
    clean = renewals.select(F.upper(F.trim("sym")).alias("sym"), "at", (F.col("at") + span).alias("expiry")).filter("sym <> ''")
    return clean.groupBy("sym").agg(F.max_by("expiry", "at").alias("expiry")).filter(F.col("expiry") > now)


def expects_ticks(feed: Column, when: Column) -> Column:
    """Is silence on the feed wrong at `when` (UTC)? Narrower than the real sessions."""
    day, minute = F.weekday(when), F.hour(when) * 60 + F.minute(when)
    forex = (day <= 3) | ((day == 4) & (minute < 21 * 60)) | ((day == 6) & (minute >= 22 * 60))
    us = (day < 5) & (minute >= 14 * 60 + 30) & (minute < 20 * 60)
    return F.when(feed == "crypto", True).when(feed == "forex", forex).when(feed == "us", us).otherwise(False)


def feed_status(ticks: DataFrame, now: Column) -> DataFrame:
    """Age of the last tick per feed, and whether that is a fault."""
    out = ticks.groupBy("feed").agg(F.max("time").alias("last_tick")).withColumn(
        "age_seconds", F.unix_seconds(now) - F.unix_seconds("last_tick"))
    return out.withColumn("stale", expects_ticks(F.col("feed"), now) & (F.col("age_seconds") >= STALE_SECONDS))


def fresh_snapshots(snapshots: DataFrame, now: Column, max_age_seconds: int) -> DataFrame:
    """Newest snapshot per symbol if fetched recently enough. `(sym, fetched, payload)`."""
    newest = topk.latest(snapshots, ("sym",), (F.col("fetched").desc(),))
    return newest.filter(F.col("fetched") >= now - F.expr(f"INTERVAL {int(max_age_seconds)} SECONDS"))


def previous_close(daily: DataFrame, now: Column, lookback_days: int = 10, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Close of the last daily bar before today, no older than the lookback."""
    today = F.date_trunc("day", now)
    recent = daily.filter((F.col("date") < today) & (F.col("date") >= today - F.expr(f"INTERVAL {int(lookback_days)} DAYS")))
    return recent.groupBy(*keys).agg(F.max_by("close", "date").alias("prev_close"))


def quotes(ticks: DataFrame, snapshots: DataFrame, closes: DataFrame) -> DataFrame:
    """Quote per symbol from its last tick, else from its snapshot (delayed).

    `snapshots(sym, price, prev_close, delayed)`, `closes(sym, prev_close)`.
    """
    tick = topk.latest_tick(ticks).select("sym", F.struct("price", "time", "size").alias("_t"))
    snap = snapshots.filter("price is not null").select("sym", F.struct("price", "prev_close", "delayed").alias("_s"))
    both = tick.join(snap, "sym", "full_outer").join(closes.withColumnRenamed("prev_close", "_pc"), "sym", "left")
    live = F.col("_t").isNotNull()
    price = F.coalesce("_t.price", "_s.price")
    prev = F.when(live, F.col("_pc")).otherwise(F.col("_s.prev_close"))
    return both.select("sym", price.alias("last_price"), F.col("_t.time").alias("last_timestamp"),
                       x.whole_or_null(F.col("_t.size")).alias("last_size"),
                       F.when(live, False).otherwise(F.coalesce("_s.delayed", F.lit(True))).alias("delayed"),
                       prev.alias("prev_close"), (price - prev).alias("change"), x.change_percent(price, prev).alias("change_percent"))


# --- sources and sinks ------------------------------------------------------------------


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 8, glob: str | None = None) -> DataFrame:
    """A tick log as a stream, oldest file first. The checkpoint of whoever reads it
    remembers what was taken, so a restart never replays twice."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def start(stream: DataFrame, path: str, checkpoint: str, trigger: str = EMIT_EVERY) -> StreamingQuery:
    """Append ticks to a day-partitioned table, one commit per trigger, exactly once."""
    return (stream.withColumn("day", F.to_date("time")).writeStream.partitionBy("day").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(processingTime=trigger).start())


def drive(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> list[dict]:
    """Run everything available now through `write(batch, batch_id)`; what Spark reported
    of each batch. Started again on the same checkpoint it goes on where it stopped: a
    batch that failed runs again under its old id, a finished one never does."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def append_batches(path: str, on_batch=None):
    """A batch writer that keeps each batch in a folder of its own id, so a batch that is
    tried again replaces what its first try left."""

    def write(df: DataFrame, batch_id: int) -> None:
        out = df if on_batch is None else on_batch(df, batch_id)
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch_id={batch_id}")

    return write


def written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What `append_batches` left, with `batch_id`; empty where no batch ran."""
    with_id = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.option("basePath", path).schema(with_id).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], with_id)


def drain(stream: DataFrame, mode: str = "append", label: str = "stream", on_batch=None, root: str | None = None) -> DataFrame:
    """Run everything available now and return all that came out, with `batch_id`.

    With the `root` of an earlier run it goes on from there, and returns that run's rows too.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, label)
    schema = stream.schema if on_batch is None else on_batch(spark.createDataFrame([], stream.schema), -1).schema
    drive(stream, append_batches(f"{root}/out", on_batch), f"{root}/checkpoint", mode)
    return written(spark, f"{root}/out", schema)


def arrived(progress: list[dict]) -> int:
    """Rows that the sources of some batches brought."""
    return sum(p["numInputRows"] for p in progress)


def settled(updates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The last update of every key of a drained update-mode stream."""
    return topk.latest(updates, keys, (F.col("batch_id").desc(),)).drop("batch_id")


def indicator_push(history: DataFrame, requests: list, interval: str):
    """A batch function: bars of the symbols a batch touched are rebuilt from history
    and the batch, indicators recomputed, and only rows from the last bar sent leave."""
    from marketloom.operators.indicators import compute
    from marketloom.operators.studies import revised

    def push(batch: DataFrame, batch_id: int) -> DataFrame:
        touched = batch.select("sym").distinct()
        old = history.join(touched, "sym", "left_semi")
        before = bars.from_ticks(old, interval).withColumnRenamed("sym", "symbol")
        now = bars.from_ticks(old.unionByName(batch.select(*old.columns)), interval).withColumnRenamed("sym", "symbol")
        return revised(compute(now, requests), before.select("symbol", "date"))

    return push
