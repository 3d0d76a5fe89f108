"""Streams replayed from the given events; each must equal the batch result."""

from pyspark.sql import functions as F

from marketloom import views
from marketloom.operators import bars
from marketloom.operators import indicators as ind
from marketloom.plans.registry import query
from marketloom.streaming import live


def tick_stream(spark, sf):
    """The events file as a stream of ticks."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = live.replay(spark, sf, schema, glob="events.parquet")
    return raw.select(F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("price"),
                      F.get_json_object("props", "$.k").cast("double").alias("size"), F.col("event_id").alias("seq"))


_OHLCV = """arg_min(price, (time, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (time, seq)) AS close,
    sum(size) AS volume, round(sum(price * size) / nullif(sum(size), 0), 8) AS vwap, count(*) AS trades"""


@query("stream_bars", f"SELECT sym, time_bucket(INTERVAL '1 hour', time) AS date, {_OHLCV} FROM ticks GROUP BY 1, 2", ("ticks",))
def stream_bars(spark, sf):
    out = live.drain(live.live_bars(tick_stream(spark, sf), "1h"), "update", "bars")
    return live.settled(out, ("sym", "date")).withColumn("vwap", F.round("vwap", 8))


@query("stream_quotes", """SELECT sym, CAST(time AS DATE) AS day, arg_max(price, (time, seq)) AS price, arg_min(price, (time, seq)) AS day_open,
    max(price) AS day_high, min(price) AS day_low, arg_max(size, (time, seq)) AS last_size, max(time) AS updated_at FROM ticks GROUP BY 1, 2""", ("ticks",))
def stream_quotes(spark, sf):
    out = live.drain(live.quote_state(tick_stream(spark, sf)), "update", "quotes")
    return live.settled(out, ("sym", "day"))


@query("stream_avwap", """SELECT sym, max(time) AS time, round(sum(price * size) / sum(size), 8) AS avwap FROM ticks
    WHERE time >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY 1""", ("ticks",))
def stream_avwap(spark, sf):
    out = live.drain(live.avwap_state(tick_stream(spark, sf), "2024-01-05"), "update", "avwap")
    return live.settled(out, ("sym",)).withColumn("avwap", F.round("avwap", 8))


@query("stream_dedupe", "SELECT sym, time, price, size, seq FROM ticks", ("ticks",))
def stream_dedupe(spark, sf):
    t = tick_stream(spark, sf)
    return live.drain(live.dedupe(t.unionByName(t)), "append", "dedupe").drop("batch_id")


@query("stream_subscribed", "SELECT sym, time, price FROM ticks WHERE sym IN ('click', 'view')", ("ticks",))
def stream_subscribed(spark, sf):
    subs = spark.createDataFrame([("click",), ("view",)], "sym string")
    return live.drain(live.subscribed(tick_stream(spark, sf), subs), "append", "subs").select("sym", "time", "price")


@query("stream_indicator_push", """WITH b AS (SELECT sym AS symbol, time_bucket(INTERVAL '1 hour', time) AS date, arg_max(price, (time, seq)) AS close,
      max(price) AS high, min(price) AS low FROM ticks GROUP BY 1, 2),
    i AS (SELECT *, CASE WHEN count(*) OVER w = 14 THEN -100 * (max(high) OVER w - close) / nullif(max(high) OVER w - min(low) OVER w, 0) END AS willr
      FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)),
    l AS (SELECT sym AS symbol, max(time_bucket(INTERVAL '1 hour', time)) AS last FROM ticks WHERE time < TIMESTAMP '2024-01-25' GROUP BY 1)
    SELECT symbol, date, close, round(willr, 4) AS willr FROM i JOIN l USING (symbol) WHERE date >= last""", ("ticks",))
def stream_indicator_push(spark, sf):
    cut = F.lit("2024-01-25").cast("timestamp")
    history = views.ticks(spark, sf).filter(F.col("time") < cut)
    push = live.indicator_push(history, [ind.resolve("willr")], "1h")
    out = live.drain(tick_stream(spark, sf).filter(F.col("time") >= cut), "append", "push", push)
    return out.select("symbol", "date", "close", F.round(F.col("`willr|period=14`"), 4).alias("willr"))


_MSG = """SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'forex' WHEN 'view' THEN 'crypto' ELSE 'us' END AS feed, CAST(user_id AS VARCHAR) AS sym,
    ts AS time, value, event_type FROM events"""


def _messages(spark, sf):
    e = views.table(spark, sf, "events")
    ms = F.unix_millis("ts")
    body = F.when(F.col("event_type") == "click", F.to_json(F.struct(
        F.col("user_id").cast("string").alias("s"), F.when(F.col("value") > 20, F.col("value")).alias("b"), (F.col("value") + 1).cast("string").alias("a"), ms.alias("t")))).when(
        F.col("event_type") == "signup", F.to_json(F.struct(F.col("user_id").cast("string").alias("s"), F.lit("NA").alias("p"), ms.alias("t")))).when(
        F.col("event_type") == "view", F.to_json(F.struct(F.col("user_id").cast("string").alias("s"), F.col("value").alias("p"), F.lit(2.5).alias("q"), F.lit(9).alias("v"), ms.alias("t")))).otherwise(
        F.to_json(F.struct(F.col("user_id").cast("string").alias("s"), F.col("value").alias("p"), F.lit(7).alias("v"), ms.alias("t"))))
    feed = F.expr("CASE event_type WHEN 'click' THEN 'forex' WHEN 'view' THEN 'crypto' ELSE 'us' END")
    return e.select(feed.alias("feed"), F.col("event_id").alias("seq"), body.alias("payload"))


@query("tick_normalise", f"""WITH m AS ({_MSG}) SELECT feed, seq, sym, date_trunc('millisecond', time) AS time,
    CASE WHEN feed = 'forex' THEN CASE WHEN value > 20 THEN (value + (value + 1)) / 2 ELSE value + 1 END ELSE value END AS price,
    CASE WHEN feed = 'crypto' THEN 2.5 WHEN feed = 'us' THEN 7.0 END::DOUBLE AS size FROM m WHERE event_type <> 'signup'""")
def tick_normalise(spark, sf):
    return live.normalise(_messages(spark, sf)).drop("bid", "ask")


@query("feed_status", f"""WITH m AS ({_MSG}), s AS (SELECT feed, max(date_trunc('millisecond', time)) AS last_tick FROM m WHERE event_type <> 'signup' GROUP BY 1)
    SELECT feed, last_tick, CAST(epoch(TIMESTAMP '2024-01-31 15:00:00') AS BIGINT) - CAST(floor(epoch(last_tick)) AS BIGINT) AS age_seconds,
    TRUE AS stale FROM s""")
def feed_status(spark, sf):
    return live.feed_status(live.normalise(_messages(spark, sf)), F.lit("2024-01-31 15:00:00").cast("timestamp"))


@query("leases_active", """WITH r AS (SELECT upper('s' || user_id) AS sym, ts AS at_, CASE WHEN event_type = 'view' THEN 7200.0 ELSE 86400.0 END AS ttl FROM events)
    SELECT sym, arg_max(at_ + to_microseconds(CAST(ttl * 1000000 AS BIGINT)), at_) AS expiry FROM r GROUP BY 1 HAVING expiry > TIMESTAMP '2024-01-31 00:00:00'""")
def leases_active(spark, sf):
    r = views.table(spark, sf, "events").select(F.concat(F.lit(" s"), "user_id").alias("sym"), F.col("ts").alias("at"),
                                                F.when(F.col("event_type") == "view", 7200).alias("ttl"))
    return live.leases(r, F.lit("2024-01-31").cast("timestamp"), 86400)


@query("snapshots_fresh", """SELECT CAST(user_id AS VARCHAR) AS sym, ts AS fetched, value AS price FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1 AND ts >= TIMESTAMP '2024-01-30 12:00:00'""")
def snapshots_fresh(spark, sf):
    s = views.ticks(spark, sf, "user_id").select("sym", F.col("time").alias("fetched"), "price")
    return live.fresh_snapshots(s, F.lit("2024-01-31").cast("timestamp"), 43200)


@query("ticks_retained", "SELECT sym, time, price, size, seq FROM user_ticks WHERE time >= TIMESTAMP '2024-01-29 12:00:00'", ("user_ticks",))
def ticks_retained(spark, sf):
    return live.retained(views.ticks(spark, sf, "user_id"), F.lit("2024-01-30 12:00:00").cast("timestamp"))


@query("subscriber_snapshot", """SELECT sym, time, price, seq FROM ticks WHERE sym IN ('click', 'view')
    QUALIFY row_number() OVER (PARTITION BY sym ORDER BY time DESC, seq DESC) <= 500""", ("ticks",))
def subscriber_snapshot(spark, sf):
    subs = spark.createDataFrame([("click",), ("view",)], "sym string")
    return live.snapshot(views.ticks(spark, sf), subs).select("sym", "time", "price", "seq")


@query("previous_close", """SELECT symbol, arg_max(close, date) AS prev_close FROM daily_bars WHERE date < TIMESTAMP '1998-05-05' AND date >= TIMESTAMP '1998-04-25'
    GROUP BY 1""", ("daily_bars",))
def previous_close(spark, sf):
    return live.previous_close(views.daily_bars(spark, sf), F.lit("1998-05-05 14:00:00").cast("timestamp"))


@query("quotes_built", """WITH t AS (SELECT sym, arg_max(price, (time, seq)) AS price, max(time) AS time, arg_max(size, (time, seq)) AS size FROM user_ticks
      WHERE time >= TIMESTAMP '2024-01-29' GROUP BY 1),
    s AS (SELECT sym, min(price) AS price, max(price) AS prev FROM user_ticks GROUP BY 1), c AS (SELECT sym, avg(price) AS prev FROM user_ticks GROUP BY 1)
    SELECT s.sym, coalesce(t.price, s.price) AS last_price, t.time AS last_timestamp, CAST(t.size AS BIGINT) AS last_size, t.sym IS NULL AS delayed,
      round((coalesce(t.price, s.price) - CASE WHEN t.sym IS NULL THEN s.prev ELSE c.prev END) / CASE WHEN t.sym IS NULL THEN s.prev ELSE c.prev END, 8) AS change_percent
    FROM s JOIN c USING (sym) LEFT JOIN t USING (sym)""", ("user_ticks",))
def quotes_built(spark, sf):
    t = views.ticks(spark, sf, "user_id")
    snaps = t.groupBy("sym").agg(F.min("price").alias("price"), F.max("price").alias("prev_close")).withColumn("delayed", F.lit(True))
    closes = t.groupBy("sym").agg(F.avg("price").alias("prev_close"))
    out = live.quotes(t.filter(F.col("time") >= F.lit("2024-01-29").cast("timestamp")), snaps, closes)
    return out.select("sym", "last_price", "last_timestamp", "last_size", "delayed", F.round("change_percent", 8).alias("change_percent"))


@query("quotes_seeded", """WITH q AS (SELECT sym, arg_max(price, (time, seq)) AS price, max(price) AS hi, min(price) AS lo, max(time) AS updated_at FROM user_ticks
      WHERE time >= TIMESTAMP '2024-01-30' GROUP BY 1),
    s AS (SELECT sym, avg(price) AS price, avg(price) + 3 AS hi, avg(price) - 3 AS lo, min(price) AS prev FROM user_ticks GROUP BY 1)
    SELECT s.sym, round(coalesce(q.price, s.price), 6) AS price, round(greatest(q.hi, s.hi), 6) AS day_high, round(least(q.lo, s.lo), 6) AS day_low, updated_at
    FROM s LEFT JOIN q USING (sym)""", ("user_ticks",))
def quotes_seeded(spark, sf):
    t = views.ticks(spark, sf, "user_id")
    day = F.lit("2024-01-30").cast("timestamp")
    snap = t.groupBy("sym").agg(F.avg("price").alias("price"), (F.avg("price") + 3).alias("day_high"), (F.avg("price") - 3).alias("day_low"), F.min("price").alias("prev_close"))
    out = live.seeded(live.quote_state(t.filter(F.col("time") >= day)), snap)
    return out.select("sym", *[F.round(c, 6).alias(c) for c in ("price", "day_high", "day_low")], "updated_at")
