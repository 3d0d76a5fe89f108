"""Streams fed in segments through one checkpoint: late ticks, restarts, retries, expiries, carried indicators.

Each query appends segments of the given events to a log of its own and runs the stream
after each, so every run is a restart and bars, leases and indicators span the runs.
"""

from pyspark.sql import functions as F

from marketloom import views
from marketloom.operators import indicators as ind
from marketloom.operators import topk
from marketloom.plans.registry import query
from marketloom.session import scratch_path
from marketloom.streaming import live, stateful

#: Where the events are cut into segments; the second lies inside an hour, a lease and a silence.
CUTS = ("2024-01-08 12:34:56", "2024-01-19 03:21:00")
#: Every seventh tick of the first segment comes with the second.
LATE = "event_id % 7 = 0"


def _segment(ts="ts"):
    """0, 1 or 2 by the cuts, in Spark SQL and DuckDB alike."""
    return " ".join(f"+ CASE WHEN {ts} >= TIMESTAMP '{c}' THEN 1 ELSE 0 END" for c in CUTS).removeprefix("+ ")


_ARRIVAL = f"CASE WHEN {LATE} AND {_segment()} = 0 THEN 1 ELSE {_segment()} END"


def _in_segments(spark, sf, shape, step, late=False):
    """Append segment after segment of the events to a log and call `step(root, log stream)` after each."""
    root = scratch_path(spark, "segments")
    events = views.table(spark, sf, "events").withColumn("_run", F.expr(_ARRIVAL if late else _segment()))
    rows = events.select(*shape, "_run")
    schema = rows.drop("_run").schema
    for n in range(len(CUTS) + 1):
        rows.filter(F.col("_run") == n).drop("_run").write.mode("append").parquet(f"{root}/log")
        step(root, live.replay(spark, f"{root}/log", schema, files_per_trigger=10_000))
    return root


def _ticks():
    return (F.col("event_type").alias("sym"), F.col("ts").alias("time"), F.col("value").alias("price"),
            F.get_json_object("props", "$.k").cast("double").alias("size"), F.col("event_id").alias("seq"))


_BARS = """sym, time_bucket(INTERVAL '1 hour', time) AS date, arg_min(price, (time, seq)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (time, seq)) AS close, sum(size) AS volume, round(sum(price * size) / nullif(sum(size), 0), 8) AS vwap, count(*) AS trades"""
_ARRIVED = f"""a AS (SELECT event_type AS sym, ts AS time, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, event_id AS seq, {_ARRIVAL} AS run FROM events),
    m AS (SELECT date_trunc('millisecond', max(time)) - INTERVAL '2 days' AS w FROM a WHERE run = 0),
    k AS (SELECT a.* FROM a, m WHERE run <> 1 OR time_bucket(INTERVAL '1 hour', time) + INTERVAL '1 hour' > w)"""


def _late(spark, sf):
    """Bars, and what each run's batches reported."""
    reports = []

    def step(root, log):
        bars = live.live_bars(log, "1h", delay="2 days")
        reports.append(live.drive(bars, live.append_batches(f"{root}/out"), f"{root}/checkpoint", "update"))
        step.schema = bars.schema

    root = _in_segments(spark, sf, _ticks(), step, late=True)
    return live.settled(live.written(spark, f"{root}/out", step.schema), ("sym", "date")), reports


@query("stream_late", f"WITH {_ARRIVED} SELECT {_BARS} FROM k GROUP BY 1, 2")
def stream_late(spark, sf):
    return _late(spark, sf)[0].withColumn("vwap", F.round("vwap", 8))


@query("stream_late_counts", f"""WITH {_ARRIVED} SELECT (SELECT count(*) FROM a) AS arrived, (SELECT count(*) FROM k) AS counted,
    (SELECT count(*) FROM a) - (SELECT count(*) FROM k) AS dropped""")
def stream_late_counts(spark, sf):
    """Ticks that came by query progress, ticks in bars, and the too late ones between."""
    bars, reports = _late(spark, sf)
    came = F.lit(sum(live.arrived(r) for r in reports)).cast("long")
    return bars.agg(came.alias("arrived"), F.sum("trades").alias("counted"), (came - F.sum("trades")).alias("dropped"))


@query("stream_restart", f"""WITH a AS (SELECT *, {_segment('time')} AS run FROM ticks), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE run = 0) AS first_run,
      count(*) FILTER (WHERE run = 1) AS second_run, count(*) FILTER (WHERE run = 2) AS third_run FROM a)
    SELECT sym, time, price, size, seq, first_run, second_run, third_run, CAST(0 AS BIGINT) AS idle_run FROM a, n""", ("ticks",))
def stream_restart(spark, sf):
    """Every tick once, though the stream was started four times, the last without news."""
    came = []

    def step(root, log):
        step.again = lambda: came.append(live.arrived(live.drive(log, live.append_batches(f"{root}/out"), f"{root}/checkpoint")))
        step.schema = log.schema
        step.again()

    root = _in_segments(spark, sf, _ticks(), step)
    step.again()
    counts = [F.lit(n).cast("long").alias(f"{name}_run") for n, name in zip(came, ("first", "second", "third", "idle"), strict=True)]
    return live.written(spark, f"{root}/out", step.schema).select("sym", "time", "price", "size", "seq", *counts)


class Unplugged(RuntimeError):
    """The fault that the retry query puts in."""


@query("stream_retry", f"""WITH a AS (SELECT *, {_segment('time')} AS run FROM ticks),
    d AS (SELECT DISTINCT run, sym FROM a)
    SELECT d.sym, d.run, arg_max(t.price, (t.time, t.seq)) AS price, max(t.time) AS time, arg_max(t.seq, (t.time, t.seq)) AS seq, count(*) FILTER (WHERE t.run = d.run) AS appended
    FROM d JOIN a t ON t.sym = d.sym AND t.run <= d.run GROUP BY d.sym, d.run""", ("ticks",))
def stream_retry(spark, sf):
    """Per run the latest row of the symbols it touched and the ticks it appended. The
    writer of the second run breaks after it has written; its batch is tried again."""
    runs = []

    def step(root, log):
        n = len(runs)
        write, broken = live.append_batches(f"{root}/out"), []

        def frail(df, batch_id):
            write(df, batch_id)
            if n == 1 and not broken:
                broken.append(batch_id)
                raise Unplugged("the sink went away after the write")

        try:
            live.drive(log, frail, f"{root}/checkpoint")
        except Exception as exc:
            if "the sink went away" not in str(exc):
                raise
            live.drive(log, frail, f"{root}/checkpoint")
        step.schema = log.schema
        runs.append(n)

    root = _in_segments(spark, sf, _ticks(), step)
    ticks = live.written(spark, f"{root}/out", step.schema).withColumn("run", F.col("batch_id"))
    appended = ticks.groupBy("run", "sym").agg(F.count("*").alias("appended"), F.max(F.struct("time", "seq", "price")).alias("last"))
    upto = appended.alias("d").join(appended.alias("t"), (F.col("d.sym") == F.col("t.sym")) & (F.col("t.run") <= F.col("d.run")))
    best = upto.groupBy(F.col("d.sym").alias("sym"), F.col("d.run").alias("run")).agg(F.max("t.last").alias("last"), F.max(F.when(F.col("t.run") == F.col("d.run"), F.col("t.appended"))).alias("appended"))
    return best.select("sym", F.col("run").cast("int").alias("run"), "last.price", "last.time", "last.seq", "appended")


@query("stream_changed", f"""WITH a AS (SELECT *, CAST(time AS DATE) AS day, {_segment('time')} AS run FROM user_ticks), d AS (SELECT DISTINCT run, sym, day FROM a)
    SELECT d.run, d.sym, d.day, arg_max(price, (time, seq)) AS price, max(price) AS day_high, min(price) AS day_low, max(time) AS updated_at
    FROM d JOIN a t ON t.sym = d.sym AND t.day = d.day AND t.run <= d.run GROUP BY 1, 2, 3""", ("user_ticks",))
def stream_changed(spark, sf):
    """Coalesced emission: each run sends the latest quote of the keys it touched, and no other."""
    shape = (F.col("user_id").cast("string").alias("sym"), *_ticks()[1:])
    seen = []

    def step(root, log):
        quotes = live.quote_state(log, delay="20 days")
        live.drive(quotes, live.append_batches(f"{root}/{len(seen)}"), f"{root}/checkpoint", "update")
        seen.append(live.written(spark, f"{root}/{len(seen)}", quotes.schema).withColumn("run", F.lit(len(seen))))

    _in_segments(spark, sf, shape, step)
    out = seen[0].unionByName(seen[1]).unionByName(seen[2])
    return out.select("run", "sym", "day", "price", "day_high", "day_low", "updated_at")


_RENEWALS = """r AS (SELECT upper('s' || user_id) AS sym, ts AS at_, max(CASE WHEN event_type = 'view' THEN 7200.0 ELSE 86400.0 END) AS ttl FROM events GROUP BY 1, 2),
    x AS (SELECT sym, at_, at_ + to_microseconds(CAST(ttl * 1000000 AS BIGINT)) AS expired, lead(at_) OVER (PARTITION BY sym ORDER BY at_) AS nxt FROM r),
    m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '1 hour' AS w FROM events)"""


@query("stream_lease_expiry", f"""WITH {_RENEWALS} SELECT sym, at_ AS since, expired FROM x, m WHERE (nxt IS NOT NULL AND nxt >= expired) OR (nxt IS NULL AND expired <= w)""")
def stream_lease_expiry(spark, sf):
    shape = (F.concat(F.lit(" s"), "user_id").alias("sym"), F.col("ts").alias("at"), F.when(F.col("event_type") == "view", 7200).alias("ttl"))

    def step(root, log):
        with stateful.keyed_state(spark):
            step.out = live.drain(stateful.lease_expiries(log, 86400), "append", root=f"{root}/leases")

    _in_segments(spark, sf, shape, step)
    return step.out.drop("batch_id")


_FEED = "CASE event_type WHEN 'click' THEN 'forex' WHEN 'view' THEN 'crypto' ELSE 'us' END"


@query("stream_silences", f"""WITH r AS (SELECT DISTINCT {_FEED} AS feed, ts AS at_ FROM events),
    x AS (SELECT feed, at_, at_ + INTERVAL '300 seconds' AS silent, lead(at_) OVER (PARTITION BY feed ORDER BY at_) AS nxt FROM r),
    m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '1 hour' AS w FROM events),
    s AS (SELECT feed, at_ AS last_tick, silent, isodow(silent) - 1 AS d, hour(silent) * 60 + minute(silent) AS t FROM x, m WHERE (nxt IS NOT NULL AND nxt >= silent) OR (nxt IS NULL AND silent <= w))
    SELECT feed, last_tick, silent FROM s WHERE feed = 'crypto' OR (feed = 'us' AND d < 5 AND t >= 870 AND t < 1200)
      OR (feed = 'forex' AND (d <= 3 OR (d = 4 AND t < 1260) OR (d = 6 AND t >= 1320)))""")
def stream_silences(spark, sf):
    def step(root, log):
        with stateful.keyed_state(spark):
            step.out = live.drain(stateful.silences(log), "append", root=f"{root}/silences")

    _in_segments(spark, sf, (F.expr(_FEED).alias("feed"), F.col("ts").alias("time")), step)
    return step.out.drop("batch_id")


def _ewm(out, value, n):
    return f"{1 - 2 / (n + 1)!r} * p.{out} + {2 / (n + 1)!r} * {value}"


_GAIN, _LOSS = "greatest(b.close - p.close, 0)", "greatest(p.close - b.close, 0)"


@query("stream_indicators", f"""WITH RECURSIVE h AS (SELECT sym AS symbol, time_bucket(INTERVAL '1 hour', time) AS date, max(price) AS high, min(price) AS low,
      arg_max(price, (time, seq)) AS close FROM ticks GROUP BY 1, 2),
    b AS MATERIALIZED (SELECT *, row_number() OVER w AS rn, avg(close) OVER (w ROWS 19 PRECEDING) AS m, max(high) OVER (w ROWS 13 PRECEDING) AS hh, min(low) OVER (w ROWS 13 PRECEDING) AS ll,
      greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM h WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    r AS (SELECT symbol, date, rn, close, m, hh, ll, close AS f, close AS s, CAST(0 AS DOUBLE) AS g, tr AS a, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS down FROM b WHERE rn = 1
      UNION ALL SELECT b.symbol, b.date, b.rn, b.close, b.m, b.hh, b.ll, {_ewm('f', 'b.close', 12)}, {_ewm('s', 'b.close', 26)},
        0.8 * p.g + 0.2 * (({_ewm('f', 'b.close', 12)}) - ({_ewm('s', 'b.close', 26)})), {13 / 14!r} * p.a + {1 / 14!r} * b.tr,
        {13 / 14!r} * p.up + {1 / 14!r} * {_GAIN}, {13 / 14!r} * p.down + {1 / 14!r} * {_LOSS} FROM r p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1)
    SELECT symbol, date, close, CASE WHEN rn >= 20 THEN round(m, 4) END AS sma, CASE WHEN rn >= 14 THEN round(-100 * (hh - close) / nullif(hh - ll, 0), 4) END AS willr,
      round(f, 4) AS ema, round(f - s, 4) AS macd, round(g, 4) AS macd_signal, round(a, 4) AS atr, round(100 * up / nullif(up + down, 0), 4) AS rsi FROM r""", ("ticks",))
def stream_indicators(spark, sf):
    """Hourly bars and indicators carried over three runs; each run reads its own ticks and the state."""
    reqs = [ind.resolve("sma", period=20), ind.resolve("willr"), ind.resolve("ema", period=12), ind.resolve("macd"), ind.resolve("atr"), ind.resolve("rsi")]

    def step(root, log):
        with stateful.keyed_state(spark):
            step.out = live.drain(stateful.indicator_stream(log, reqs, "1h", "6 hours"), "update", root=f"{root}/push")

    _in_segments(spark, sf, _ticks(), step)
    out = topk.latest(step.out, ("symbol", "date"), (F.col("batch_id").desc(),))
    names = {c.split("|")[0]: c for r in reqs for c in r.columns()}
    return out.select("symbol", "date", "close", *[F.round(F.col(f"`{names[n]}`"), 4).alias(n) for n in ("sma", "willr", "ema", "macd", "macd_signal", "atr", "rsi")])
