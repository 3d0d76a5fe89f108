"""Bars from ticks, coarser bars, sessions."""

from pyspark.sql import functions as F

from marketloom import views
from marketloom.functions import classify
from marketloom.operators import bars, sessions
from marketloom.plans.registry import query

_OHLCV = """arg_min(price, (time, seq)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (time, seq)) AS close, sum(size) AS volume,
    round(sum(price * size) / nullif(sum(size), 0), 8) AS vwap"""


def _r(df, *names, digits=8):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("bars_1h", f"""SELECT sym, time_bucket(INTERVAL '1 hour', time) AS date, {_OHLCV}
    FROM ticks GROUP BY 1, 2""", ("ticks",))
def bars_1h(spark, sf):
    return _r(bars.from_ticks(views.ticks(spark, sf), "1h"), "vwap")


@query("bars_5m_user", f"""SELECT sym, time_bucket(INTERVAL '5 minutes', time) AS date, {_OHLCV}
    FROM user_ticks GROUP BY 1, 2""", ("user_ticks",))
def bars_5m_user(spark, sf):
    return _r(bars.from_ticks(views.ticks(spark, sf, "user_id"), "5m"), "vwap")


@query("bars_15s_count", f"""SELECT sym, time_bucket(INTERVAL '15 seconds', time) AS date, {_OHLCV},
    count(*) AS trades FROM ticks GROUP BY 1, 2""", ("ticks",))
def bars_15s_count(spark, sf):
    return _r(bars.from_ticks(views.ticks(spark, sf), "15s", count=True), "vwap")


# New York is on standard time through the whole of the given stream.
@query("session_filter", f"""SELECT sym, date_trunc('minute', time) AS date, {_OHLCV} FROM ticks
    WHERE CAST(time - INTERVAL '5 hours' AS TIME) >= TIME '09:30:00'
      AND CAST(time - INTERVAL '5 hours' AS TIME) < TIME '16:00:00' GROUP BY 1, 2""", ("ticks",))
def session_filter(spark, sf):
    return _r(bars.from_ticks(views.ticks(spark, sf), "1m", session="regular"), "vwap")


_MINUTE = f"""minute AS (SELECT sym AS symbol, date_trunc('minute', time) AS date,
    {_OHLCV.replace('round(', '(').replace(', 8)', ')')} FROM ticks GROUP BY 1, 2)"""


def _minute(spark, sf):
    return bars.from_ticks(views.ticks(spark, sf), "1m").withColumnRenamed("sym", "symbol")


@query("bars_1m_to_5m", f"""WITH {_MINUTE} SELECT symbol, time_bucket(INTERVAL '5 minutes', date) AS date,
    arg_min(open, m.date) AS open, max(high) AS high, min(low) AS low, arg_max(close, m.date) AS close,
    sum(volume) AS volume, round(coalesce(sum(vwap * volume), 0) / nullif(sum(volume), 0), 8) AS vwap
    FROM minute m GROUP BY symbol, time_bucket(INTERVAL '5 minutes', m.date)""", ("ticks",))
def bars_1m_to_5m(spark, sf):
    return _r(bars.coarsen(_minute(spark, sf), "5m"), "vwap")


@query("bars_daily_local", f"""WITH {_MINUTE} SELECT symbol,
    CAST(CAST(m.date - INTERVAL '5 hours' AS DATE) AS TIMESTAMP) AS date,
    arg_min(open, m.date) AS open, max(high) AS high, min(low) AS low, arg_max(close, m.date) AS close,
    sum(volume) AS volume, round(coalesce(sum(vwap * volume), 0) / nullif(sum(volume), 0), 8) AS vwap
    FROM minute m GROUP BY 1, 2""", ("ticks",))
def bars_daily_local(spark, sf):
    return _r(bars.daily_local(_minute(spark, sf)), "vwap")


def _coarse(label):
    return f"""SELECT symbol, {label} AS date, arg_min(open, d.date) AS open, max(high) AS high,
    min(low) AS low, arg_max(close, d.date) AS close, sum(volume) AS volume,
    round(sum(vwap * volume) / nullif(sum(volume), 0), 5) AS vwap FROM daily_bars d GROUP BY 1, 2"""


@query("bars_weekly", _coarse("CAST(date_trunc('week', d.date) + INTERVAL '6 days' AS TIMESTAMP)"), ("daily_bars",))
def bars_weekly(spark, sf):
    return _r(bars.coarsen(views.daily_bars(spark, sf), "1w"), "vwap", digits=5)


@query("bars_monthly", _coarse("CAST(last_day(d.date) AS TIMESTAMP)"), ("daily_bars",))
def bars_monthly(spark, sf):
    return _r(bars.coarsen(views.daily_bars(spark, sf), "1mo"), "vwap", digits=5)


@query("bars_quarters_from_first", """
    WITH f AS (SELECT symbol, last_day(min(date)) AS base FROM daily_bars GROUP BY 1),
    k AS (SELECT d.*, last_day(base + to_months(CAST(3 * ceil(date_diff('month', base, last_day(d.date)) / 3.0)
          AS INTEGER))) AS label FROM daily_bars d JOIN f USING (symbol))
    SELECT symbol, CAST(label AS TIMESTAMP) AS date, arg_min(open, k.date) AS open, max(high) AS high,
    min(low) AS low, arg_max(close, k.date) AS close, sum(volume) AS volume,
    round(sum(vwap * volume) / nullif(sum(volume), 0), 5) AS vwap FROM k GROUP BY 1, 2""", ("daily_bars",))
def bars_quarters_from_first(spark, sf):
    return _r(bars.coarsen(views.daily_bars(spark, sf), "3mo"), "vwap", digits=5)


@query("bars_two_weeks", """
    WITH f AS (SELECT symbol, CAST(date_trunc('week', min(date)) AS DATE) + 6 AS base FROM daily_bars GROUP BY 1),
    k AS (SELECT d.*, base + CAST(14 * ceil(date_diff('day', base, CAST(date_trunc('week', d.date) AS DATE) + 6)
          / 14.0) AS INTEGER) AS label FROM daily_bars d JOIN f USING (symbol))
    SELECT symbol, CAST(label AS TIMESTAMP) AS date, arg_min(open, k.date) AS open, max(high) AS high,
    min(low) AS low, arg_max(close, k.date) AS close, sum(volume) AS volume,
    round(sum(vwap * volume) / nullif(sum(volume), 0), 5) AS vwap FROM k GROUP BY 1, 2""", ("daily_bars",))
def bars_two_weeks(spark, sf):
    return _r(bars.coarsen(views.daily_bars(spark, sf), "2w"), "vwap", digits=5)


@query("bars_anchored", f"""
    WITH a AS (SELECT sym AS s, date_trunc('day', min(time)) AS a FROM ticks GROUP BY 1)
    SELECT sym, a + to_microseconds(CAST(floor(date_diff('microsecond', a, time) / 25200000000) * 25200000000 AS BIGINT))
    AS date, {_OHLCV} FROM ticks JOIN a ON s = sym GROUP BY 1, 2""", ("ticks",))
def bars_anchored(spark, sf):
    return _r(bars.anchored_ticks(views.ticks(spark, sf), "7h"), "vwap")


@query("bars_generic_resample", """SELECT sym AS symbol, CAST(last_day(time) AS TIMESTAMP) AS date,
    arg_min(price, (time, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (time, seq)) AS close,
    sum(size) AS volume, round(sum(price * size) / nullif(sum(size), 0), 5) AS vwap FROM user_ticks
    GROUP BY 1, 2""", ("user_ticks",))
def bars_generic_resample(spark, sf):
    src = views.ticks(spark, sf, "user_id").select(
        F.col("sym").alias("symbol"), F.col("time").alias("date"), F.col("price").alias("Last"),
        F.col("size").alias("Qty"), "seq")
    return _r(bars.resample(src, "month", tie="seq", vwap=True), "vwap", digits=5)


@query("bars_vwap_downsample", """SELECT symbol, CAST(date_trunc('month', p.date) + INTERVAL '1 month' - INTERVAL '1 day'
    AS TIMESTAMP) AS date, sum(volume) AS volume,
    round(coalesce(sum(vwap * volume), 0) / nullif(sum(volume), 0) + 1e-9, 7) AS vwap FROM part_bars p GROUP BY 1, 2""",
       ("part_bars",))
def bars_vwap_downsample(spark, sf):
    out = bars.resample(views.part_bars(spark, sf), "1mo", vwap=True)
    # The nudge keeps exact halves from rounding either way with the sum's order.
    return out.select("symbol", "date", "volume", F.round(F.col("vwap") + F.lit(1e-9), 7).alias("vwap"))


@query("bars_stats", """SELECT sym, max(time) AS last_time, arg_max(price, (time, seq)) AS last_price,
    count(*) AS ticks FROM user_ticks GROUP BY 1""", ("user_ticks",))
def bars_stats(spark, sf):
    return bars.stats(views.ticks(spark, sf, "user_id"))


@query("tick_span", "SELECT sym, min(time) AS first_time, max(time) AS last_time FROM user_ticks GROUP BY 1",
       ("user_ticks",))
def tick_span(spark, sf):
    return bars.span(views.ticks(spark, sf, "user_id"))


@query("symbols_distinct", "SELECT DISTINCT sym FROM user_ticks", ("user_ticks",))
def symbols_distinct(spark, sf):
    return views.ticks(spark, sf, "user_id").select("sym").distinct()


_CLOSES = """SELECT symbol, CAST(m.date - INTERVAL '5 hours' AS DATE) AS session_date, max(m.date) AS date,
    arg_min(open, m.date) AS open, max(high) AS high, min(low) AS low, arg_max(close, m.date) AS close,
    arg_max(adj_close, m.date) AS adj_close, sum(volume) AS volume FROM minute2 m GROUP BY 1, 2"""
_MINUTE2 = _MINUTE + f", minute2 AS (SELECT *, close * CAST({views.ADJUSTMENT} AS DOUBLE) AS adj_close FROM minute)"


@query("session_closes", f"WITH {_MINUTE2} {_CLOSES}", ("ticks",))
def session_closes(spark, sf):
    m = _minute(spark, sf).drop("vwap").withColumn("adj_close", F.col("close") * F.lit(views.ADJUSTMENT))
    return sessions.closes(m)


@query("running_session", f"""WITH {_MINUTE}, s AS (SELECT symbol, CAST(date - INTERVAL '5 hours' AS DATE) AS session_date,
    date FROM minute), l AS (SELECT symbol, max(session_date) AS session_date FROM s GROUP BY 1)
    SELECT symbol, session_date, min(date) AS first_bar FROM s JOIN l USING (symbol, session_date) GROUP BY 1, 2""",
       ("ticks",))
def running_session(spark, sf):
    return sessions.running_session(_minute(spark, sf))


@query("session_filter_bars", f"""WITH {_MINUTE}, named AS (SELECT CASE symbol WHEN 'click' THEN 'EURUSD'
    WHEN 'view' THEN 'BTC-USD' WHEN 'error' THEN 'TALA.TO' ELSE upper(symbol) END AS symbol, date, close FROM minute)
    SELECT symbol, date, close FROM named WHERE symbol IN ('EURUSD', 'BTC-USD', 'TALA.TO') OR
      (CAST(date - INTERVAL '5 hours' AS TIME) >= TIME '09:30:00'
       AND CAST(date - INTERVAL '5 hours' AS TIME) < TIME '16:00:00')""", ("ticks",))
def session_filter_bars(spark, sf):
    named = _minute(spark, sf).withColumn("symbol", F.expr(
        "CASE symbol WHEN 'click' THEN 'EURUSD' WHEN 'view' THEN 'BTC-USD' WHEN 'error' THEN 'TALA.TO' "
        "ELSE upper(symbol) END"))
    return sessions.regular_only(named, "1m").select("symbol", "date", "close")


@query("avwap_thinned", """
    WITH b AS (SELECT sym, time_bucket(INTERVAL '30 minutes', time) AS bucket, max(time) AS time,
      sum(price * size) AS pv, sum(size) AS vol FROM ticks WHERE time >= TIMESTAMP '2024-01-08 00:00:00' GROUP BY 1, 2)
    SELECT sym, bucket, time, round(sum(pv) OVER w / nullif(sum(vol) OVER w, 0), 8) AS avwap FROM b
    WINDOW w AS (PARTITION BY sym ORDER BY bucket ROWS UNBOUNDED PRECEDING)""", ("ticks",))
def avwap_thinned(spark, sf):
    return _r(bars.anchored_vwap(views.ticks(spark, sf), "2024-01-08T00:00:00Z", "30m"), "avwap")


_SHAPED = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'EURUSD' WHEN '2' THEN 'btc-usdt' WHEN '3' THEN 'BRK-B'
    WHEN '4' THEN 'tala.to' ELSE 'C' || o_custkey || '.us' END"""


def _symbols(spark, sf):
    return views.table(spark, sf, "orders").select(F.expr(_SHAPED).alias("symbol")).distinct()


@query("symbol_feeds", f"""WITH s AS (SELECT DISTINCT {_SHAPED} AS symbol FROM orders)
    SELECT symbol, CASE WHEN symbol = 'EURUSD' THEN 'forex' WHEN symbol = 'btc-usdt' THEN 'crypto'
    WHEN symbol = 'tala.to' THEN 'unsupported' ELSE 'us' END AS feed,
    CASE symbol WHEN 'EURUSD' THEN 'EURUSD.FOREX' WHEN 'btc-usdt' THEN 'BTC-USDT.CC' WHEN 'BRK-B' THEN 'BRK-B.US'
    ELSE upper(symbol) END AS ticker FROM s""")
def symbol_feeds(spark, sf):
    return _symbols(spark, sf).select("symbol", classify.feed_of(F.col("symbol")).alias("feed"),
                                      classify.snapshot_ticker(F.col("symbol")).alias("ticker"))


@query("watchlist_feeds", f"""WITH s AS (SELECT DISTINCT upper({_SHAPED}) AS symbol FROM orders)
    SELECT CASE WHEN symbol = 'EURUSD' THEN 'forex' WHEN symbol = 'BTC-USDT' THEN 'crypto'
    WHEN symbol = 'TALA.TO' THEN 'unsupported' ELSE 'us' END AS feed, symbol FROM s""")
def watchlist_feeds(spark, sf):
    return classify.watchlist_feeds(_symbols(spark, sf))
