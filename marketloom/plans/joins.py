"""As-of joins, stitching, studies, newest rows."""

from pyspark.sql import functions as F

from marketloom import views
from marketloom.operators import asof, bars, sessions, studies, topk
from marketloom.operators import indicators as ind
from marketloom.plans.registry import query
from marketloom.plans.technical import _recursive, _roll  # noqa: F401


@query("asof_trade", """WITH q AS (SELECT event_id AS request, CAST(user_id AS VARCHAR) AS sym, ts - INTERVAL '1 hour' AS time FROM events)
    SELECT q.request, q.sym, q.time, t.time AS fact_time, t.price, t.size, t.seq
    FROM q ASOF LEFT JOIN user_ticks t ON q.sym = t.sym AND q.time >= t.time""", ("user_ticks",))
def asof_trade(spark, sf):
    ticks = views.ticks(spark, sf, "user_id")
    asked = ticks.select(F.col("seq").alias("request"), "sym", (F.col("time") - F.expr("INTERVAL 1 HOUR")).alias("time"))
    return asof.backward(asked, ticks).select("request", "sym", "time", "fact_time", "price", "size", "seq")


@query("asof_daily_close", """WITH q AS (SELECT o_orderkey AS request, o_orderpriority AS symbol, o_orderdate + INTERVAL '12 hours'
      AS date FROM orders)
    SELECT q.request, q.symbol, q.date, d.date AS fact_time, d.close FROM q ASOF LEFT JOIN daily_bars d
      ON q.symbol = d.symbol AND q.date >= d.date""", ("daily_bars",))
def asof_daily_close(spark, sf):
    asked = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request"), F.col("o_orderpriority").alias("symbol"),
        (F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")).alias("date"))
    facts = views.daily_bars(spark, sf).select("symbol", "date", "close")
    return asof.backward(asked, facts, ("symbol",), "date", None).select("request", "symbol", "date", "fact_time", "close")


@query("stitch", """
    WITH h AS (SELECT sym AS symbol, time_bucket(INTERVAL '1 hour', time) AS date, avg(price) AS close, 'history' AS source
      FROM ticks GROUP BY 1, 2),
    live AS (SELECT event_type AS sym, ts AS time, value AS price, event_id AS seq FROM events WHERE ts >= TIMESTAMP '2024-01-20 10:20:00'),
    e AS (SELECT sym, time_bucket(INTERVAL '1 hour', min(time) - INTERVAL '1 microsecond') + INTERVAL '1 hour' AS seam FROM live GROUP BY 1),
    l AS (SELECT sym AS symbol, time_bucket(INTERVAL '1 hour', time) AS date, arg_max(price, (time, seq)) AS close, 'ticks' AS source
      FROM live JOIN e USING (sym) WHERE time_bucket(INTERVAL '1 hour', time) >= seam GROUP BY 1, 2)
    SELECT symbol, date, round(close + 1e-9, 6) AS close, source FROM h JOIN e ON e.sym = h.symbol WHERE date < seam
    UNION ALL SELECT symbol, date, round(close + 1e-9, 6), source FROM l""", ("ticks",))
def stitch(spark, sf):
    ticks = views.ticks(spark, sf)
    history = (ticks.groupBy(F.col("sym").alias("symbol"), F.date_trunc("hour", "time").alias("date"))
               .agg(F.avg("price").alias("close")))
    live = ticks.filter(F.col("time") >= F.lit("2024-01-20 10:20:00").cast("timestamp"))
    out = asof.stitch(history, live, "1h")
    return out.select("symbol", "date", F.round(F.col("close") + F.lit(1e-9), 6).alias("close"), "source")


@query("trailing_year_sum", """WITH paid AS (SELECT o_orderpriority AS symbol, o_orderdate AS date, sum(o_totalprice) / 99991.0 AS amount
      FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2),
    u AS (SELECT symbol, date, close, 0.0 AS amount, 1 AS bar FROM daily_bars
          UNION ALL SELECT symbol, date, NULL, amount, 0 FROM paid),
    s AS (SELECT *, sum(amount) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)
          AS tot FROM u)
    SELECT symbol, date, round(tot / close, 4) AS trailing_yield FROM s WHERE bar = 1""", ("daily_bars",))
def trailing_year_sum(spark, sf):
    paid = (views.table(spark, sf, "orders").filter("o_orderstatus = 'P'")
            .groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("date"))
            .agg((F.sum("o_totalprice") / F.lit(99991.0)).alias("amount")))
    out = asof.trailing_sum(views.daily_bars(spark, sf), paid, 365)
    return out.select("symbol", "date", F.round(F.col("trailing") / F.col("close"), 4).alias("trailing_yield"))


_TENURES = """SELECT CAST(o_custkey AS VARCHAR) AS code, CAST(min(o_orderdate) AS DATE) AS "start",
    CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN CAST(max(o_orderdate) AS DATE) END AS "end"
    FROM orders GROUP BY 1"""


def tenures(spark, sf):
    """Membership spans from customers' first and last order; some are still open."""
    return (views.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("code"))
            .agg(F.to_date(F.min("o_orderdate")).alias("start"),
                 F.when(F.count_if(F.col("o_orderstatus") == "O") > 0, F.to_date(F.max("o_orderdate"))).alias("end")))


def _weeks(spark, sf):
    return (views.table(spark, sf, "orders")
            .select(F.date_trunc("week", "o_orderdate").cast("date").alias("monday")).distinct())


@query("tenure_overlap", f"""WITH t AS ({_TENURES}),
    w AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders)
    SELECT code, monday, "start", "end", "start" <= monday AND ("end" IS NULL OR "end" - 14 >= monday + 4) AS in_tenure
    FROM t JOIN w ON "start" <= monday + 4 AND ("end" IS NULL OR "end" >= monday)""")
def tenure_overlap(spark, sf):
    return asof.tenure_weeks(tenures(spark, sf), _weeks(spark, sf))


_RSI = """WITH RECURSIVE l AS (SELECT *, lag(adj_close) OVER (PARTITION BY symbol ORDER BY date) AS a1,
      row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM daily_bars),
    b AS MATERIALIZED (SELECT *, CASE WHEN adj_close > a1 THEN adj_close - a1 ELSE 0.0 END AS g,
      CASE WHEN adj_close < a1 THEN a1 - adj_close ELSE 0.0 END AS l FROM l),
    r AS (SELECT symbol, date, rn, CAST(0 AS DOUBLE) AS ag, CAST(0 AS DOUBLE) AS al FROM b WHERE rn = 1
      UNION ALL SELECT b.symbol, b.date, b.rn, p.ag * 13 / 14 + b.g / 14, p.al * 13 / 14 + b.l / 14
      FROM r p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1)"""


@query("studies", f"""{_RSI}, x AS (SELECT symbol, max(rn) AS n FROM r GROUP BY 1),
    a AS (SELECT d.symbol, CASE WHEN d.symbol = '1-URGENT' THEN TIMESTAMP '1999-01-01' ELSE TIMESTAMP '1997-06-02' END AS anchor,
      d.date, vwap, volume, close FROM daily_bars d),
    v AS (SELECT symbol, anchor, sum(vwap * volume) FILTER (WHERE date >= anchor) / sum(volume) FILTER (WHERE date >= anchor) AS av,
      arg_max(close, date) AS price FROM a GROUP BY 1, 2)
    SELECT symbol, round(100 * ag / nullif(ag + al, 0), 4) AS rsi, round(av, 4) AS avwap,
      round((price - av) / av, 6) AS avwap_dev, anchor AS vwap_start
    FROM r JOIN x USING (symbol) JOIN v USING (symbol) WHERE rn = n""", ("daily_bars",))
def studies_rows(spark, sf):
    anchors = spark.createDataFrame([("1-URGENT", "1999-01-01")], "symbol string, anchor string").withColumn(
        "anchor", F.col("anchor").cast("timestamp"))
    out = studies.studies(views.daily_bars(spark, sf), anchors, "1997-06-02")
    return out.select("symbol", F.round("rsi", 4).alias("rsi"), F.round("avwap", 4).alias("avwap"),
                      F.round("avwap_dev", 6).alias("avwap_dev"), "vwap_start")


@query("business_day_windows", f"""WITH m AS (SELECT sym AS symbol, time_bucket(INTERVAL '1 hour', time) AS date,
      arg_max(price, (time, seq)) AS close FROM ticks GROUP BY 1, 2),
    k AS (SELECT *, CAST(date - INTERVAL '5 hours' AS DATE) AS d FROM m),
    s AS (SELECT symbol, d, arg_max(close, date) AS adj_close FROM k GROUP BY 1, 2),
    t AS (SELECT symbol, d, CASE WHEN count(*) OVER w = 5 THEN avg(adj_close) OVER w END AS v FROM s
      WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 4 PRECEDING))
    SELECT symbol, date, round(v + 1e-9, 6) AS sma_5bd FROM k JOIN t USING (symbol, d)""", ("ticks",))
def business_day_windows(spark, sf):
    m = bars.from_ticks(views.ticks(spark, sf), "1h").withColumnRenamed("sym", "symbol").withColumn("adj_close", F.col("close"))
    req = ind.resolve("sma", period=5, units={"period": "bd"})
    out = sessions.business_days(m, [req], "1h")
    return out.select("symbol", "date", F.round(F.col(f"`{req.columns()[0]}`") + F.lit(1e-9), 6).alias("sma_5bd"))


@query("vendor_series", f"""WITH s AS (SELECT symbol, date, {_roll('avg', 'adj_close', 50)} AS sma FROM daily_bars),
    v AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) / 997.0 AS sma FROM orders
      WHERE o_orderstatus = 'F' GROUP BY 1, 2)
    SELECT s.symbol, date, round(coalesce(v.sma, s.sma), 4) AS sma,
      CASE WHEN v.sma IS NULL THEN 'local' ELSE 'vendor' END AS sma_source
    FROM s LEFT JOIN v ON v.symbol = s.symbol AND v.d = CAST(date AS DATE)""", ("daily_bars",))
def vendor_series(spark, sf):
    vendor = (views.table(spark, sf, "orders").filter("o_orderstatus = 'F'")
              .groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("date"))
              .agg((F.max("o_totalprice") / F.lit(views.PRICE_SCALE)).alias("sma")))
    out = studies.with_vendor(views.daily_bars(spark, sf), ind.resolve("sma"), vendor, {"sma": "sma"})
    return out.select("symbol", "date", F.round("sma", 4).alias("sma"), "sma_source")


@query("plot_displacement", """WITH n AS (SELECT symbol, date, row_number() OVER w - 1 AS p, lead(date, 26) OVER w AS nxt,
      date - lag(date) OVER w AS gap FROM daily_bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    e AS (SELECT symbol, max(p) AS p1, max(date) AS d1, min(gap) AS gap1 FROM n GROUP BY 1)
    SELECT symbol, date, coalesce(nxt, d1 + gap1 * (p + 26 - p1)) AS plot_at FROM n JOIN e USING (symbol)""", ("daily_bars",))
def plot_displacement(spark, sf):
    return studies.displace(views.daily_bars(spark, sf).select("symbol", "date"), 26)


@query("plot_rows", """WITH s AS (SELECT symbol, date AS time, close, volume FROM daily_bars)
    SELECT symbol, time, 'price' AS pane, 'close' AS "column", round(close, 6) AS value FROM s
    UNION ALL SELECT symbol, time, 'volume', 'volume', volume FROM s""", ("daily_bars",))
def plot_rows(spark, sf):
    out = studies.plot_rows(views.daily_bars(spark, sf), {"price": ["close"], "volume": ["volume"]})
    return out.withColumn("value", F.round("value", 6))


@query("revised_rows", """WITH sent AS (SELECT symbol, date FROM daily_bars WHERE date < TIMESTAMP '2000-01-01' AND
      NOT (symbol = '5-LOW' AND date = TIMESTAMP '1996-02-05')),
    l AS (SELECT symbol, max(date) AS last FROM sent GROUP BY 1)
    SELECT d.symbol, d.date, round(d.close, 6) AS close FROM daily_bars d LEFT JOIN l USING (symbol)
    WHERE d.date >= l.last OR (d.symbol = '5-LOW' AND EXISTS (SELECT 1 FROM daily_bars x WHERE x.symbol = '5-LOW'
      AND x.date = TIMESTAMP '1996-02-05')) OR l.last IS NULL""", ("daily_bars",))
def revised_rows(spark, sf):
    d = views.daily_bars(spark, sf)
    hole = (F.col("symbol") == "5-LOW") & (F.col("date") == F.lit("1996-02-05").cast("timestamp"))
    sent = d.filter((F.col("date") < F.lit("2000-01-01").cast("timestamp")) & ~hole)
    return studies.revised(d, sent).select("symbol", "date", F.round("close", 6).alias("close"))


@query("latest_tick", """SELECT sym, time, price, size, seq FROM user_ticks
    QUALIFY row_number() OVER (PARTITION BY sym ORDER BY time DESC, seq DESC) = 1""", ("user_ticks",))
def latest_tick(spark, sf):
    return topk.latest_tick(views.ticks(spark, sf, "user_id"))


@query("newest_n_ticks", """SELECT sym, time, price, size, seq,
    row_number() OVER (PARTITION BY sym ORDER BY time DESC, seq DESC) AS rank FROM ticks QUALIFY rank <= 500""", ("ticks",))
def newest_n_ticks(spark, sf):
    return topk.newest(views.ticks(spark, sf), 500)


@query("latest_per_key", """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(spark, sf):
    out = topk.latest(views.table(spark, sf, "orders"), ("o_custkey",),
                      (F.col("o_orderdate").desc(), F.col("o_orderkey").desc()))
    return out.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("capped_rows", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 250 AS truncated FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 250""")
def capped_rows(spark, sf):
    o = views.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return topk.capped(o, 250, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("paged_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100 OFFSET 300")
def paged_rows(spark, sf):
    o = views.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return topk.page(o, [F.col("o_custkey"), F.col("o_orderkey")], 300, 100)


@query("universe_order", """WITH m AS (SELECT c_name AS code, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS cap FROM customer)
    SELECT row_number() OVER (ORDER BY cap IS NULL, cap DESC, code) AS place, code, cap FROM m""")
def universe_order(spark, sf):
    m = views.table(spark, sf, "customer").select(
        F.col("c_name").alias("code"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("cap"))
    return topk.universe_order(m)
