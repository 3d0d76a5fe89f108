"""Bar comparison and load bookkeeping."""

from datetime import date

from pyspark.sql import functions as F

from marketloom import views
from marketloom.operators import etl, quality
from marketloom.plans.registry import query


def _theirs(spark, sf):
    """The bars another source would have: some prices moved, some stamps missing."""
    b = views.part_bars(spark, sf)
    return b.filter("volume > 5").withColumns({
        "close": F.col("close") + F.when(F.col("volume") > 40, 0.25).otherwise(0.005),
        "high": F.when(F.col("volume") > 48, F.lit(float("nan"))).otherwise(F.col("high"))})


_THEIRS = """t AS (SELECT symbol, date, open, CASE WHEN volume > 48 THEN 'NaN'::DOUBLE ELSE high END AS high, low,
    close + CASE WHEN volume > 40 THEN 0.25 ELSE 0.005 END AS close, volume FROM part_bars WHERE volume > 5)"""


@query("cmp_bars", f"""WITH {_THEIRS} SELECT o.symbol, o.date, 'close' AS field, round(o.close - t.close, 4) AS diff, TRUE AS finite,
      round((o.close - t.close) / t.close * 10000, 4) AS bps FROM part_bars o JOIN t USING (symbol, date) WHERE o.volume > 40
    UNION ALL SELECT o.symbol, o.date, 'high', NULL, FALSE, NULL FROM part_bars o WHERE o.volume > 48""", ("part_bars",))
def cmp_bars(spark, sf):
    out = quality.discrepancies(views.part_bars(spark, sf), _theirs(spark, sf))
    return out.select("symbol", "date", "field", F.when(F.col("finite"), F.round("diff", 4)).alias("diff"), "finite", F.round("bps", 4).alias("bps"))


@query("cmp_gaps", "SELECT symbol, date, 'ours_only' AS side FROM part_bars WHERE volume <= 5", ("part_bars",))
def cmp_gaps(spark, sf):
    return quality.coverage_gaps(views.part_bars(spark, sf), _theirs(spark, sf))


@query("cmp_summary", """SELECT symbol, count(*) AS compared, 0 AS open, 0 AS high, 0 AS low, count(*) FILTER (WHERE volume > 40) AS close, 0 AS volume,
    count(*) FILTER (WHERE volume > 48) AS non_finite FROM part_bars WHERE volume > 5 GROUP BY 1""", ("part_bars",))
def cmp_summary(spark, sf):
    return quality.summary(views.part_bars(spark, sf), _theirs(spark, sf)).drop("largest_close")


@query("cmp_finest", """WITH a AS (SELECT o_custkey AS symbol, unnest(['1m', '5m', '1h', '1d']) AS interval, unnest([1, 2, 3, 4]) AS place,
      unnest([count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 4e5), count(*) FILTER (WHERE o_totalprice > 4.5e5), count(*) FILTER (WHERE o_totalprice > 3e5), count(*)]) AS rows
      FROM orders GROUP BY 1)
    SELECT symbol, arg_min(interval, place) AS interval FROM a WHERE rows > 0 GROUP BY 1""")
def cmp_finest(spark, sf):
    o = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("symbol")).agg(
        F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 4e5)).alias("a"), F.count_if(F.col("o_totalprice") > 4.5e5).alias("b"),
        F.count_if(F.col("o_totalprice") > 3e5).alias("c"), F.count("*").alias("d"))
    pairs = F.array(*[F.struct(F.lit(i).alias("interval"), F.col(c).alias("rows")) for i, c in (("1m", "a"), ("5m", "b"), ("1h", "c"), ("1d", "d"))])
    return quality.finest(o.select("symbol", F.inline(pairs)))


@query("dedupe_ticks", "SELECT DISTINCT sym, time, seq FROM part_trades", ("part_trades",))
def dedupe_ticks(spark, sf):
    t = views.part_trades(spark, sf)
    return quality.dedupe(t.unionByName(t)).select("sym", "time", "seq")


@query("etl_settle_diff", """WITH k AS (SELECT DISTINCT sym, time, seq, price FROM part_trades)
    SELECT sym, count(*) FILTER (WHERE price > 4000) AS added, count(*) FILTER (WHERE price < 500) AS removed FROM k GROUP BY 1
    HAVING added > 0 OR removed > 0""", ("part_trades",))
def etl_settle_diff(spark, sf):
    t = views.part_trades(spark, sf)
    return quality.key_diff(t.filter("price <= 4000"), t.filter("price >= 500"), ["sym", "time", "seq", "price"], ["sym"])


@query("etl_counts_by_day", """SELECT sym AS symbol, CAST(time AS DATE) AS day, count(*) AS expected, count(*) FILTER (WHERE size > 3) AS stored,
    count(*) = count(*) FILTER (WHERE size > 3) AS ok FROM part_trades GROUP BY 1, 2""", ("part_trades",))
def etl_counts_by_day(spark, sf):
    t = views.part_trades(spark, sf).withColumnsRenamed({"sym": "symbol", "time": "date"})
    return quality.counts_by_day(t, t.filter("size > 3"))


def _daily(spark, sf):
    """Rows per symbol and day from ticks."""
    return (views.ticks(spark, sf, "user_id").groupBy(F.col("sym").alias("symbol"), F.to_date("time").alias("day"))
            .agg(F.count("*").alias("rows")))


def _members(spark, sf):
    d = views.ticks(spark, sf, "user_id")
    weeks = d.select(F.date_trunc("week", "time").cast("date").alias("week")).distinct()
    # Every symbol is a member of every week its first tick does not come after.
    first = d.groupBy(F.col("sym").alias("symbol")).agg(F.min("time").alias("f"))
    last = weeks.agg(F.max("week")).scalar()
    return first.select("symbol", F.explode(F.sequence(F.date_trunc("week", "f").cast("date"), last, F.expr("INTERVAL 7 DAYS"))).alias("week"))


@query("etl_week_finalise", """WITH d AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY 1, 2),
    f AS (SELECT symbol, CAST(date_trunc('week', min(day)) AS DATE) AS f FROM d GROUP BY 1), w AS (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week FROM d),
    m AS (SELECT symbol, week FROM f JOIN w ON week >= f),
    t AS (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week, day FROM d WHERE isodow(day) <= 5 AND CAST(date_trunc('week', day) AS DATE) + 5 <= DATE '2024-01-28'),
    s AS (SELECT m.symbol, m.week, t.day, d.rows FROM m JOIN t USING (week) LEFT JOIN d ON d.symbol = m.symbol AND d.day = t.day)
    SELECT symbol, week, CAST(coalesce(sum(rows), 0) AS BIGINT) AS rows, count(*) FILTER (WHERE rows IS NULL) AS missing,
      CASE WHEN count(*) FILTER (WHERE rows IS NULL) = 0 THEN 'done' ELSE 'failed' END AS status, week + 11 <= DATE '2024-01-28' AS settled FROM s GROUP BY 1, 2""")
def etl_week_finalise(spark, sf):
    out = etl.completion(_daily(spark, sf), _members(spark, sf), date(2024, 1, 28))
    return out.withColumn("missing", F.size("missing").cast("long"))


def _failures(spark, sf):
    return views.table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.date_trunc("week", "o_orderdate").cast("date").alias("week"),
                                                   F.when(F.col("o_orderstatus") == "P", "timeout").otherwise("unservable: 404").alias("error"))


@query("etl_blocklist", """SELECT o_custkey AS symbol, count(DISTINCT date_trunc('week', o_orderdate)) AS weeks, CAST(max(date_trunc('week', o_orderdate)) AS DATE) AS blocked_to
    FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING weeks >= 5""")
def etl_blocklist(spark, sf):
    return etl.blocklist(_failures(spark, sf))


@query("etl_blocked_daily", """WITH b AS (SELECT o_custkey AS symbol, count(DISTINCT date_trunc('week', o_orderdate)) AS weeks, CAST(max(date_trunc('week', o_orderdate)) AS DATE) AS blocked_to
    FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING weeks >= 5) SELECT * FROM b WHERE blocked_to >= DATE '2001-07-01' - 21""")
def etl_blocked_daily(spark, sf):
    return etl.blocked_daily(etl.blocklist(_failures(spark, sf)), date(2001, 7, 1))


def _attempts(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("week"), F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("attempt")).agg(
        F.max(F.when(F.col("o_orderstatus") == "O", 0).otherwise(5)).cast("long").alias("rows"),
        F.max(F.when(F.col("o_orderstatus") == "F", "boom")).alias("error"))


_STATE = """a AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_custkey AS symbol, o_orderkey AS attempt,
      CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'empty' ELSE 'done' END AS status FROM orders),
    s AS (SELECT week, symbol, arg_max(status, attempt) AS status, count(*) FILTER (WHERE status = 'failed') AS retries FROM a GROUP BY 1, 2)"""


def _state(spark, sf):
    a = _attempts(spark, sf)
    empty = a.limit(0).withColumn("status", F.lit(None).cast("string"))
    return etl.record(empty, a)


@query("etl_progress", f"WITH {_STATE} SELECT * FROM s")
def etl_progress(spark, sf):
    return _state(spark, sf).select("week", "symbol", "status", "retries")


@query("etl_pending", f"WITH {_STATE} SELECT week, symbol FROM s WHERE status = 'failed'")
def etl_pending(spark, sf):
    state = _state(spark, sf)
    return etl.pending(state.select("week", "symbol"), state)


@query("etl_retry_settle", f"""WITH {_STATE}, w AS (SELECT DISTINCT week, week + INTERVAL '3 days' AS started, week + INTERVAL '6 days' AS finished FROM s)
    SELECT week, week IN (SELECT week FROM s WHERE status = 'failed' AND retries < 2) AS retry_due, week + INTERVAL '14 days' <= TIMESTAMP '2000-01-10' AS settle_due FROM w""")
def etl_retry_settle(spark, sf):
    state = _state(spark, sf)
    weeks = state.select("week").distinct().withColumns({
        "started": F.date_add("week", 3).cast("timestamp"), "finished": F.date_add("week", 6).cast("timestamp"),
        "settled": F.lit(None).cast("timestamp"), "retried_at": F.lit(None).cast("timestamp")})
    now = F.lit("2000-01-10").cast("timestamp")
    retry = etl.retry_due(weeks, state, 2, now).select("week").withColumn("retry_due", F.lit(True))
    settle = etl.settle_due(weeks, 10, now).select("week").withColumn("settle_due", F.lit(True))
    return weeks.select("week").join(retry, "week", "left").join(settle, "week", "left").fillna(False)
