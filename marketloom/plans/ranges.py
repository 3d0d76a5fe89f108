"""Range algebra over tick coverage."""

from pyspark.sql import functions as F

from marketloom import views
from marketloom.functions import intervals
from marketloom.operators import ranges
from marketloom.plans.registry import query

_DAYS = "days AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS sym, CAST(ts AS DATE) AS d FROM events)"


def covered_days(spark, sf):
    t = views.ticks(spark, sf, "user_id")
    return (t.select("sym", F.date_trunc("day", "time").alias("s")).distinct().withColumn("e", F.col("s")))


def asked(spark, sf, start="2023-12-30", end="2024-02-02"):
    users = views.ticks(spark, sf, "user_id").select("sym").distinct()
    return users.select(F.col("sym").alias("request"), "sym", F.lit(start).cast("timestamp").alias("start"),
                        F.lit(end).cast("timestamp").alias("end"))


# Equal ranges are one range: rows alike in `s` and `e` would have no order between the two windows.
@query("range_coalesce", """WITH r AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS sym, date_trunc('hour', ts) AS s,
      date_trunc('hour', ts) + INTERVAL '5 hours' AS e FROM events),
    p AS (SELECT *, max(e) OVER (PARTITION BY sym ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - INTERVAL '1 hour' > reach THEN 1 ELSE 0 END)
      OVER (PARTITION BY sym ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM p)
    SELECT sym, min(s) AS s, max(e) AS e FROM i GROUP BY sym, n""")
def range_coalesce(spark, sf):
    hour = F.date_trunc("hour", "time")
    r = views.ticks(spark, sf, "user_id").select("sym", hour.alias("s"), (hour + F.expr("INTERVAL 5 HOURS")).alias("e"))
    return ranges.coalesce(r, "1h")


# The twin walks single days, so it shares nothing with the hole arithmetic.
_ABSENT = f"""{_DAYS}, asked AS (SELECT DISTINCT sym, unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02',
      INTERVAL 1 DAY))::DATE AS d FROM days),
    absent AS (SELECT sym, d, d - CAST(row_number() OVER (PARTITION BY sym ORDER BY d) AS INTEGER) AS g
      FROM asked ANTI JOIN days USING (sym, d)),
    gaps AS (SELECT sym, CAST(min(d) AS TIMESTAMP) AS s, CAST(max(d) AS TIMESTAMP) AS e FROM absent GROUP BY sym, g)"""


@query("range_subtract", f"WITH {_ABSENT} SELECT sym AS request, sym, s, e FROM gaps")
def range_subtract(spark, sf):
    return ranges.subtract(asked(spark, sf), covered_days(spark, sf), "1d").select("request", "sym", "s", "e")


@query("range_trim", f"""WITH {_DAYS} SELECT sym, CAST(d AS TIMESTAMP) AS s,
      least(CAST(d AS TIMESTAMP) + INTERVAL '3 days', TIMESTAMP '2024-01-14 00:00:00') AS e FROM days
    WHERE d <= DATE '2024-01-14'""")
def range_trim(spark, sf):
    r = covered_days(spark, sf).withColumn("e", F.col("e") + F.expr("INTERVAL 3 DAYS"))
    now = F.lit("2024-01-15 15:00:00").cast("timestamp")
    return ranges.trim_tail(r, intervals.last_complete("1d", now))


@query("missing_weekdays", f"""WITH {_ABSENT}, o AS (SELECT sym, CAST(s AS DATE) AS s0, CAST(e AS DATE) AS e FROM gaps),
    m AS (SELECT sym, s0 + CASE isodow(s0) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS s, e FROM o)
    SELECT sym AS request, sym AS listing_id, s, e FROM m WHERE s <= e""")
def missing_weekdays(spark, sf):
    req = asked(spark, sf).select("request", F.col("sym").alias("listing_id"), F.to_date("start").alias("start"),
                                  F.to_date("end").alias("end"))
    held = covered_days(spark, sf).select(F.col("sym").alias("listing_id"), F.to_date("s").alias("day"))
    return ranges.missing_weekdays(req, held)


@query("missing_span", f"""WITH {_ABSENT}, o AS (SELECT sym, CAST(s AS DATE) AS s0, CAST(e AS DATE) AS e FROM gaps),
    m AS (SELECT sym, s0 + CASE isodow(s0) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS s, e FROM o)
    SELECT sym AS listing_id, min(s) AS "start", max(e) AS "end" FROM m WHERE s <= e GROUP BY 1""")
def missing_span(spark, sf):
    return ranges.request_span(missing_weekdays(spark, sf))


_TRIMMED = _ABSENT.replace("FROM asked ANTI JOIN days USING (sym, d)",
                           "FROM asked ANTI JOIN (SELECT * FROM days WHERE d <= DATE '2024-01-24') k USING (sym, d)")


@query("gap_plan", f"""WITH {_TRIMMED}, f AS (SELECT sym, CAST(min(d) AS TIMESTAMP) AS fl FROM days WHERE d <= DATE '2024-01-24' GROUP BY 1),
    l AS (SELECT sym, max(s) AS last FROM gaps GROUP BY 1),
    c AS (SELECT g.sym, s, e, coalesce(s = last AND greatest(fl, s - INTERVAL '3 days') < s AND fl IS NOT NULL, FALSE) AS compare, fl
      FROM gaps g JOIN l USING (sym) LEFT JOIN f USING (sym))
    SELECT sym AS request, sym, s AS gap_start, e AS gap_end,
      CASE WHEN compare THEN greatest(fl, s - INTERVAL '3 days') ELSE s END AS fetch_start,
      CASE WHEN compare THEN greatest(fl, s - INTERVAL '3 days') ELSE s END AS wire_start, e AS wire_end, compare FROM c""")
def gap_plan(spark, sf):
    return ranges.plan(asked(spark, sf), covered_days(spark, sf), "1d", F.lit("2024-01-25 11:00:00").cast("timestamp"))


@query("coverage_status", f"""WITH {_DAYS}, want AS (SELECT DISTINCT sym, unnest([DATE '2024-01-08', DATE '2024-01-09', DATE '2024-01-10']) AS d FROM days),
    runs AS (SELECT w.sym, w.d, w.d - CAST(row_number() OVER (PARTITION BY w.sym ORDER BY w.d) AS INTEGER) AS g
      FROM want w ANTI JOIN days USING (sym, d)),
    n AS (SELECT sym, count(DISTINCT g) AS gaps FROM runs GROUP BY 1)
    SELECT sym AS request, sym, coalesce(gaps, 0) AS gaps, CASE WHEN gaps IS NULL THEN 'hit' ELSE 'partial' END AS status
    FROM (SELECT DISTINCT sym FROM days) LEFT JOIN n USING (sym)""")
def coverage_status(spark, sf):
    req = asked(spark, sf, "2024-01-08", "2024-01-10")
    return ranges.coverage_status(req, covered_days(spark, sf), "1d", F.lit("2024-03-01").cast("timestamp"))


@query("revised_history", """SELECT symbol, bool_or(abs(a.adj_close - b.adj_close) > 1e-6) AS revised FROM part_bars a
    JOIN (SELECT sym AS symbol, time AS date, arg_max(price, (seq, part, price, size)) * CAST(0.98512347 AS DOUBLE) *
          CASE WHEN max(size) >= 50 AND min(price) < 100 THEN 0.5 ELSE 1 END AS adj_close
          FROM part_trades GROUP BY 1, 2) b USING (symbol, date) GROUP BY 1""", ("part_bars",))
def revised_history(spark, sf):
    old = views.part_bars(spark, sf)
    flag = (views.part_trades(spark, sf).groupBy(F.col("sym").alias("symbol"), F.col("time").alias("date"))
            .agg(((F.max("size") >= 50) & (F.min("price") < 100)).alias("split")))
    fresh = old.join(flag, ["symbol", "date"]).withColumn(
        "adj_close", F.col("adj_close") * F.when(F.col("split"), 0.5).otherwise(1.0)).drop("split")
    return ranges.revised_history(old, fresh, ("symbol",), "date")


@query("served_rows", """WITH s AS (SELECT symbol, date FROM daily_bars), f AS (SELECT symbol, date FROM daily_bars WHERE volume >= 2)
    SELECT symbol, count(*) FILTER (WHERE f.date IS NULL) AS from_cache, count(*) FILTER (WHERE f.date IS NOT NULL) AS from_upstream
    FROM s LEFT JOIN f USING (symbol, date) GROUP BY 1""", ("daily_bars",))
def served_rows(spark, sf):
    d = views.daily_bars(spark, sf)
    return ranges.served_rows(d, d.filter("volume >= 2"), ("symbol",), "date")


@query("upsert_bars", """SELECT o_orderpriority AS sym, o_orderdate AS t, o_totalprice AS close, o_orderkey AS write_seq FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey DESC) = 1""")
def upsert_bars(spark, sf):
    w = views.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("sym"), F.col("o_orderdate").alias("t"),
        F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("write_seq"), "o_orderstatus")
    return ranges.upsert(w.filter("o_orderstatus <> 'P'"), w.filter("o_orderstatus = 'P'"), ("sym", "t")).drop("o_orderstatus")


@query("seam_boundaries", """SELECT sym, time_bucket(INTERVAL '15 minutes', min(time) - INTERVAL '1 microsecond') + INTERVAL '15 minutes' AS seam
    FROM user_ticks GROUP BY 1""", ("user_ticks",))
def seam_boundaries(spark, sf):
    from marketloom.operators.asof import seam
    t = views.ticks(spark, sf, "user_id").groupBy("sym").agg(F.min("time").alias("f"))
    return t.select("sym", seam(F.col("f"), "15m").alias("seam"))


@query("last_complete_bars", """SELECT o_orderkey, date_trunc('month', o_orderdate) - INTERVAL '1 month' AS mo,
    date_trunc('week', o_orderdate) - INTERVAL '7 days' AS w, CAST(o_orderdate - INTERVAL '1 day' AS TIMESTAMP) AS d FROM orders""")
def last_complete_bars(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.select("o_orderkey", *[intervals.last_complete(i, F.col("o_orderdate")).alias(n)
                                    for i, n in (("1mo", "mo"), ("1w", "w"), ("1d", "d"))])
