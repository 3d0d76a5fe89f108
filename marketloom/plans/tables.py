"""Versioned tables and file sources, written to the shared folder and read back."""

from datetime import datetime

from pyspark.sql import functions as F

from marketloom import views
from marketloom.plans.registry import query
from marketloom.session import scratch_path
from marketloom.sources import daytable as dt
from marketloom.sources import schema as sc
from marketloom.sources import store as st
from marketloom.sources import ticks as tk

_T = [datetime(2024, 2, d) for d in (1, 2, 3, 4)]


def _rows(spark, sf):
    return views.ticks(spark, sf).select(F.col("sym").alias("symbol"), F.col("time").alias("date"), "price", "size", "seq")


def _store(spark, sf):
    """Four commits: early rows, the rest, corrected prices on days from the 20th, one symbol dropped."""
    rows = _rows(spark, sf)
    s = st.Store(spark, scratch_path(spark, "store"), "ticks")
    mid = F.lit("2024-01-15").cast("timestamp")
    s.overwrite(rows.filter(F.col("date") < mid), {"source": "first"}, _T[0])
    s.append(rows.filter(F.col("date") >= mid), None, _T[1])
    fixed = rows.filter((F.col("date") >= F.lit("2024-01-20").cast("timestamp")) & (F.col("symbol") != "view"))
    s.replace_days(fixed.withColumn("price", F.col("price") * 2), {"source": "fix"}, _T[2])
    s.delete(["error"], _T[3])
    return s


def _plain(spark, sf):
    """The same rows in a plain table: all days, then corrected prices over the days from the 20th."""
    rows = _rows(spark, sf).filter("symbol <> 'error'")
    table = dt.DayTable(spark, scratch_path(spark, "days"), rows.schema)
    table.write(rows)
    fixed = rows.filter((F.col("date") >= F.lit("2024-01-20").cast("timestamp")) & (F.col("symbol") != "view"))
    table.write(fixed.withColumn("price", F.col("price") * 2))
    return table


_V1 = "SELECT sym AS symbol, time AS date, price, size, seq FROM ticks"
_V2 = """SELECT sym AS symbol, time AS date, CASE WHEN time >= TIMESTAMP '2024-01-20' AND sym <> 'view' THEN price * 2 ELSE price END AS price, size, seq FROM ticks"""


@query("store_asof_version", f"{_V1} WHERE time < TIMESTAMP '2024-01-15'", ("ticks",))
def store_asof_version(spark, sf):
    return _store(spark, sf).read(version=0)


@query("store_asof_time", _V1, ("ticks",))
def store_asof_time(spark, sf):
    return _store(spark, sf).read(as_of=_T[1])


@query("store_replace_days", f"{_V2} WHERE sym <> 'error'", ("ticks",))
def store_replace_days(spark, sf):
    return _store(spark, sf).read()


@query("store_range_columns", f"""SELECT symbol, date, price FROM ({_V2}) WHERE symbol IN ('click', 'view') AND date >= TIMESTAMP '2024-01-18'
    AND date < TIMESTAMP '2024-01-23'""", ("ticks",))
def store_range_columns(spark, sf):
    return _plain(spark, sf).read(["click", "view"], "2024-01-18", "2024-01-22", ["price"])


@query("store_history", """WITH n AS (SELECT sym, count(*) FILTER (WHERE time < TIMESTAMP '2024-01-15') AS a, count(*) FILTER (WHERE time >= TIMESTAMP '2024-01-15') AS b,
      count(*) FILTER (WHERE time >= TIMESTAMP '2024-01-20') AS c FROM ticks GROUP BY 1)
    SELECT sym AS symbol, 0 AS version, TIMESTAMP '2024-02-01' AS ts, 'overwrite' AS op, a AS rows FROM n UNION ALL
    SELECT sym, 1, TIMESTAMP '2024-02-02', 'append', b FROM n UNION ALL SELECT sym, 2, TIMESTAMP '2024-02-03', 'replace_days', c FROM n WHERE sym <> 'view'
    UNION ALL SELECT 'error', 3, TIMESTAMP '2024-02-04', 'delete', 0""", ("ticks",))
def store_history(spark, sf):
    return _store(spark, sf).history()


@query("store_describe", """SELECT sym AS symbol, count(*) AS rows, min(time) AS min_date, max(time) AS max_date, count(DISTINCT CAST(time AS DATE)) AS days
    FROM ticks WHERE sym <> 'error' GROUP BY 1""", ("ticks",))
def store_describe(spark, sf):
    return _store(spark, sf).describe().select("symbol", "rows", "min_date", "max_date", "days")


@query("store_symbols", "SELECT DISTINCT sym AS symbol FROM ticks WHERE sym <> 'error'", ("ticks",))
def store_symbols(spark, sf):
    return _store(spark, sf).symbols()


@query("store_metadata", """SELECT DISTINCT sym AS symbol, CASE WHEN sym = 'view' THEN 'first' ELSE 'fix' END AS source FROM ticks""", ("ticks",))
def store_metadata(spark, sf):
    return _store(spark, sf).metadata().select("symbol", F.col("meta.source").alias("source"))


@query("trailing_rows", f"""SELECT * FROM ({_V2}) WHERE symbol <> 'error' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 300""", ("ticks",))
def trailing_rows(spark, sf):
    return _plain(spark, sf).trailing(300)


@query("store_newest_day", f"""SELECT * FROM ({_V2}) v WHERE symbol <> 'error' QUALIFY CAST(date AS DATE) = max(CAST(date AS DATE)) OVER (PARTITION BY symbol)""", ("ticks",))
def store_newest_day(spark, sf):
    return _plain(spark, sf).newest_period()


@query("store_version_diff", """WITH n AS (SELECT sym AS symbol, count(*) FILTER (WHERE time < TIMESTAMP '2024-01-15') AS a, count(*) AS c,
      count(*) FILTER (WHERE time >= TIMESTAMP '2024-01-15') AS b FROM ticks GROUP BY 1)
    SELECT symbol, a AS left_rows, c AS right_rows, b AS committed FROM n""", ("ticks",))
def store_version_diff(spark, sf):
    return st.version_diff(_store(spark, sf), 0, 1)


@query("store_manifest", """SELECT DISTINCT sym AS symbol, CASE sym WHEN 'click' THEN 1 WHEN 'view' THEN 1 ELSE 2 END AS version FROM ticks WHERE sym IN ('click', 'view', 'signup')""", ("ticks",))
def store_manifest(spark, sf):
    return st.manifest(_store(spark, sf), ["click", "view", "signup"], {"click": 1})


@query("store_flush_day", "SELECT sym AS symbol, count(*) AS rows FROM ticks WHERE CAST(time AS DATE) = DATE '2024-01-17' GROUP BY 1", ("ticks",))
def store_flush_day(spark, sf):
    ticks = views.ticks(spark, sf)
    schema = ticks.withColumnsRenamed({"sym": "symbol", "time": "date"}).schema
    return dt.flush_day(dt.DayTable(spark, scratch_path(spark, "flush"), schema), ticks, "2024-01-17")


@query("load_and_verify", """SELECT symbol, count(*) AS offered, count(*) AS stored, count(DISTINCT date_trunc('month', date)) AS resampled, 'PASS' AS status
    FROM daily_bars GROUP BY 1""", ("daily_bars",))
def load_and_verify(spark, sf):
    bars = views.daily_bars(spark, sf)
    return dt.load_and_verify(dt.DayTable(spark, scratch_path(spark, "load"), bars.schema, "year"), bars, "1mo")


@query("day_tables", """WITH k AS (SELECT DISTINCT event_type || strftime(ts, '_%Y_%m_%d') AS key, event_type AS base, CAST(ts AS DATE) AS day FROM events)
    SELECT key, base, day FROM k WHERE base <> 'view' QUALIFY row_number() OVER (PARTITION BY base ORDER BY day DESC) = 1
    UNION ALL SELECT 'view', 'view', NULL UNION ALL SELECT 'odd_2024_13_40', 'odd_2024_13_40', NULL""")
def day_tables(spark, sf):
    e = views.table(spark, sf, "events")
    keys = e.select(F.concat("event_type", F.date_format("ts", "_yyyy_MM_dd")).alias("key")).distinct()
    extra = spark.createDataFrame([("view",), ("odd_2024_13_40",)], "key string")
    return st.day_tables(keys.unionByName(extra))


@query("src_tick_files", """SELECT upper(event_type) AS symbol, ts AS time, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume,
    'N' AS exchange, '' AS conditions FROM events""")
def src_tick_files(spark, sf):
    path = scratch_path(spark, "files")
    local = F.date_format(F.from_utc_timestamp("ts", tk.ZONE), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = F.concat_ws(",", local, F.col("value"), F.get_json_object("props", "$.k"), F.lit("N"), F.lit(""))
    (views.table(spark, sf, "events").select(text.alias("value"), F.concat("event_type", F.lit("_trades_2024-01")).alias("f"))
     .write.partitionBy("f").text(path))
    return tk.trades(tk.sound_files(tk.read(spark, path))).drop("file")


@query("src_reference_bars", """WITH d AS (SELECT *, make_date(year(date), 4, 1) AS a, make_date(year(date), 10, 31) AS o FROM daily_bars)
    SELECT symbol, date + CASE WHEN date > a + INTERVAL 1 DAY * ((7 - dayofweek(a)) % 7) AND date <= o - INTERVAL 1 DAY * dayofweek(o)
      THEN INTERVAL '4 hours' ELSE INTERVAL '5 hours' END AS date, open, high, low, close, volume FROM d""", ("daily_bars",))
def src_reference_bars(spark, sf):
    raw = views.daily_bars(spark, sf).select(
        "symbol", F.col("date").alias("Datetime"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    names = {c.title(): c for c in ("open", "high", "low", "close", "volume")}
    return tk.reference_bars(raw, {**names, "Datetime": "date"}, tk.ZONE, "Datetime")


@query("schema_enforced", """SELECT CAST(o_orderkey AS VARCHAR) AS issuer_id, CAST(o_orderdate AS DATE) AS period_end, o_totalprice AS value, CAST(NULL AS VARCHAR) AS unit FROM orders""")
def schema_enforced(spark, sf):
    from pyspark.sql import types as T
    want = T.StructType.fromDDL("issuer_id string, period_end date, value double, unit string")
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("issuer_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period_end"),
                                                F.col("o_totalprice").alias("value"))
    return sc.enforce(o, want)


@query("schema_conformed", """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM orders""")
def schema_conformed(spark, sf):
    from pyspark.sql import types as T
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").cast("double").alias("o_orderkey"), "o_custkey", "o_totalprice")
    # Whole doubles fit the stored integers; prices do not and stay as they came.
    out, lossy = sc.conform(o, T.StructType.fromDDL("o_orderkey bigint, o_custkey double, o_totalprice bigint"))
    assert lossy == ["o_totalprice"]
    return out


@query("seed_append", """SELECT o_orderkey AS assertion_id, o_orderdate AS system_from FROM orders o WHERE o_orderstatus <> 'F'""")
def seed_append(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("assertion_id"), F.col("o_orderdate").alias("system_from"), "o_orderstatus")
    return sc.seed(o.filter("o_orderstatus = 'F'"), o).drop("o_orderstatus")
