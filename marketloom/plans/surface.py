"""What a SQL user sees: previews, SQL over views, function spellings."""

from pyspark.sql import functions as F

from marketloom import views
from marketloom.functions import dialect, preview
from marketloom.functions import scalar as x
from marketloom.operators import ranks, series
from marketloom.plans.registry import query


def _orders(spark, sf):
    return views.table(spark, sf, "orders")


@query("sql_preview", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'P')
    AND o_orderpriority ILIKE '%not s%' AND o_custkey BETWEEN 100 AND 900 AND o_orderdate IS NOT NULL ORDER BY o_custkey DESC, o_orderkey LIMIT 500""")
def sql_preview(spark, sf):
    return preview.preview(
        _orders(spark, sf), ["o_orderkey", "o_custkey", "o_totalprice"],
        [{"field": "o_totalprice", "operator": "gte", "value": 100000}, {"field": "o_orderstatus", "operator": "in", "value": ["F", "P"]},
         {"field": "o_orderpriority", "operator": "contains", "value": "Not S"}, {"field": "o_custkey", "operator": "between", "value": [100, 900]},
         {"field": "o_orderdate", "operator": "not_null"}],
        [{"field": "o_custkey", "direction": "desc"}, {"field": "o_orderkey"}], 500)


@query("sql_preview_text", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'small%' AND p_brand <> 'Brand#2' AND p_size < 40")
def sql_preview_text(spark, sf):
    return preview.preview(views.table(spark, sf, "part"), ["p_partkey", "p_name"],
                           [{"field": "p_name", "operator": "starts_with", "value": "SMALL"}, {"field": "p_brand", "operator": "ne", "value": "Brand#2"},
                            {"field": "p_size", "operator": "lt", "value": 40}], [{"field": "p_partkey"}])


@query("tick_select", "SELECT count(*) AS n, min(time) AS first, max(time) AS last FROM (SELECT * FROM ticks WHERE sym = 'click' AND time >= TIMESTAMP '2024-01-10' AND time <= TIMESTAMP '2024-01-12')", ("ticks",))
def tick_select(spark, sf):
    out = preview.select_ticks(views.ticks(spark, sf), "click", "2024-01-10", "2024-01-12")
    return out.agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


def _same(name, duck, spark_sql, tables):
    """A query whose Spark text and DuckDB text say the same thing."""
    @query(name, duck)
    def run(spark, sf):
        dialect.register(spark)
        return spark.sql(spark_sql, **{t: views.table(spark, sf, t) for t in tables})


_same("sql_functions_string",
      """SELECT p_partkey, strpos(p_name, 'r') AS a, starts_with(p_name, 'red') AS b, suffix(p_name, 'et') AS c, regexp_matches(p_brand, '#1\\d') AS d,
      string_split(p_name, ' ')[1] AS e, strip_accents('é' || p_name) AS f, split_part(p_name, ' ', 2) AS g, lpad(p_brand, 12, '*') AS h, reverse(p_type) AS i,
      repeat(left(p_name, 2), 3) AS j, concat_ws('-', p_brand, p_type) AS k, replace(p_name, 'e', 'E') AS l, regexp_replace(p_brand, '#', '_') AS m,
      regexp_extract(p_brand, '(\\d+)', 1) AS n, contains(p_type, 'ECO') AS o, sha256(p_name) AS q, md5(p_name) AS r, upper(right(p_name, 3)) AS s, printf('%d:%s', p_size, p_brand) AS t FROM part""",
      """SELECT p_partkey, strpos(p_name, 'r') AS a, starts_with(p_name, 'red') AS b, suffix(p_name, 'et') AS c, regexp_matches(p_brand, '#1\\\\d') AS d,
      list_extract(string_split(p_name, ' '), 1) AS e, strip_accents('é' || p_name) AS f, split_part(p_name, ' ', 2) AS g, lpad(p_brand, 12, '*') AS h, reverse(p_type) AS i,
      repeat(left(p_name, 2), 3) AS j, concat_ws('-', p_brand, p_type) AS k, replace(p_name, 'e', 'E') AS l, regexp_replace(p_brand, '#', '_') AS m,
      regexp_extract(p_brand, '(\\\\d+)', 1) AS n, contains(p_type, 'ECO') AS o, sha256(p_name) AS q, md5(p_name) AS r, upper(right(p_name, 3)) AS s, format_string('%d:%s', p_size, p_brand) AS t FROM {part}""",
      ("part",))
_same("sql_functions_math",
      """SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_extendedprice), 6) AS a, round(log(l_quantity), 6) AS b, round(ln(l_quantity), 6) AS c, round(log2(l_quantity), 6) AS d,
      round(exp(l_discount), 6) AS e, CAST(floor(l_tax * 100) AS BIGINT) AS f, CAST(ceil(l_discount * 10) AS BIGINT) AS g, round(power(l_quantity, 2), 3) AS h, CAST(sign(l_discount - 0.05) AS DOUBLE) AS i,
      l_partkey % 7 AS j, CAST(l_partkey // 7 AS BIGINT) AS k, greatest(l_tax, l_discount) AS m, least(l_tax, l_discount) AS n, coalesce(nullif(l_linenumber, 1), 0) AS o, abs(-l_quantity) AS p FROM lineitem""",
      """SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_extendedprice), 6) AS a, round(log10(l_quantity), 6) AS b, round(ln(l_quantity), 6) AS c, round(log2(l_quantity), 6) AS d,
      round(exp(l_discount), 6) AS e, CAST(floor(l_tax * 100) AS BIGINT) AS f, CAST(ceil(l_discount * 10) AS BIGINT) AS g, round(power(l_quantity, 2), 3) AS h, sign(l_discount - 0.05D) AS i,
      l_partkey % 7 AS j, l_partkey div 7 AS k, greatest(l_tax, l_discount) AS m, least(l_tax, l_discount) AS n, coalesce(nullif(l_linenumber, 1), 0) AS o, abs(-l_quantity) AS p FROM {lineitem}""",
      ("lineitem",))
_same("sql_functions_date",
      """SELECT event_id, date_trunc('hour', ts) AS a, epoch_ms(ts) AS b, isodow(ts) AS c, dayofweek(ts) AS d, dayofyear(ts) AS e, quarter(ts) AS f, weekofyear(ts) AS g,
      strftime(ts, '%Y/%m/%d %H:%M') AS h, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS i, make_date(year(ts), month(ts), 1) AS j,
      ts + INTERVAL '90' MINUTE AS k, date_part('hour', ts) AS l, last_day(ts) AS m, strptime('2024-01-05 10:11', '%Y-%m-%d %H:%M') AS n FROM events""",
      f"""SELECT event_id, date_trunc('hour', ts) AS a, epoch_ms(ts) AS b, isodow(ts) AS c, dayofweek(ts) - 1 AS d, dayofyear(ts) AS e, quarter(ts) AS f, weekofyear(ts) AS g,
      date_format(ts, "{dialect.java_pattern('%Y/%m/%d %H:%M')}") AS h, timestampdiff(DAY, TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS i, make_date(year(ts), month(ts), 1) AS j,
      ts + INTERVAL '90' MINUTE AS k, date_part('hour', ts) AS l, last_day(ts) AS m, to_timestamp('2024-01-05 10:11', "{dialect.java_pattern('%Y-%m-%d %H:%M')}") AS n FROM {{events}}""",
      ("events",))
_same("sql_functions_nested",
      """SELECT event_id, json_extract_string(props, '$.k') AS a, json_valid(props) AS b, list_contains([event_type, 'x'], 'view') AS c, list_extract([event_type, 'z'], 2) AS d,
      struct_extract({'u': user_id, 't': event_type}, 't') AS e, TRY_CAST(event_type AS DOUBLE) AS f, len([1, 2, user_id]) AS g FROM events""",
      """SELECT event_id, json_extract_string(props, '$.k') AS a, json_valid(props) AS b, list_contains(array(event_type, 'x'), 'view') AS c, list_extract(array(event_type, 'z'), 2) AS d,
      named_struct('u', user_id, 't', event_type).t AS e, TRY_CAST(event_type AS DOUBLE) AS f, size(array(1, 2, user_id)) AS g FROM {events}""",
      ("events",))
_AGGREGATES = """SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS custs, round(avg(o_totalprice), 3) AS mean, 
      round(stddev(o_totalprice), 2) AS sd,
      round(var_pop(o_totalprice) / 1e6D, 2) AS vp, min_by(o_orderkey, o_totalprice) AS cheapest, max_by(o_orderkey, o_totalprice) AS dearest, bool_and(o_totalprice > 0) AS every,
      bool_or(o_orderstatus = 'F') AS any_f, array_join(array_sort(collect_set(o_orderstatus)), ',') AS statuses, array_sort(collect_set(o_orderstatus)) AS status_list FROM {orders} GROUP BY 1"""


@query("sql_functions_aggregate",
      """SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS custs, round(avg(o_totalprice), 3) AS mean, median(o_totalprice) AS med,
      round(quantile_cont(o_totalprice, 0.9), 4) AS q90, quantile_disc(o_totalprice, 0.25) AS q25, round(stddev(o_totalprice), 2) AS sd, round(var_pop(o_totalprice) / 1e6, 2) AS vp,
      arg_min(o_orderkey, o_totalprice) AS cheapest, arg_max(o_orderkey, o_totalprice) AS dearest, bool_and(o_totalprice > 0) AS every, bool_or(o_orderstatus = 'F') AS any_f,
      string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, list_sort(list(DISTINCT o_orderstatus)) AS status_list FROM orders GROUP BY 1""")
def sql_functions_aggregate(spark, sf):
    """Aggregates by SQL; the quantiles by rank selection, which holds no group in one task."""
    o = _orders(spark, sf)
    exact = ranks.exact_quantiles(o, ["o_orderpriority"], "o_totalprice", {"med": (0.5, "cont"), "q90": (0.9, "cont"), "q25": (0.25, "disc")})
    dialect.register(spark)
    return series.beside(spark.sql(_AGGREGATES, orders=o), exact.withColumn("q90", F.round("q90", 4)), ["o_orderpriority"])


@query("quantiles_exact", """SELECT event_type, user_id % 7 AS part, quantile_disc(value, 0.1) AS q10, round(quantile_cont(value, 0.5), 9) AS med, round(quantile_cont(value, 0.995), 9) AS q995,
      min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2""")
def quantiles_exact(spark, sf):
    e = views.table(spark, sf, "events").select("event_type", (F.col("user_id") % 7).alias("part"), "value")
    out = ranks.exact_quantiles(e, ["event_type", "part"], "value", {"q10": (0.1, "disc"), "med": (0.5, "cont"), "q995": (0.995, "cont"), "low": (0.0, "disc"), "high": (1.0, "disc")})
    return out.withColumns({c: F.round(c, 9) for c in ("med", "q995")})


@query("sketch_rollup", """WITH o AS (SELECT user_id % 5 AS part, value, user_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY user_id % 5) AS n
      FROM events WHERE value > 0)
    SELECT part, max(n) AS n, max(value) FILTER (WHERE r = floor(0.5 * (n - 1))) AS med, max(value) FILTER (WHERE r = floor(0.9 * (n - 1))) AS q90, count(DISTINCT user_id) AS members, TRUE AS within
    FROM o GROUP BY 1""")
def sketch_rollup(spark, sf):
    """Quantiles and distinct users out of day sketches, beside the exact ones: within one in a hundred, or three standard errors."""
    e = views.table(spark, sf, "events").select((F.col("user_id") % 5).alias("part"), "ts", "value", "user_id")
    rolled = ranks.roll_up(ranks.day_sketches(e, ["part"], F.to_date("ts"), "value", "user_id"), ["part"], {"_med": 0.5, "_q90": 0.9})
    above = e.where("value > 0")
    n = above.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("members"))
    ranked = ranks.exact_quantiles(above, ["part"], "value", {"med": (0.5, "low"), "q90": (0.9, "low")})
    exact = ranked.join(n, "part")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.01 * F.col(b) + 1e-12
    close = F.abs(F.col("_members") - F.col("members")) <= F.greatest(F.lit(1.0), 3 * 1.04 / 128 * F.col("members"))
    both = exact.join(rolled.withColumnsRenamed({"n": "_n", "members": "_members"}), "part")
    return both.select("part", "n", "med", "q90", "members", (near("_med", "med") & near("_q90", "q90") & close & (F.col("_n") == F.col("n"))).alias("within"))


_WINDOW = """SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, ntile(4) OVER u AS nt,
    lag(o_totalprice) OVER u AS lg, lead(o_totalprice, 2) OVER u AS ld, first_value(o_totalprice) OVER u AS fv, nth_value(o_totalprice, 2) OVER f AS nv, row_number() OVER u AS rn
    FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus), u AS (PARTITION BY o_custkey ORDER BY o_orderkey),
    f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
_same("sql_functions_window", _WINDOW.format(orders="orders"), _WINDOW, ("orders",))
_CUBE = """SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus) AS gs, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)"""
_same("sql_grouping_sets", _CUBE.format(orders="orders"), _CUBE, ("orders",))
_SETS = """(SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O')
    EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 450000"""
_same("sql_set_operations", _SETS.format(orders="orders"), _SETS, ("orders",))
_RECURSIVE = """WITH RECURSIVE m(y) AS (SELECT date_trunc('year', min(o_orderdate)) FROM {orders} UNION ALL
    SELECT y + INTERVAL '1' YEAR FROM m WHERE y < (SELECT date_trunc('year', max(o_orderdate)) FROM {orders}))
    SELECT y, count(o_orderkey) AS n FROM m LEFT JOIN {orders} ON date_trunc('year', o_orderdate) = y GROUP BY 1"""
# Seven years would be seven tasks: the orders are counted before they are joined.
_COUNTED = _RECURSIVE.replace("SELECT y, count(o_orderkey) AS n FROM m LEFT JOIN {orders} ON date_trunc('year', o_orderdate) = y GROUP BY 1",
                              """SELECT y, coalesce(sum(c), 0) AS n FROM m LEFT JOIN
      (SELECT date_trunc('year', o_orderdate) AS o, count(o_orderkey) AS c FROM {orders} GROUP BY 1) ON o = y GROUP BY 1""")
_same("sql_recursive_years", _RECURSIVE.format(orders="orders"), _COUNTED, ("orders",))


@query("column_cleaning", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS num, CAST(floor(o_totalprice) AS BIGINT) AS whole,
    round(o_totalprice / 100, 6) AS pct, CASE o_orderpriority WHEN '1-URGENT' THEN 'DEU' WHEN '2-HIGH' THEN 'GBR' ELSE upper(o_orderpriority) END AS country,
    'total_price_usd' AS snake FROM orders""")
def column_cleaning(spark, sf):
    o = _orders(spark, sf)
    raw = F.when(F.col("o_orderstatus") == "F", F.lit("NA")).otherwise(F.col("o_totalprice").cast("string"))
    place = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'Germany' WHEN '2-HIGH' THEN ' uk ' ELSE o_orderpriority END")
    return o.select("o_orderkey", x.number(raw).alias("num"), x.whole(F.col("o_totalprice")).alias("whole"),
                    F.round(x.percent(F.col("o_totalprice")), 6).alias("pct"), x.country(place).alias("country"), x.snake(F.lit("totalPriceUsd")).alias("snake"))


@query("time_text", """SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(date_part('millisecond', ts) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso,
    event_type <> 'view' AS zoned FROM events""")
def time_text(spark, sf):
    e = views.table(spark, sf, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_type") == "view", "").otherwise("+02:00"))
    return e.select("event_id", x.iso_ms(F.unix_millis("ts")).alias("iso"), x.names_zone(text).alias("zoned"))


@query("content_fingerprint", """SELECT o_orderkey, left(sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'), 24) AS fingerprint FROM orders""")
def content_fingerprint(spark, sf):
    from marketloom.operators.promotion import fingerprint
    return _orders(spark, sf).select("o_orderkey", fingerprint("o_orderkey", "o_orderstatus").alias("fingerprint"))
