"""Landing, receipts, relation detail, dates and due days, whole provider maps, clock-change files."""

from datetime import date

from pyspark.sql import functions as F

from marketloom import views
from marketloom.functions import requests as rq
from marketloom.functions import scalar as x
from marketloom.operators import etl, identity, promotion, quality, shaping, studies, temporal, topk
from marketloom.operators import indicators as ind
from marketloom.operators.temporal import parse_context
from marketloom.plans.bitemporal import _EFF, _RESOLVE, K, KNOWN, _asked, _seen
from marketloom.plans.registry import query
from marketloom.plans.shaping import _MACRO, _SYM, _body, _macro, lines
from marketloom.plans.silver import frame, silver, twin
from marketloom.session import scratch_path
from marketloom.sources import external
from marketloom.sources import schema as sc
from marketloom.sources import ticks as tk


# --- landing, receipts, relations ------------------------------------------------------------


@query("bt_landed", """SELECT doc_id, text AS payload, sha256(text) AS content_hash, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL""")
def bt_landed(spark, sf):
    """Captured bodies, whole, whatever their length."""
    out = promotion.land(views.table(spark, sf, "documents").select("doc_id", F.col("text").alias("payload")))
    return out.withColumn("bytes", F.col("bytes").cast("long"))


_HOLIDAY = "CASE event_type WHEN 'view' THEN 'Official' WHEN 'click' THEN 'Half_Day' WHEN 'signup' THEN 'late_open' WHEN 'error' THEN 'Religious' END"


@query("bt_normalize_holidays", f"""WITH o AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1),
    e AS (SELECT *, CASE lower(coalesce({_HOLIDAY}, 'official')) WHEN 'half_day' THEN 'early_close' WHEN 'late_open' THEN 'late_open' ELSE 'closed' END AS effect
      FROM events JOIN o USING (user_id))
    SELECT 'cal_' || user_id AS calendar_id, CAST(ts AS DATE) AS session_date, 'market_session' AS assertion_domain, 'gregorian' AS calendar_system,
      'estimated' AS evidence_status, 'calendar_package' AS authority_type, 'Day ' || event_id AS holiday_name, effect AS market_effect,
      effect = 'late_open' AS special_open, effect = 'early_close' AS special_close, 'cap' || user_id AS source_version, date_trunc('day', ts) AS effective_from,
      CAST(NULL AS TIMESTAMP) AS effective_to, seen AS observed_at, seen AS available_at, seen AS system_from, CAST(NULL AS TIMESTAMP) AS system_to,
      'cap' || user_id AS capture_id, 'as_cal_cal_' || user_id || '_' || CAST(ts AS DATE) || '_cap' || user_id AS assertion_id, 'current' AS assertion_status,
      CAST(NULL AS VARCHAR) AS supersedes_assertion_id FROM e WHERE value >= 5""")
def bt_normalize_holidays(spark, sf):
    """A landed body of holidays per calendar; entries without a readable date are left out."""
    e = views.table(spark, sf, "events")
    day = F.when(F.col("value") < 5, F.lit("soon")).otherwise(F.to_date("ts").cast("string"))
    entry = F.struct(day.alias("Date"), F.concat(F.lit("Day "), "event_id").alias("Holiday"), F.expr(_HOLIDAY).alias("Type"))
    bodies = e.groupBy("user_id").agg(F.max("ts").alias("observed_at"), F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), entry))).alias("m"))
    landed = bodies.select(F.concat(F.lit("cal_"), "user_id").alias("calendar_id"), F.concat(F.lit("cap"), "user_id").alias("capture_id"), "observed_at",
                           F.to_json(F.struct(F.struct(F.col("m").alias("ExchangeHolidays")).alias("results"))).alias("payload"))
    return promotion.exchange_holidays(landed)


@query("bt_normalize_shares", """WITH c AS (SELECT *, make_date(1996, CAST(1 + c_custkey % 12 AS INT), 15) AS d FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT 'iss_' || c_custkey AS issuer_id, 'shares_outstanding' AS fact, CASE WHEN c_custkey % 3 = 2 THEN DATE '2002-03-04' ELSE d END AS period_end, c_acctbal AS value, 'shares' AS unit,
      CASE WHEN c_custkey % 2 = 0 THEN '10-Q' ELSE 'provider' END AS filing_kind, TIMESTAMP '2002-03-04 05:06:07' AS system_from,
      'as_so_iss_' || c_custkey || '_' || CASE WHEN c_custkey % 3 = 2 THEN DATE '2002-03-04' ELSE d END || '_cap' || c_custkey AS assertion_id FROM c""")
def bt_normalize_shares(spark, sf):
    """Facts by period end, else by date, else by the day they were seen; values that are no number are left out."""
    c = views.table(spark, sf, "customer")
    day = F.date_format(F.make_date(F.lit(1996), (1 + F.col("c_custkey") % 12).cast("int"), F.lit(15)), "yyyy-MM-dd")
    part = F.col("c_custkey") % 3
    item = F.struct(F.when(F.col("c_mktsegment") == "BUILDING", F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("shares_outstanding"),
                    F.when(part == 0, day).when(part == 1, F.lit("")).alias("period_end"), F.when(part != 2, day).alias("date"),
                    F.when(F.col("c_custkey") % 2 == 0, F.lit("10-Q")).otherwise(F.lit("")).alias("filing_kind"))
    landed = c.select(F.concat(F.lit("iss_"), "c_custkey").alias("issuer_id"), F.concat(F.lit("cap"), "c_custkey").alias("capture_id"),
                      F.lit("2002-03-04 05:06:07").cast("timestamp").alias("observed_at"), F.to_json(F.struct(F.array(item).alias("results"))).alias("payload"))
    return promotion.shares_outstanding(landed).select("issuer_id", "fact", "period_end", "value", "unit", "filing_kind", "system_from", "assertion_id")


@query("bt_receipts", f"""WITH {twin('listings', 'prices_normalized')}, m AS (SELECT 'listings' AS relation, count(DISTINCT system_from) AS version FROM listings UNION ALL
      SELECT 'prices_normalized', count(DISTINCT system_from) FROM prices_normalized)
    SELECT 'query' AS kind, 'r1' AS request_id, 'f1' AS fingerprint, relation, version, 'known_at' AS mode, CAST(NULL AS TIMESTAMP) AS effective_at, TIMESTAMP '{K}' AS known_at FROM m""")
def bt_receipts(spark, sf):
    """What an answer was read from: a relation's version is the number of instants at which it changed."""
    names = ("listings", "prices_normalized")
    manifest = None
    for name in names:
        one = frame(spark, sf, name).agg(F.lit(name).alias("symbol"), F.count_distinct("system_from").alias("version"))
        manifest = one if manifest is None else manifest.unionByName(one)
    return identity.receipt("query", parse_context(KNOWN), manifest, "r1", "f1").drop("at")


_DETAIL = ("listing_id", "symbol", "mic", "effective_from", "assertion_id", "issuer_name", "cusip")
_DTYPES = ("string", "string", "string", "timestamp", "string", "string", "string")


@query("bt_relation_detail", f"""WITH {twin('listings')}, n AS (SELECT count(*) AS rows FROM {_seen('listings')})
    SELECT 'gold.security_master' AS relation, 'gold' AS layer, 'view' AS kind, 'current_corrected,effective_on,known_at' AS modes, rows, d.place, d.column_ AS "column", d.dtype, d.is_key FROM n,
    (VALUES {', '.join(f"({i}, '{c}', '{t}', {c == 'listing_id'})" for i, (c, t) in enumerate(zip(_DETAIL, _DTYPES, strict=True), 1))}) AS d(place, column_, dtype, is_key)
    UNION ALL SELECT 'silver.identifiers', 'silver', 'table', '', (SELECT count(*) FROM customer) * 4 - (SELECT count(*) FROM customer WHERE c_acctbal >= 0), d.place, d.column_, d.dtype, d.is_key FROM
    (VALUES (1, 'identifier_type', 'string', TRUE), (2, 'identifier', 'string', TRUE), (3, 'listing_id', 'string', FALSE)) AS d(place, column_, dtype, is_key)""")
def bt_relation_detail(spark, sf):
    """Schema, keys, modes and exact row count of a view and of a table."""
    master = temporal.gold("security_master", silver(spark, sf, "listings", "issuers", "securities"), parse_context())
    master = master.select("listing_id", "symbol", "mic", "effective_from", "assertion_id", F.col("issuer_name") if "issuer_name" in master.columns else F.lit("").alias("issuer_name"), "cusip")
    one = identity.relation_detail(master, "gold.security_master", "gold", "view", ("listing_id",), identity.MODELS["ReferenceSecurity"]["modes"])
    table = frame(spark, sf, "identifiers").select("identifier_type", "identifier", "listing_id")
    return one.unionByName(identity.relation_detail(table, "silver.identifiers", "silver", "table", ("identifier_type", "identifier"), ()))


@query("projection_resolve", """SELECT c_mktsegment AS asked, 'lst_' || c_custkey AS listing_id, 'sec_' || c_custkey AS security_id, 'isin' AS identifier_type, 'resolved' AS status
    FROM customer WHERE c_mktsegment = 'BUILDING'""")
def projection_resolve(spark, sf):
    """The sixth parameterised read: everything an identifier of a given type stands for."""
    out = identity.project(spark, "ReferenceResolve", {"identifier": "BUILDING", "identifier_type": "isin"}, silver(spark, sf, *_RESOLVE),
                           parse_context({"mode": "effective_on", "effective_at": "1999-01-01T00:00:00Z"}))
    return out.select("asked", "listing_id", "security_id", "identifier_type", "status")


_CMP = ("close", "open", "high", "low", "volume", "price_basis", "effective_from")


@query("bt_compare_all", f"""WITH {twin('prices_normalized')},
    l AS (SELECT * FROM {_seen('prices_normalized', 'known')} QUALIFY row_number() OVER (PARTITION BY listing_id, market_date ORDER BY effective_from DESC, system_from DESC, assertion_id DESC) = 1),
    r AS (SELECT * FROM {_seen('prices_normalized')} QUALIFY row_number() OVER (PARTITION BY listing_id, market_date ORDER BY effective_from DESC, system_from DESC, assertion_id DESC) = 1),
    j AS (SELECT coalesce(l.listing_id, r.listing_id) AS listing_id, CAST(coalesce(l.market_date, r.market_date) AS VARCHAR) AS market_date, l.assertion_id AS la, r.assertion_id AS ra,
      r.supersedes_assertion_id AS sup, l.available_at AS lt, r.available_at AS rt,
      unnest(['listing_id', 'market_date', {', '.join(f"'{c}'" for c in _CMP)}]) AS field,
      unnest([CAST(l.listing_id AS VARCHAR), CAST(l.market_date AS VARCHAR), {', '.join(f'CAST(l.{c} AS VARCHAR)' for c in _CMP)}]) AS lv,
      unnest([CAST(r.listing_id AS VARCHAR), CAST(r.market_date AS VARCHAR), {', '.join(f'CAST(r.{c} AS VARCHAR)' for c in _CMP)}]) AS rv
      FROM l FULL JOIN r ON l.listing_id = r.listing_id AND l.market_date = r.market_date)
    SELECT listing_id, market_date, field, CASE WHEN field IN ('close', 'open', 'high', 'low', 'volume') THEN CAST(CAST(round(CAST(lv AS DOUBLE) * 100) AS BIGINT) AS VARCHAR) ELSE lv END AS "left",
      CASE WHEN field IN ('close', 'open', 'high', 'low', 'volume') THEN CAST(CAST(round(CAST(rv AS DOUBLE) * 100) AS BIGINT) AS VARCHAR) ELSE rv END AS "right",
      CASE WHEN field = 'listing_id' AND lv IS NOT NULL AND rv IS NOT NULL THEN 'identity_successor' WHEN lv IS NULL THEN 'newly_known' WHEN rv IS NULL THEN 'expired' WHEN sup = la THEN 'corrected'
        WHEN la IS DISTINCT FROM ra THEN CASE WHEN lt IS DISTINCT FROM rt THEN 'corrected' ELSE 'superseded' END ELSE 'became_effective' END AS classification
    FROM j WHERE lv IS DISTINCT FROM rv""")
def bt_compare_all(spark, sf):
    """Every field of the selection under two contexts."""
    s = silver(spark, sf, "prices_normalized")
    a, b = parse_context(KNOWN), parse_context()
    keep = ("listing_id", "market_date", *_CMP, "assertion_id", "available_at", "system_from", "supersedes_assertion_id")
    out = identity.compare(temporal.assertions(s["prices_normalized"], a).select(*keep), temporal.assertions(s["prices_normalized"], b).select(*keep), ("listing_id", "market_date"), a, b)
    cents = lambda c: F.when(F.col("field").isin("close", "open", "high", "low", "volume"), F.round(F.col(c).try_cast("double") * 100).cast("long").cast("string")).otherwise(F.col(c))
    return out.withColumns({c: cents(c) for c in ("left", "right")})


# --- dates, due days, windows ----------------------------------------------------------------


@query("daily_labels", "SELECT sym AS symbol, date_trunc('day', time) AS date, price AS close FROM ticks", ("ticks",))
def daily_labels(spark, sf):
    return quality.daily_labels(views.ticks(spark, sf).select(F.col("sym").alias("symbol"), F.col("time").alias("date"), F.col("price").alias("close")))


@query("etl_newest_week", """SELECT event_id, CAST(date_trunc('week', ts) AS DATE) - CASE WHEN isodow(ts) < 6 OR (isodow(ts) = 6 AND hour(ts) < 8) THEN 7 ELSE 0 END AS week FROM events""")
def etl_newest_week(spark, sf):
    return views.table(spark, sf, "events").select("event_id", etl.newest_complete_week(F.col("ts")).alias("week"))


@query("etl_days_due", """WITH p AS (SELECT ts - INTERVAL '5 hours' AS l FROM events), f AS (SELECT CAST(ts - INTERVAL '5 hours' AS DATE) AS d FROM events GROUP BY 1 HAVING count(*) > 330)
    SELECT DISTINCT CAST(l AS DATE) AS day FROM p WHERE hour(l) * 60 + minute(l) >= 125 AND isodow(l) BETWEEN 2 AND 6 AND CAST(l AS DATE) NOT IN (SELECT d FROM f)""")
def etl_days_due(spark, sf):
    e = views.table(spark, sf, "events")
    done = e.groupBy(F.to_date(F.from_utc_timestamp("ts", "America/New_York")).alias("day")).agg(F.count("*").alias("n")).filter("n > 330")
    return etl.days_due(e.select(F.col("ts").alias("now")), done)


_YEAR = rq.default_window(None, None, date(1998, 8, 2))


@query("default_window_bars", f"SELECT symbol, count(*) AS bars, min(date) AS first, max(date) AS last FROM daily_bars WHERE date BETWEEN DATE '{_YEAR[0]}' AND DATE '{_YEAR[1]}' GROUP BY 1".replace(
    str(_YEAR[0]), "1997-08-02").replace(str(_YEAR[1]), "1998-08-02"), ("daily_bars",))
def default_window_bars(spark, sf):
    """A request without bounds means the year to today."""
    start, end = rq.default_window(None, None, date(1998, 8, 2))
    d = views.daily_bars(spark, sf).filter(F.col("date").between(F.lit(start), F.lit(end)))
    return d.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("date").alias("first"), F.max("date").alias("last"))


_ANCHORS = "1-urgent=1998-06-01, 3-MEDIUM=bad ,2-HIGH=1998-07-15,1998-05-04"


@query("studies_anchored", """WITH b AS (SELECT *, CASE symbol WHEN '1-URGENT' THEN TIMESTAMP '1998-06-01' WHEN '2-HIGH' THEN TIMESTAMP '1998-07-15' ELSE TIMESTAMP '1998-05-04' END AS a FROM daily_bars
      WHERE date >= least(TIMESTAMP '1998-05-04', TIMESTAMP '1998-06-23') AND date < TIMESTAMP '1998-08-02'),
    v AS (SELECT symbol, a AS vwap_start, sum(vwap * volume) FILTER (WHERE date >= a AND volume > 0) AS pv, sum(volume) FILTER (WHERE date >= a) AS vol, arg_max(close, date) AS price FROM b GROUP BY 1, 2)
    SELECT symbol, round(pv / vol, 4) AS avwap, round((price - pv / vol) / (pv / vol), 6) AS avwap_dev, vwap_start FROM v""", ("daily_bars",))
def studies_anchored(spark, sf):
    """Anchors as text, a default among them, and the window that the bars are fetched from."""
    default, own = rq.parse_anchors(_ANCHORS, "1998-01-01")
    begin = rq.study_window_start(default, date(1998, 8, 2))
    bars = views.daily_bars(spark, sf).filter((F.col("date") >= F.lit(begin).cast("timestamp")) & (F.col("date") < F.lit("1998-08-02").cast("timestamp")))
    anchors = spark.createDataFrame(list(own.items()), "symbol string, anchor string").withColumn("anchor", F.col("anchor").cast("timestamp"))
    return studies.studies(bars, anchors, default).select("symbol", F.round("avwap", 4).alias("avwap"), F.round("avwap_dev", 6).alias("avwap_dev"), "vwap_start")


@query("indicators_ready", f"""WITH n AS (SELECT symbol, count(*) AS bars FROM daily_bars WHERE date < TIMESTAMP '1995-01-25' GROUP BY 1)
    SELECT symbol, bars, c.name, c.output, bars >= c.needs AS ready FROM n, (VALUES {', '.join(f"('{i.name}', '{o}', {i.lookback(i.params)})" for i in ind.REGISTRY.values() if i.kind == 'window' for o in i.outputs)}) AS c(name, output, needs)""",
       ("daily_bars",))
def indicators_ready(spark, sf):
    """The catalogue of windowed indicators beside each symbol's history: which have bars enough."""
    cat = ind.catalog(spark).filter("kind = 'window'").select("name", "output")
    needs = spark.createDataFrame([(i.name, int(i.lookback(i.params))) for i in ind.REGISTRY.values() if i.kind == "window"], "name string, needs int")
    listed = cat.join(needs, "name").agg(F.collect_list(F.struct("name", "output", "needs")).alias("c"))
    rows = listed.first()["c"]  # as many as the registry holds
    bars = views.daily_bars(spark, sf).filter("date < '1995-01-25'").groupBy("symbol").agg(F.count("*").alias("bars"))
    every = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.output).alias("output"), F.lit(r.needs).alias("needs")) for r in rows])
    return bars.select("symbol", "bars", F.inline(every)).select("symbol", "bars", "name", "output", (F.col("bars") >= F.col("needs")).alias("ready"))


@query("etl_progress_resumed", """WITH a AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_custkey AS symbol, o_orderkey AS attempt, o_orderstatus, o_orderdate < TIMESTAMP '1995-06-01' AS old FROM orders),
    s AS (SELECT week, symbol, attempt, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'empty' ELSE 'done' END AS status FROM a)
    SELECT week, symbol, arg_max(status, attempt) AS status, count(*) FILTER (WHERE status = 'failed') AS retries FROM s GROUP BY 1, 2""")
def etl_progress_resumed(spark, sf):
    """A load that goes on: earlier progress, then the outcomes of a second pass."""
    o = views.table(spark, sf, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("week"), F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("attempt"),
                                                F.when(F.col("o_orderstatus") == "O", 0).otherwise(5).cast("long").alias("rows"), F.when(F.col("o_orderstatus") == "F", "boom").alias("error"), "o_orderdate")
    first, then = (o.filter(cond).drop("o_orderdate") for cond in ("o_orderdate < '1995-06-01'", "o_orderdate >= '1995-06-01'"))
    empty = first.limit(0).withColumn("status", F.lit(None).cast("string"))
    # attempts stay in the log; only the newest counts
    log = first.withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(F.col("rows") == 0, "empty").otherwise("done"))
    return etl.record(log if empty.columns == log.columns else log.select(*empty.columns), then).select("week", "symbol", "status", "retries")


@query("ranked_by_weight", """SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (ORDER BY coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0) DESC, c_custkey) AS place FROM customer""")
def ranked_by_weight(spark, sf):
    """Largest weight first, a missing weight as zero, and the place of every row."""
    c = views.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("w"))
    return topk.placed(c, [F.coalesce("w", F.lit(0.0)).desc(), F.col("c_custkey")], "place").drop("w")


@query("fx_pair_codes", """SELECT n_nationkey, 'EUR' AS base, 'C' || n_nationkey AS counter, 'C' || n_nationkey || 'EUR' AS direct, 'EURC' || n_nationkey AS indirect, 'C' || n_nationkey AS of_direct,
    'C' || n_nationkey AS of_indirect, 'EURC' || n_nationkey AS out_of_place FROM nation""")
def fx_pair_codes(spark, sf):
    n = views.table(spark, sf, "nation").select("n_nationkey", F.lit("EUR").alias("base"), F.concat(F.lit("C"), "n_nationkey").alias("counter"))
    b, c = F.col("base"), F.col("counter")
    pairs = n.withColumns({"direct": x.pair_code(b, c), "indirect": x.pair_code(b, c, False)})
    return pairs.withColumns({"of_direct": x.counter_of(F.col("direct"), b), "of_indirect": x.counter_of(F.col("indirect"), b, False), "out_of_place": x.counter_of(F.col("indirect"), b)})


@query("ref_currency_snapshots_indirect", """SELECT 'EUR' AS base_currency, 'S' || l_suppkey AS counter_currency, l_tax AS last_rate FROM lineitem""")
def ref_currency_snapshots_indirect(spark, sf):
    landed = _body(lines(spark, sf), {"code": "concat('EURS', l_suppkey, '.FOREX')", "close": "l_tax"})
    return shaping.currency_snapshots(landed, "eur", False).select("base_currency", "counter_currency", "last_rate")


@query("dates_normalised", """SELECT 'text' AS kind, o_orderkey, date_trunc('day', o_orderdate) AS date FROM orders UNION ALL SELECT 'typed', o_orderkey, o_orderdate FROM orders
    UNION ALL SELECT 'number', o_orderkey, NULL FROM orders""")
def dates_normalised(spark, sf):
    """Any input to a date-keyed frame: text that reads as dates, a typed column of another name, numeric keys."""
    o = views.table(spark, sf, "orders")
    text = sc.normalize_dates(o.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("happened")))
    typed = sc.normalize_dates(o.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("at")))
    number = sc.normalize_dates(o.select("o_orderkey", F.col("o_orderkey").alias("o_index")))
    out = [text.select(F.lit("text").alias("kind"), "o_orderkey", "date"), typed.select(F.lit("typed").alias("kind"), "o_orderkey", "date"),
           number.select(F.lit("number").alias("kind"), "o_orderkey", (F.col("date") if "date" in number.columns else F.lit(None)).cast("timestamp").alias("date"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("external_tables", """SELECT 'ext_orders' AS name, count(*) AS rows, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders
    UNION ALL SELECT 'ext_events', count(*), min(ts), max(ts) FROM events UNION ALL SELECT 'ext_nation', count(*), NULL, NULL FROM nation""")
def external_tables(spark, sf):
    names = external.register(spark, {f"ext_{t}": f"{sf}/{t}.parquet" for t in ("orders", "events", "nation")})
    return external.spans(spark, [r.name for r in names.select("name").collect()])


# --- tick files over clock changes ------------------------------------------------------------

# The given stamps lie in one month; hour by hour they are laid over the nights of 2024-03-10 and 2024-11-03.
_NIGHT = "CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-03-10 00:00:00' ELSE TIMESTAMP '2024-11-03 00:00:00' END"


@query("src_clock_change", f"""WITH e AS (SELECT *, {_NIGHT} + INTERVAL 1 MINUTE * (event_id % 240) AS l FROM events),
    p AS (SELECT *, month(l) = 3 AND hour(l) = 2 AS gap, month(l) = 11 AND hour(l) = 1 AS twice FROM e)
    SELECT event_id, event_type || '_' || (user_id % 2) AS part, CASE WHEN gap THEN 'nonexistent local time' WHEN twice THEN 'ambiguous local time' END AS problem,
      CASE WHEN NOT gap AND NOT twice THEN l + CASE WHEN (month(l) = 3 AND hour(l) < 2) OR (month(l) = 11 AND hour(l) > 1) THEN INTERVAL '5 hours' ELSE INTERVAL '4 hours' END END AS time FROM p""")
def src_clock_change(spark, sf):
    """Tick files of the two nights on which clocks change: every stamp checked, in UTC."""
    path = scratch_path(spark, "nights")
    local = F.expr(_NIGHT) + F.make_dt_interval(mins=(F.col("event_id") % 240).cast("int"))
    text = F.concat_ws(",", F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.col("value"), F.col("event_id"), F.lit("N"), F.lit(""))
    part = F.concat("event_type", F.lit("_"), F.col("user_id") % 2)
    (views.table(spark, sf, "events").select(text.alias("value"), F.concat("event_type", F.lit("."), F.col("user_id") % 2, F.lit("_trades")).alias("f"))
     .write.partitionBy("f").text(path))
    rows = tk.read(spark, path)
    return rows.select(F.get("fields", F.lit(2)).cast("long").alias("event_id"), F.replace(F.lower("symbol"), F.lit("."), F.lit("_")).alias("part"), "problem",
                       F.when(F.col("problem").isNull(), F.col("time")).alias("time"))


# --- whole provider maps ------------------------------------------------------------------------


def _value(kind: str, i: int, name: str) -> tuple[str, str]:
    """(what the provider writes, what comes out) of the i-th field of an order."""
    return {
        "text": (f"concat('{name} ', l_orderkey)", f"'{name} ' || l_orderkey"),
        "num": (f"cast(l_orderkey * 0.25 + {i + 1} AS string)", f"CAST(l_orderkey * 0.25 + {i + 1} AS DOUBLE)"),
        "int": (f"cast(l_orderkey % 97 + {i} AS string)", f"CAST(l_orderkey % 97 + {i} AS BIGINT)"),
        "bool": ("cast(l_orderkey % 2 = 0 AS string)", "l_orderkey % 2 = 0"),
        "day": (f"cast(date_add(DATE '2001-01-01', cast(l_orderkey % 300 AS int) + {i}) AS string)", f"DATE '2001-01-01' + CAST(l_orderkey % 300 + {i} AS INTEGER)"),
    }[kind]


def _tree(fields: dict[str, tuple[str, str]], extra: dict[str, str]) -> str:
    """A nested struct, as Spark SQL, that holds every field at its path (the last of several)."""
    root: dict = {}
    for i, (name, (paths, kind)) in enumerate(fields.items()):
        *steps, leaf = paths.split("|")[-1].split(".")
        at = root
        for s in steps:
            at = at.setdefault(s, {})
        at[leaf] = extra.get(name) or _value(kind, i, name)[0]

    def text(node) -> str:
        return node if isinstance(node, str) else "named_struct(" + ", ".join(f"'{k}', {text(v)}" for k, v in node.items()) + ")"

    return text(root)


def _whole_map(name, fn, fields, also="", given=None, special=None):
    """Register a query that fills and compares every field of a provider map."""
    given, special = given or {}, special or {}
    picks = ", ".join(f"{special.get(n) or _value(k, i, n)[1]} AS {n}" for i, (n, (_, k)) in enumerate(fields.items()))

    @query(name, f"SELECT {_SYM} AS symbol, {picks}{also} FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
    def run(spark, sf):
        orders = lines(spark, sf).select("l_orderkey").distinct()
        return fn(orders.select(F.concat(F.lit("o"), "l_orderkey").alias("symbol"), F.to_json(F.expr(_tree(fields, given))).alias("payload")))


_whole_map("ref_metrics_all", shaping.key_metrics, shaping.METRICS, ", 'TTM' AS fiscal_period")
_whole_map("ref_profile_all", shaping.profile, shaping.PROFILE, ", CAST(NULL AS VARCHAR) AS logo_url, CAST(NULL AS VARCHAR) AS ceo")
_SHARE_AT = {n: i + 1 for i, n in enumerate(shaping.SHARES)}
_whole_map("ref_share_statistics_all", shaping.share_statistics, shaping.SHARES,
           f", round((l_orderkey * 0.25 + {_SHARE_AT['float_shares']}) / (l_orderkey * 0.25 + {_SHARE_AT['outstanding_shares']}) * 100, 4) AS free_float")


def _statement(name, which, period):
    section, items = shaping.STATEMENTS[which]
    bucket = "yearly" if period == "annual" else "quarterly"
    label = "'FY'" if period == "annual" else "'Q' || ((month(d) - 9 - 1 + 24) % 12 // 3 + 1)"
    rows = ", ".join(f"('{out}', {i})" for i, out in enumerate(items.values()))

    @query(name, f"""WITH p AS (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS d FROM lineitem GROUP BY 1)
        SELECT {_SYM} AS symbol, d AS period_ending, year(d) + CASE WHEN month(d) > 9 THEN 1 ELSE 0 END AS fiscal_year, {label} AS fiscal_period, m.item,
          CASE WHEN m.i = 1 THEN NULL ELSE CAST(l_orderkey * 0.25 + m.i AS DOUBLE) END AS value, CASE WHEN m.i = 1 THEN 'n. m.' END AS text FROM p, (VALUES {rows}) AS m(item, i)""")
    def run(spark, sf):
        periods = lines(spark, sf).groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).cast("string").alias("d"))
        entry = F.create_map(F.lit("date"), F.col("d"), F.lit("currency_symbol"), F.lit("USD"), *[c for i, k in enumerate(items) for c in (
            F.lit(k), F.lit("n. m.") if i == 1 else (F.col("l_orderkey") * 0.25 + i).cast("string"))])
        body = F.to_json(F.create_map(F.col("d"), entry))
        landed = periods.select(F.concat(F.lit("o"), "l_orderkey").alias("symbol"), F.concat(
            F.lit('{"General":{"FiscalYearEnd":"September"},"Financials":{"' + section + '":{"' + bucket + '":'), body, F.lit("}}}")).alias("payload"))
        return shaping.statements(landed, which, period)


_statement("ref_balance_sheet", "balance", "annual")
_statement("ref_cash_flow", "cash", "quarter")
_statement("ref_income_quarterly_all", "income", "quarter")


@query("ref_cpi_index", f"{_MACRO} SELECT country, date, value FROM s WHERE i = '4'")
def ref_cpi_index(spark, sf):
    """The price index itself, not its yearly change."""
    rows = _macro(spark, sf).withColumn("indicator", F.when(F.col("indicator") == shaping.CPI["yoy"], shaping.CPI["index"]).otherwise(F.col("indicator")))
    return shaping.macro_series(rows.filter(F.col("indicator") == shaping.CPI["index"])).drop("indicator")
