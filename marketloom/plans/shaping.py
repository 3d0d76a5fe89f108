"""Provider bodies built from the given tables, shaped back into rows."""

from pyspark.sql import functions as F

from marketloom import views
from marketloom.functions import scalar as x
from marketloom.operators import shaping as sh
from marketloom.plans.registry import query


def lines(spark, sf):
    return views.table(spark, sf, "lineitem")


def _body(rows, fields, keyed=None, wrap=("", "")):
    """One body per line of an order, as a JSON list or an object keyed by `keyed`."""
    item = F.struct(*[F.expr(e).alias(n) for n, e in fields.items()])
    if keyed is None:
        text = F.to_json(F.array(item))
    else:
        rows = rows.groupBy("l_orderkey", F.expr(keyed).alias("k")).agg(F.max(item).alias("v"))
        text = F.to_json(F.create_map("k", "v"))
    return rows.select(F.concat(F.lit("o"), "l_orderkey").alias("symbol"), F.concat(F.lit(wrap[0]), text, F.lit(wrap[1])).alias("payload"))


_SYM = "'O' || CAST(l_orderkey AS VARCHAR)"
_DAY = "CAST(CAST(l_shipdate AS DATE) AS STRING)"
_MONTHS = ", ".join(f"'{m.title()}'" for m in x.MONTHS)


def _statements(spark, sf, bucket):
    per_day = lines(spark, sf).groupBy("l_orderkey", F.to_date("l_shipdate").alias("d")).agg(
        F.max("l_extendedprice").alias("rev"), F.max("l_quantity").alias("qty"), F.max("l_returnflag").alias("flag"))
    entry = F.struct(F.col("d").cast("string").alias("date"), F.lit("2000-01-01").alias("filing_date"),
                     F.col("rev").cast("string").alias("totalRevenue"), F.col("qty").alias("netIncome"), F.col("flag").alias("someOddItem"),
                     F.lit("").alias("ebit"))
    return per_day.withColumn("t", F.to_json(F.create_map(F.col("d").cast("string"), entry))).select(
        F.concat(F.lit("o"), "l_orderkey").alias("symbol"),
        F.concat(F.lit('{"General":{"FiscalYearEnd":"'), F.element_at(F.array(*[F.lit(m.title()) for m in x.MONTHS]),
                 (F.pmod("l_orderkey", F.lit(12)) + 1).cast("int")),
                 F.lit('"},"Financials":{"Income_Statement":{"' + bucket + '":'), "t", F.lit("}}}")).alias("payload"))


_ST = f"""WITH p AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS rev, max(l_quantity) AS qty, max(l_returnflag) AS flag,
      l_orderkey % 12 + 1 AS fm FROM lineitem GROUP BY 1, 2),
    f AS (SELECT *, year(d) + CASE WHEN month(d) > fm THEN 1 ELSE 0 END AS fy, (month(d) - fm - 1 + 24) % 12 // 3 + 1 AS q,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY d DESC) AS rn FROM p),
    i AS (SELECT {_SYM} AS symbol, d AS period_ending, fy AS fiscal_year, q, rn, unnest(['revenue', 'net_income', 'some_odd_item', 'ebit']) AS item,
      unnest([rev, qty, NULL, NULL]) AS value, unnest([NULL, NULL, flag, NULL]) AS text FROM f)"""


@query("ref_statements", f"{_ST} SELECT symbol, period_ending, fiscal_year, 'FY' AS fiscal_period, item, value, text FROM i")
def ref_statements(spark, sf):
    return sh.statements(_statements(spark, sf, "yearly"))


@query("ref_statements_quarterly", f"{_ST} SELECT symbol, period_ending, fiscal_year, 'Q' || q AS fiscal_period, item, value, text FROM i WHERE rn <= 2")
def ref_statements_quarterly(spark, sf):
    return sh.statements(_statements(spark, sf, "quarterly"), "income", "quarter", 2)


_HOLD = {"name": "concat('H', l_partkey)", "date": f"CASE WHEN l_returnflag = 'N' THEN 'never' ELSE {_DAY} END", "totalShares": "l_discount",
         "totalAssets": "l_tax", "currentShares": "CASE WHEN l_quantity > 5 THEN l_quantity END", "change": "-l_quantity", "change_p": "l_tax"}


@query("ref_institutions", f"""SELECT {_SYM} AS symbol, CAST(l_shipdate AS DATE) AS date, 'H' || l_partkey AS name, l_discount AS total_shares_percent,
    CASE WHEN l_quantity > 5 THEN l_quantity END AS current_shares,
    rank() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity > 5 THEN l_quantity ELSE 0 END DESC, 'H' || l_partkey, CAST(l_shipdate AS DATE)) AS rank
    FROM lineitem WHERE l_returnflag <> 'N'""")
def ref_institutions(spark, sf):
    out = sh.institutional_ownership(_body(lines(spark, sf), _HOLD, wrap=('{"Holders":{"Institutions":', "}}")))
    return out.select("symbol", "date", "name", "total_shares_percent", "current_shares", F.col("rank").cast("long").alias("rank"))


@query("ref_ownership", f"""SELECT {_SYM} AS symbol, 'H' || l_partkey AS investor_name, CAST(l_shipdate AS DATE) AS date, CAST(l_shipdate AS DATE) AS filing_date,
    CASE WHEN l_quantity > 5 THEN l_quantity END AS current_shares, l_discount AS total_shares_percent FROM lineitem WHERE l_returnflag <> 'N'""")
def ref_ownership(spark, sf):
    rows = lines(spark, sf)
    a = _body(rows.filter("l_linestatus = 'F'"), _HOLD, wrap=('{"Holders":{"Institutions":', "}}"))
    b = _body(rows.filter("l_linestatus <> 'F'"), _HOLD, wrap=('{"Holders":{"Funds":', "}}"))
    return sh.ownership(a.unionByName(b))


@query("ref_etf_holdings", f"""WITH v AS (SELECT l_orderkey, 'P' || l_partkey || '_' || l_linenumber AS symbol, max(l_discount) AS w FROM lineitem GROUP BY 1, 2)
    SELECT {_SYM} AS fund, symbol, round(w / 100, 8) AS weight FROM v""")
def ref_etf_holdings(spark, sf):
    landed = _body(lines(spark, sf), {"Assets_%": "CAST(l_discount AS STRING)", "Name": "l_returnflag"},
                   "concat('p', l_partkey, '_', l_linenumber)", ('{"ETF_Data":{"Holdings":', "}}"))
    return sh.etf_holdings(landed).select("fund", "symbol", F.round("weight", 8).alias("weight"))


@query("ref_etf_sectors", f"""WITH v AS (SELECT l_orderkey, l_returnflag AS sector, max(l_tax) AS w FROM lineitem GROUP BY 1, 2)
    SELECT {_SYM} AS symbol, sector, round(w / 100, 8) AS weight FROM v""")
def ref_etf_sectors(spark, sf):
    landed = _body(lines(spark, sf), {"Equity_%": "l_tax"}, "l_returnflag", ('{"ETF_Data":{"Sector_Weights":', "}}"))
    return sh.etf_weights(landed).select("symbol", "sector", F.round("weight", 8).alias("weight"))


@query("ref_etf_countries", f"""WITH v AS (SELECT l_orderkey, l_linestatus AS country, max(l_tax) AS w FROM lineitem GROUP BY 1, 2)
    SELECT {_SYM} AS symbol, country, round(w / 100, 8) AS weight FROM v""")
def ref_etf_countries(spark, sf):
    landed = _body(lines(spark, sf), {"Equity_%": "l_tax"}, "l_linestatus", ('{"ETF_Data":{"World_Regions":', "}}"))
    return sh.etf_weights(landed, "World_Regions", "country").select("symbol", "country", F.round("weight", 8).alias("weight"))


@query("ref_insider", f"""SELECT CASE WHEN l_returnflag = 'A' THEN 'C' || l_suppkey ELSE {_SYM} END AS symbol, 'W' || l_partkey AS owner_name,
    CAST(l_shipdate AS DATE) AS transaction_date, l_quantity AS securities_transacted FROM lineitem""")
def ref_insider(spark, sf):
    landed = _body(lines(spark, sf), {"code": "CASE WHEN l_returnflag = 'A' THEN concat('c', l_suppkey) END", "ownerName": "concat('W', l_partkey)",
                                      "transactionDate": _DAY, "transactionAmount": "l_quantity"})
    return sh.insider_trades(landed).select("symbol", "owner_name", "transaction_date", "securities_transacted")


@query("ref_government", """SELECT CASE WHEN l_returnflag <> 'A' THEN 'T' || l_suppkey END AS symbol, CAST(l_shipdate AS DATE) AS date, 'M' || l_partkey AS representative,
    l_extendedprice AS amount_low, l_linestatus = 'F' AS is_late FROM lineitem WHERE l_quantity > 3""")
def ref_government(spark, sf):
    landed = _body(lines(spark, sf), {
        "member": "named_struct('full_name', concat('M', l_partkey), 'party', l_returnflag)",
        "asset": "named_struct('symbol', CASE WHEN l_returnflag = 'A' THEN '' ELSE concat('T', l_suppkey) END)",
        "transaction": f"named_struct('disclosure_date', CASE WHEN l_quantity > 3 THEN {_DAY} END, 'amount_low', l_extendedprice, 'is_late', l_linestatus = 'F')"})
    return sh.government_trades(landed).select("symbol", "date", "representative", "amount_low", "is_late")


@query("ref_splits", f"""SELECT {_SYM} AS symbol, CAST(l_shipdate AS DATE) AS date, l_quantity AS numerator,
    CAST(CASE WHEN l_linenumber = 7 THEN 1 ELSE l_linenumber END AS DOUBLE) AS denominator,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ':' || CASE WHEN l_linenumber = 7 THEN 1 ELSE l_linenumber END AS split_ratio
    FROM lineitem WHERE l_returnflag <> 'N'""")
def ref_splits(spark, sf):
    landed = _body(lines(spark, sf), {"date": _DAY, "split": "CASE WHEN l_returnflag = 'N' THEN 'none' WHEN l_linenumber = 7 THEN "
                                                         "concat(l_quantity, '/0') ELSE concat(l_quantity, '/', l_linenumber, '.000') END"})
    return sh.splits(landed)


@query("ref_split_calendar", """SELECT 'C' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_quantity AS numerator, CAST(l_linenumber AS DOUBLE) AS denominator
    FROM lineitem WHERE l_linenumber <> 7 AND l_returnflag <> 'A'""")
def ref_split_calendar(spark, sf):
    landed = _body(lines(spark, sf), {"code": "CASE WHEN l_returnflag = 'A' THEN '' ELSE concat('c', l_suppkey) END", "split_date": _DAY,
                                      "new_shares": "l_quantity", "old_shares": "CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END"})
    return sh.split_calendar(landed).drop("optionable")


@query("ref_dividends", f"""SELECT {_SYM} AS symbol, CAST(l_shipdate AS DATE) AS ex_dividend_date, l_tax AS amount, l_returnflag AS frequency
    FROM lineitem WHERE l_linestatus = 'O'""")
def ref_dividends(spark, sf):
    landed = _body(lines(spark, sf), {"date": f"CASE WHEN l_linestatus = 'O' THEN {_DAY} ELSE '0000-00-00' END", "value": "l_tax", "period": "l_returnflag"})
    return sh.dividends(landed).select("symbol", "ex_dividend_date", "amount", "frequency")


@query("ref_market_cap", f"""SELECT {_SYM} AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS market_cap FROM lineitem WHERE l_quantity > 10""")
def ref_market_cap(spark, sf):
    return sh.market_caps(_body(lines(spark, sf), {"date": _DAY, "value": "CASE WHEN l_quantity > 10 THEN l_extendedprice END"}, "concat(l_linenumber, '_', l_partkey, '_', l_suppkey)"))


@query("ref_provider_bars", f"""SELECT {_SYM} AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS close, l_quantity AS volume FROM lineitem WHERE l_quantity > 2""")
def ref_provider_bars(spark, sf):
    landed = _body(lines(spark, sf), {"date": _DAY, "close": "CASE WHEN l_quantity > 2 THEN l_extendedprice END", "volume": "l_quantity"})
    return sh.provider_bars(landed).select("symbol", "date", "close", "volume")


@query("ref_provider_bars_intraday", f"""SELECT {_SYM} AS symbol, l_shipdate + INTERVAL '1 hour' AS date, l_extendedprice AS close FROM lineitem""")
def ref_provider_bars_intraday(spark, sf):
    landed = _body(lines(spark, sf), {"timestamp": "unix_seconds(l_shipdate) + 3600", "close": "l_extendedprice"})
    return sh.provider_bars(landed, True).select("symbol", "date", "close")


def _bundles(spark, sf):
    """One fundamentals bundle per part."""
    p = views.table(spark, sf, "part")
    name = F.col("p_name")
    general = F.struct(name.alias("Name"), F.lit("USD").alias("CurrencyCode"), F.lit("2024-03-05").alias("UpdatedAt"),
                       F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise("NA").alias("FullTimeEmployees"),
                       F.struct(F.col("p_brand").alias("City")).alias("AddressData"), F.lit("/img/a.png").alias("LogoURL"),
                       F.array(F.struct(F.lit("Ann").alias("Name"), F.lit("Chair").alias("Title"), F.lit("NA").alias("YearBorn")),
                               F.struct(F.col("p_type").alias("Name"), F.lit("President & CEO").alias("Title"), F.lit("1970").alias("YearBorn"))).alias("Officers"))
    high = F.struct(F.lit("2024-06-30").alias("MostRecentQuarter"), F.col("p_retailprice").alias("MarketCapitalization"),
                    F.when(F.col("p_size") > 20, 0).otherwise(F.col("p_size")).alias("DilutedEpsTTM"), F.lit(7.5).alias("EarningsShare"))
    shares = F.struct(F.col("p_retailprice").alias("SharesOutstanding"), F.col("p_size").alias("SharesFloat"))
    etf = F.struct(F.lit("1.06").alias("Yield"), F.col("p_size").cast("string").alias("Holdings_Count"), F.col("p_brand").alias("Company_URL"))
    esg = F.struct(F.when(F.col("p_size") > 25, F.col("p_size")).alias("TotalEsg"), F.lit("2023-01-01").alias("RatingDate"))
    rating = F.struct(F.when(F.col("p_size") > 30, F.col("p_retailprice")).alias("TargetPrice"))
    trend = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(
        F.struct(F.lit("2024-12-31").alias("date"), F.lit("+1y").alias("period"), F.col("p_size").alias("earningsEstimateAvg"), F.lit("12.0").alias("earningsEstimateNumberOfAnalysts")),
        F.struct(F.lit(None).cast("string").alias("date"), F.lit("0q").alias("period"), F.col("p_size").alias("earningsEstimateAvg"), F.lit("3").alias("earningsEstimateNumberOfAnalysts"))))
    hist = F.array(F.struct(F.lit("").alias("date"), F.lit("2024-02-01").alias("reportDate"), F.col("p_size").alias("epsActual"), F.lit("NA").alias("epsEstimate")))
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("symbol"), F.to_json(F.struct(
        general.alias("General"), high.alias("Highlights"), shares.alias("SharesStats"), etf.alias("ETF_Data"), esg.alias("ESGScores"),
        rating.alias("AnalystRatings"), F.struct(trend.alias("Trend"), hist.alias("History")).alias("Earnings"))).alias("payload"))


_P = "'P' || CAST(p_partkey AS VARCHAR) AS symbol"


def _bundle(name, fn, cols, sql):
    @query(name, f"SELECT {_P}, {sql}")
    def run(spark, sf):
        return fn(_bundles(spark, sf)).select("symbol", *cols)


_bundle("ref_metrics", sh.key_metrics, ("period_ending", "market_cap", "eps_ttm", "fiscal_period"),
        "DATE '2024-06-30' AS period_ending, p_retailprice AS market_cap, CAST(CASE WHEN p_size > 20 THEN 7.5 ELSE p_size END AS DOUBLE) AS eps_ttm, 'TTM' AS fiscal_period FROM part")
_bundle("ref_profile", sh.profile, ("name", "employees", "hq_address_city", "updated_at", "logo_url", "ceo"),
        "p_name AS name, CASE WHEN p_size > 10 THEN p_size END AS employees, p_brand AS hq_address_city, DATE '2024-03-05' AS updated_at, "
        f"'{sh.ASSETS}/img/a.png' AS logo_url, p_type AS ceo FROM part")
_bundle("ref_executives", sh.executives, ("name", "title", "year_born"),
        "unnest(['Ann', p_type]) AS name, unnest(['Chair', 'President & CEO']) AS title, unnest([NULL, 1970]) AS year_born FROM part")
_bundle("ref_share_statistics", sh.share_statistics, ("outstanding_shares", "float_shares", "free_float"),
        "p_retailprice AS outstanding_shares, CAST(p_size AS DOUBLE) AS float_shares, round(p_size / p_retailprice * 100, 4) AS free_float FROM part")
_bundle("ref_etf_info", sh.etf_info, ("website", "dividend_yield", "holdings_count"),
        "p_brand AS website, CAST(0.0106 AS DOUBLE) AS dividend_yield, p_size AS holdings_count FROM part")
_bundle("ref_esg", sh.esg, ("esg_score", "period_ending", "disclosure_date"),
        "CAST(p_size AS DOUBLE) AS esg_score, DATE '2023-01-01' AS period_ending, DATE '2023-01-01' AS disclosure_date FROM part WHERE p_size > 25")
_bundle("ref_price_target", sh.price_target, ("name", "target_consensus"), "p_name AS name, p_retailprice AS target_consensus FROM part WHERE p_size > 30")
_bundle("ref_estimates", sh.estimates, ("date", "estimated_eps_avg", "number_analysts_estimated_eps"),
        "DATE '2024-12-31' AS date, CAST(p_size AS DOUBLE) AS estimated_eps_avg, 12 AS number_analysts_estimated_eps FROM part")
_bundle("ref_forward_eps", sh.forward_eps, ("date", "fiscal_period", "mean"), "DATE '2024-12-31' AS date, '+1y' AS fiscal_period, CAST(p_size AS DOUBLE) AS mean FROM part")
_bundle("ref_eps_history", sh.eps_history, ("date", "eps_actual", "eps_estimated"),
        "DATE '2024-02-01' AS date, CAST(p_size AS DOUBLE) AS eps_actual, CAST(NULL AS DOUBLE) AS eps_estimated FROM part")


@query("ref_symbol_meta", """SELECT upper(c_name) AS symbol, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS name, c_acctbal AS week52_high, 'us' AS asset_class FROM customer""")
def ref_symbol_meta(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_name").alias("symbol"), F.to_json(F.struct(
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise("NA").alias("General::Name"), F.lit("NA").alias("General::LogoURL"),
        F.col("c_acctbal").alias("Technicals::52WeekHigh"))).alias("payload"))
    return sh.symbol_meta(c).select("symbol", "name", "week52_high", "asset_class")


@query("ref_bundle_cache", """SELECT CAST(o_custkey AS VARCHAR) AS symbol, o_orderdate AS fetched_at, o_orderkey AS payload FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AND o_orderdate >= TIMESTAMP '2000-01-01'""")
def ref_bundle_cache(spark, sf):
    cache = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").alias("fetched_at")).agg(
        F.max("o_orderkey").alias("payload"))
    return sh.cached_bundles(cache, F.lit("2000-01-02").cast("timestamp"), 24)


@query("ref_earnings_calendar", f"""SELECT 'C' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS report_date, l_tax AS eps_consensus, l_discount AS eps_actual FROM lineitem
    WHERE l_returnflag <> 'A' AND l_quantity > 4""")
def ref_earnings_calendar(spark, sf):
    landed = _body(lines(spark, sf), {"code": "CASE WHEN l_returnflag <> 'A' THEN concat('c', l_suppkey) END", "report_date": f"CASE WHEN l_quantity > 4 THEN {_DAY} END",
                                      "estimate": "l_tax", "actual": "l_discount"})
    return sh.earnings_calendar(landed).select("symbol", "report_date", "eps_consensus", "eps_actual")


@query("ref_ipo_calendar", """SELECT 'C' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ipo_date, nullif(l_tax, 0) AS price_from FROM lineitem WHERE l_suppkey = 7""")
def ref_ipo_calendar(spark, sf):
    landed = _body(lines(spark, sf), {"code": "concat('c', l_suppkey)", "start_date": _DAY, "price_from": "l_tax"})
    return sh.ipo_calendar(landed, "C7.US").select("symbol", "ipo_date", "price_from")


@query("ref_economic_calendar", """WITH t AS (SELECT r_name AS source, 'cat ' || n_regionkey AS category, n_name AS event FROM nation JOIN region ON r_regionkey = n_regionkey),
    e AS (SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN lower(n_name) WHEN l_returnflag = 'N' THEN n_name ELSE 'other ' || n_name END AS event, l_tax AS actual,
      l_shipdate + INTERVAL '8 hours' AS date FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
    SELECT e.date, e.event, e.actual, t.source, t.category FROM e LEFT JOIN t ON lower(t.event) = lower(e.event)""")
def ref_economic_calendar(spark, sf):
    taxonomy = views.table(spark, sf, "nation").join(views.table(spark, sf, "region"), F.expr("r_regionkey = n_regionkey")).select(
        F.col("r_name").alias("source"), F.concat(F.lit("cat "), "n_regionkey").alias("category"), F.col("n_name").alias("event"))
    rows = lines(spark, sf).join(views.table(spark, sf, "supplier"), F.expr("s_suppkey = l_suppkey")).join(
        views.table(spark, sf, "nation"), F.expr("n_nationkey = s_nationkey"))
    landed = _body(rows, {"date": f"concat({_DAY}, ' 08:00:00')", "actual": "l_tax", "type":
                          "CASE WHEN l_returnflag = 'A' THEN lower(n_name) WHEN l_returnflag = 'N' THEN n_name ELSE concat('other ', n_name) END"})
    return sh.economic_calendar(landed, taxonomy).select("date", "event", "actual", "source", "category")


@query("ref_news", """SELECT '2024-01-01' AS date, source || ' ' || doc_id AS title, nullif(text, '') AS body, nullif(substr(text, 1, 280), '') AS excerpt, [lang] AS symbols FROM documents
    WHERE source || ' ' || doc_id <> ''""")
def ref_news(spark, sf):
    d = views.table(spark, sf, "documents").select(F.lit("world").alias("symbol"), F.to_json(F.array(F.struct(
        F.lit("2024-01-01").alias("date"), F.concat("source", F.lit(" "), "doc_id").alias("title"), F.col("text").alias("content"),
        F.array("lang").alias("symbols"), F.array().cast("array<string>").alias("tags")))).alias("payload"))
    return sh.news(d).select("date", "title", "body", "excerpt", "symbols")


def _codes(spark, sf):
    n = views.table(spark, sf, "customer")
    return n.select(F.lit("x").alias("symbol"), F.to_json(F.array(F.struct(
        F.concat(F.lit("eur"), "c_custkey").alias("Code"), F.col("c_name").alias("Name"), F.when(F.col("c_acctbal") < 0, "NA").otherwise("USD").alias("Currency"),
        F.when(F.col("c_acctbal") < 0, "Unknown").otherwise("US").alias("Country"), F.col("c_mktsegment").alias("Exchange"),
        F.col("c_acctbal").alias("previousClose")))).alias("payload"))


_CODE = "'EUR' || CAST(c_custkey AS VARCHAR)"


@query("ref_currency_pairs", f"""SELECT {_CODE} AS symbol, c_name AS name, CASE WHEN c_acctbal >= 0 THEN 'USD' END AS currency FROM customer
    WHERE {_CODE} LIKE '%00%' OR c_name LIKE '%00%'""")
def ref_currency_pairs(spark, sf):
    return sh.currency_pairs(_codes(spark, sf), "00")


@query("ref_indices", f"""SELECT {_CODE} || '.INDX' AS symbol, c_name AS name, CASE WHEN c_acctbal >= 0 THEN 'US' END AS country FROM customer""")
def ref_indices(spark, sf):
    return sh.index_list(_codes(spark, sf)).select("symbol", "name", "country")


@query("ref_search", f"""SELECT {_CODE} || '.' || c_mktsegment AS symbol, c_mktsegment AS exchange, c_acctbal AS previous_close FROM customer""")
def ref_search(spark, sf):
    return sh.search_rows(_codes(spark, sf)).select("symbol", "exchange", "previous_close")


@query("ref_currency_snapshots", """SELECT 'EUR' AS base_currency, 'S' || l_suppkey AS counter_currency, l_tax AS last_rate, l_shipdate AS last_rate_time FROM lineitem""")
def ref_currency_snapshots(spark, sf):
    landed = _body(lines(spark, sf), {"code": "concat('S', l_suppkey, 'EUR.FOREX')", "close": "l_tax", "timestamp": "unix_seconds(l_shipdate)"})
    return sh.currency_snapshots(landed, "eur").select("base_currency", "counter_currency", "last_rate", "last_rate_time")


@query("ref_quotes", """SELECT 'C' || l_suppkey AS symbol, l_tax AS last_price, round(l_discount / 100, 8) AS change_percent, l_shipdate AS last_timestamp FROM lineitem""")
def ref_quotes(spark, sf):
    landed = _body(lines(spark, sf), {"code": "concat('c', l_suppkey)", "close": "l_tax", "change_p": "l_discount", "timestamp": "unix_seconds(l_shipdate)"})
    return sh.quotes(landed).select("symbol", "last_price", F.round("change_percent", 8).alias("change_percent"), "last_timestamp")


@query("ref_screener", """SELECT upper('P' || p_partkey || '.us') AS symbol, p_brand AS sector, p_retailprice AS market_cap, p_size AS price FROM part
    WHERE p_brand = 'Brand#2' AND p_size >= 10 AND p_retailprice <= 2000 ORDER BY market_cap DESC, symbol LIMIT 50 OFFSET 5""")
def ref_screener(spark, sf):
    p = views.table(spark, sf, "part").select(F.lit("x").alias("symbol"), F.to_json(F.array(F.struct(
        F.concat(F.lit("p"), "p_partkey").alias("code"), F.lit("us").alias("exchange"), F.col("p_brand").alias("sector"),
        F.col("p_retailprice").alias("market_capitalization"), F.col("p_size").alias("adjusted_close")))).alias("payload"))
    out = sh.screen(sh.screener(p), sector="Brand#2", price_min=10, market_cap_max=2000, limit=50, offset=5)
    return out.select("symbol", "sector", "market_cap", F.col("price").cast("int").alias("price"))


def _macro(spark, sf):
    names = F.create_map(*[F.lit(v) for i, n in enumerate(list(sh.PROFILE_INDICATORS.values())[:5], 1) for v in (str(i), n)])
    return (views.table(spark, sf, "orders").join(views.table(spark, sf, "customer"), F.expr("c_custkey = o_custkey"))
            .groupBy(F.element_at(F.array(*[F.lit(c) for c in ("germany", "uk", "us", "JPN", "atlantis")]), (F.pmod("c_nationkey", F.lit(5)) + 1).cast("int")).alias("country"),
                     names[F.substring("o_orderpriority", 1, 1)].alias("indicator"), F.to_date("o_orderdate").alias("date"))
            .agg(F.max("o_totalprice").alias("value")))


_MACRO = """WITH s AS (SELECT ['DEU', 'GBR', 'USA', 'JPN', 'ATLANTIS'][c_nationkey % 5 + 1] AS country, substr(o_orderpriority, 1, 1) AS i,
      CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)"""


@query("ref_macro_series", f"""{_MACRO} SELECT country, date, value FROM s WHERE i = '4' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def ref_macro_series(spark, sf):
    rows = _macro(spark, sf).filter(F.col("indicator") == sh.CPI["yoy"])
    return sh.macro_series(rows, "1996-01-01", "1998-12-31").drop("indicator")


def _macro_one(name, place, indicator):
    @query(name, f"{_MACRO} SELECT country, date, value FROM s WHERE i = '{place}'")
    def run(spark, sf):
        return sh.macro_series(_macro(spark, sf).filter(F.col("indicator") == indicator)).drop("indicator")


_macro_one("ref_gdp_nominal", 2, sh.PROFILE_INDICATORS["gdp_usd"])
_macro_one("ref_gdp_growth", 3, sh.PROFILE_INDICATORS["gdp_yoy"])
_macro_one("ref_unemployment", 5, sh.PROFILE_INDICATORS["jobless_rate"])


@query("ref_profile_pivot", f"""{_MACRO} SELECT country, arg_max(value, date) FILTER (WHERE i = '1') AS population, arg_max(value, date) FILTER (WHERE i = '2') AS gdp_usd,
    arg_max(value, date) FILTER (WHERE i = '3') AS gdp_yoy, arg_max(value, date) FILTER (WHERE i = '4') AS cpi_yoy, arg_max(value, date) FILTER (WHERE i = '5') AS jobless_rate,
    CAST(NULL AS DOUBLE) AS govt_debt_gdp FROM s GROUP BY 1""")
def ref_profile_pivot(spark, sf):
    return sh.country_profile(sh.macro_series(_macro(spark, sf)))


_TENOR = "['1M', '2M', '4M', '1Y', '10Y', '30Y', '1.5M'][l_linenumber]"
_RATES = f"r AS (SELECT CAST(l_shipdate AS DATE) AS date, {_TENOR} AS tenor, max(l_discount) * 100 AS rate FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)"


def _rates(spark, sf):
    tenors = F.array(*[F.lit(t) for t in ("1M", "2M", "4M", "1Y", "10Y", "30Y", "1.5M")])
    return (lines(spark, sf).filter("l_linestatus = 'F'").groupBy(F.to_date("l_shipdate").alias("date"), F.element_at(tenors, F.col("l_linenumber")).alias("tenor"))
            .agg((F.max("l_discount") * 100).alias("rate")))


@query("ref_rates_pivot", f"""WITH {_RATES} SELECT date, round(max(rate) FILTER (WHERE tenor = '1M') / 100, 6) AS month_1, round(max(rate) FILTER (WHERE tenor = '4M') / 100, 6) AS month_4,
    round(max(rate) FILTER (WHERE tenor = '10Y') / 100, 6) AS year_10, CAST(NULL AS DOUBLE) AS year_20 FROM r WHERE tenor <> '1.5M' GROUP BY 1""")
def ref_rates_pivot(spark, sf):
    out = sh.treasury_rates(_rates(spark, sf))
    return out.select("date", *[F.round(c, 6).alias(c) for c in ("month_1", "month_4", "year_10", "year_20")])


@query("ref_yield_curve", f"""WITH {_RATES}, d AS (SELECT DISTINCT date FROM r WHERE tenor <> '1.5M'), w AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS wanted FROM orders),
    a AS (SELECT wanted, date FROM w ASOF JOIN d ON w.wanted >= d.date),
    m AS (SELECT unnest(['1M', '2M', '1Y', '10Y', '30Y']) AS tenor, unnest([0, 1, 4, 9, 11]) AS place, unnest(['month_1', 'month_2', 'year_1', 'year_10', 'year_30']) AS maturity)
    SELECT a.wanted, a.date, place, maturity, round(rate / 100, 6) AS rate FROM a JOIN r ON r.date = a.date JOIN m ON m.tenor = r.tenor""")
def ref_yield_curve(spark, sf):
    wanted = views.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("wanted")).distinct()
    out = sh.yield_curve(sh.treasury_rates(_rates(spark, sf)), wanted)
    return out.withColumn("rate", F.round("rate", 6))


_YIELD = """WITH paid AS (SELECT o_orderpriority AS symbol, o_orderdate AS date, sum(o_totalprice) / 99991.0 AS amount FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2),
    u AS (SELECT symbol, date, close, 0.0 AS amount, 1 AS bar FROM daily_bars UNION ALL SELECT symbol, date, NULL, amount, 0 FROM paid),
    s AS (SELECT *, sum(amount) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW) AS t FROM u)
    SELECT symbol, date, round(t / close, 4) AS trailing_dividend_yield FROM s WHERE bar = 1"""


@query("ref_trailing_yield", _YIELD + " QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 252", ("daily_bars",))
def ref_trailing_yield(spark, sf, limit=252):
    paid = (views.table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("date"))
            .agg((F.sum("o_totalprice") / F.lit(99991.0)).alias("amount")))
    return sh.trailing_yield(views.daily_bars(spark, sf), paid, limit).withColumn("trailing_dividend_yield", F.round("trailing_dividend_yield", 4))


@query("ref_trailing_yield_all", _YIELD, ("daily_bars",))
def ref_trailing_yield_all(spark, sf):
    return ref_trailing_yield(spark, sf, None)



@query("fx_mid_and_change", """SELECT o_orderkey, round(coalesce((bid + ask) / 2, bid, ask), 4) AS mid, round((ask - bid) / nullif(bid, 0), 6) AS change_percent,
    round((ask - bid) / nullif(bid, 0) * 10000, 3) AS bps FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS bid,
    CASE WHEN o_orderstatus <> 'O' THEN o_totalprice + o_custkey / 7.0 END AS ask FROM orders)""")
def fx_mid_and_change(spark, sf):
    o = views.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("bid"),
                                                F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") + F.col("o_custkey") / 7.0).alias("ask"))
    return o.select("o_orderkey", F.round(x.mid(F.col("bid"), F.col("ask")), 4).alias("mid"),
                    F.round(x.change_percent(F.col("ask"), F.col("bid")), 6).alias("change_percent"),
                    F.round(x.bps(x.change(F.col("ask"), F.col("bid")), F.col("bid")), 3).alias("bps"))
