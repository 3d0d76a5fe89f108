"""Provider JSON to tidy rows.

Every function takes landed rows `(symbol, payload)` with the provider's body as
text and returns typed rows. Open-ended parts go through VARIANT or maps, so a
body is parsed once and Spark prunes what is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import scalar as x
from marketloom.operators import asof
from marketloom.operators.series import Layout
from marketloom.operators.topk import latest

# --- field maps: output -> (path, kind) (fixed values) ------------------------------------

METRICS = {
    "period_ending": ("Highlights.MostRecentQuarter", "day"), "currency": ("General.CurrencyCode", "text"),
    "market_cap": ("Highlights.MarketCapitalization", "num"), "pe_ratio": ("Highlights.PERatio", "num"),
    "forward_pe": ("Valuation.ForwardPE", "num"), "peg_ratio": ("Highlights.PEGRatio", "num"),
    "eps_ttm": ("Highlights.DilutedEpsTTM|Highlights.EarningsShare", "num"),
    "book_value_per_share": ("Highlights.BookValue", "num"), "dividend_per_share": ("Highlights.DividendShare", "num"),
    "dividend_yield": ("Highlights.DividendYield", "num"), "revenue_ttm": ("Highlights.RevenueTTM", "num"),
    "revenue_per_share_ttm": ("Highlights.RevenuePerShareTTM", "num"), "gross_profit_ttm": ("Highlights.GrossProfitTTM", "num"),
    "ebitda": ("Highlights.EBITDA", "num"), "profit_margin": ("Highlights.ProfitMargin", "num"),
    "operating_margin_ttm": ("Highlights.OperatingMarginTTM", "num"),
    "return_on_assets_ttm": ("Highlights.ReturnOnAssetsTTM", "num"),
    "return_on_equity_ttm": ("Highlights.ReturnOnEquityTTM", "num"),
    "quarterly_revenue_growth_yoy": ("Highlights.QuarterlyRevenueGrowthYOY", "num"),
    "quarterly_earnings_growth_yoy": ("Highlights.QuarterlyEarningsGrowthYOY", "num"),
    "price_to_sales_ttm": ("Valuation.PriceSalesTTM", "num"), "price_to_book_mrq": ("Valuation.PriceBookMRQ", "num"),
    "enterprise_value": ("Valuation.EnterpriseValue", "num"), "ev_to_revenue": ("Valuation.EnterpriseValueRevenue", "num"),
    "ev_to_ebitda": ("Valuation.EnterpriseValueEbitda", "num"), "beta": ("Technicals.Beta", "num"),
}
PROFILE = {
    "name": ("General.Name", "text"), "cik": ("General.CIK", "text"), "cusip": ("General.CUSIP", "text"),
    "isin": ("General.ISIN", "text"), "lei": ("General.LEI", "text"), "stock_exchange": ("General.Exchange", "text"),
    "long_description": ("General.Description", "text"), "company_url": ("General.WebURL", "text"),
    "business_address": ("General.Address", "text"), "business_phone_no": ("General.Phone", "text"),
    "hq_address1": ("General.AddressData.Street", "text"), "hq_address_city": ("General.AddressData.City", "text"),
    "hq_state": ("General.AddressData.State", "text"), "hq_address_postal_code": ("General.AddressData.ZIP", "text"),
    "hq_country": ("General.AddressData.Country", "text"), "employees": ("General.FullTimeEmployees", "int"),
    "sector": ("General.Sector", "text"), "industry_category": ("General.Industry", "text"),
    "industry_group": ("General.GicGroup", "text"), "security_type": ("General.Type", "text"),
    "currency": ("General.CurrencyCode", "text"), "ipo_date": ("General.IPODate", "day"),
    "fiscal_year_end": ("General.FiscalYearEnd", "text"), "is_delisted": ("General.IsDelisted", "bool"),
    "updated_at": ("General.UpdatedAt", "day"),
}
SHARES = {
    "date": ("General.UpdatedAt", "day"), "outstanding_shares": ("SharesStats.SharesOutstanding", "num"),
    "float_shares": ("SharesStats.SharesFloat", "num"), "percent_insiders": ("SharesStats.PercentInsiders", "num"),
    "percent_institutions": ("SharesStats.PercentInstitutions", "num"),
    "shares_short": ("SharesStats.SharesShort|Technicals.SharesShort", "num"),
    "shares_short_prior_month": ("SharesStats.SharesShortPriorMonth|Technicals.SharesShortPriorMonth", "num"),
    "short_ratio": ("SharesStats.ShortRatio|Technicals.ShortRatio", "num"),
    "short_percent_float": ("SharesStats.ShortPercentFloat|Technicals.ShortPercent", "num"),
}
ETF = {
    "name": ("General.Name", "text"), "issuer": ("ETF_Data.Company_Name", "text"), "domicile": ("ETF_Data.Domicile", "text"),
    "website": ("ETF_Data.ETF_URL|ETF_Data.Company_URL", "text"), "description": ("General.Description", "text"),
    "inception_date": ("ETF_Data.Inception_Date", "day"), "isin": ("ETF_Data.ISIN", "text"),
    "index_name": ("ETF_Data.Index_Name", "text"), "dividend_yield": ("ETF_Data.Yield", "pct"),
    "net_expense_ratio": ("ETF_Data.NetExpenseRatio", "num"), "ongoing_charge": ("ETF_Data.Ongoing_Charge", "num"),
    "holdings_turnover": ("ETF_Data.AnnualHoldingsTurnover", "num"), "total_assets": ("ETF_Data.TotalAssets", "num"),
    "holdings_count": ("ETF_Data.Holdings_Count", "int"),
}
ESG = {
    "period_ending": ("ESGScores.RatingDate", "day"), "company_name": ("General.Name", "text"),
    "esg_score": ("ESGScores.TotalEsg", "num"), "environmental_score": ("ESGScores.EnvironmentScore", "num"),
    "social_score": ("ESGScores.SocialScore", "num"), "governance_score": ("ESGScores.GovernanceScore", "num"),
    "total_esg_percentile": ("ESGScores.TotalEsgPercentile", "num"),
    "environment_score_percentile": ("ESGScores.EnvironmentScorePercentile", "num"),
    "social_score_percentile": ("ESGScores.SocialScorePercentile", "num"),
    "governance_score_percentile": ("ESGScores.GovernanceScorePercentile", "num"),
    "controversy_level": ("ESGScores.ControversyLevel", "num"), "disclaimer": ("ESGScores.Disclaimer", "text"),
}
TARGET = {"name": ("General.Name", "text"), "target_consensus": ("AnalystRatings.TargetPrice", "num"),
          "rating": ("AnalystRatings.Rating", "num")}
GOVERNMENT = {
    "symbol": ("asset.symbol", "text"), "date": ("transaction.disclosure_date", "day"),
    "transaction_date": ("transaction.transaction_date", "day"), "representative": ("member.full_name", "text"),
    "chamber": ("chamber", "text"), "transaction_type": ("transaction.type", "text"), "owner": ("transaction.owner", "text"),
    "asset_description": ("asset.description", "text"), "asset_type": ("asset.asset_type", "text"),
    "amount_range": ("transaction.amount_range", "text"), "amount_low": ("transaction.amount_low", "num"),
    "amount_high": ("transaction.amount_high", "num"), "party": ("member.party", "text"), "state": ("member.state", "text"),
    "district": ("member.district", "text"), "days_to_disclose": ("transaction.days_to_disclose", "int"),
    "is_late": ("transaction.is_late", "bool"), "filing_url": ("source.filing_url", "text"),
}
INSIDER = {
    "owner_name": ("ownerName", "text"), "owner_title": ("ownerRelationship", "text"),
    "transaction_date": ("transactionDate", "day"), "filing_date": ("date", "day"),
    "transaction_type": ("transactionCode", "text"), "securities_transacted": ("transactionAmount", "num"),
    "transaction_price": ("transactionPrice", "num"), "acquisition_or_disposition": ("transactionAcquiredDisposed", "text"),
    "post_transaction_amount": ("postTransactionAmount", "num"), "filing_url": ("secLink", "text"),
}
QUOTE = {
    "last_price": ("close", "num"), "last_timestamp": ("timestamp", "epoch"), "open": ("open", "num"), "high": ("high", "num"),
    "low": ("low", "num"), "close": ("close", "num"), "volume": ("volume", "num"), "prev_close": ("previousClose", "num"),
    "change": ("change", "num"), "change_percent": ("change_p", "pct"),
}
SNAPSHOT = {
    "last_rate": ("close", "num"), "open": ("open", "num"), "high": ("high", "num"), "low": ("low", "num"),
    "close": ("close", "num"), "prev_close": ("previousClose", "num"), "change": ("change", "num"),
    "change_percent": ("change_p", "num"), "last_rate_time": ("timestamp", "epoch"),
}
SCREENER = {
    "name": ("name", "text"), "sector": ("sector", "text"), "industry": ("industry", "text"),
    "market_cap": ("market_capitalization", "num"), "price": ("adjusted_close", "num"), "eps": ("earnings_share", "num"),
    "dividend_yield": ("dividend_yield", "num"), "avg_volume_1d": ("avgvol_1d", "num"),
    "avg_volume_200d": ("avgvol_200d", "num"), "last_day_data_date": ("last_day_data_date", "day"),
}
SEARCH = {
    "name": ("Name", "text"), "security_type": ("Type", "text"), "country": ("Country", "text"), "currency": ("Currency", "text"),
    "isin": ("ISIN", "text"), "is_primary": ("isPrimary", "bool"), "previous_close": ("previousClose", "num"),
    "previous_close_date": ("previousCloseDate", "day"),
}
EARNINGS_CALENDAR = {
    "report_date": ("report_date", "day"), "eps_consensus": ("estimate", "num"), "eps_actual": ("actual", "num"),
    "period_ending": ("date", "day"), "announce_time": ("before_after_market", "text"), "currency": ("currency", "text"),
    "surprise": ("difference", "num"), "surprise_percent": ("percent", "num"),
}
IPO_CALENDAR = {
    "ipo_date": ("start_date", "day"), "name": ("name", "text"), "exchange": ("exchange", "text"), "currency": ("currency", "text"),
    "filing_date": ("filing_date", "day"), "amended_date": ("amended_date", "day"), "price_from": ("price_from", "pos"),
    "price_to": ("price_to", "pos"), "offer_price": ("offer_price", "pos"), "shares": ("shares", "pos"),
    "deal_type": ("deal_type", "text"),
}
DIVIDENDS = {
    "ex_dividend_date": ("date", "day"), "amount": ("value", "num"), "declaration_date": ("declarationDate", "day"),
    "record_date": ("recordDate", "day"), "payment_date": ("paymentDate", "day"), "frequency": ("period", "text"),
    "unadjusted_amount": ("unadjustedValue", "num"), "currency": ("currency", "text"),
}
EPS_HISTORY = {"date": ("date|reportDate", "day"), "eps_actual": ("epsActual", "num"),
               "eps_estimated": ("epsEstimate", "num"), "report_date": ("reportDate", "day")}
ESTIMATES = {
    "date": ("date", "day"), "estimated_eps_avg": ("earningsEstimateAvg", "num"), "estimated_eps_low": ("earningsEstimateLow", "num"),
    "estimated_eps_high": ("earningsEstimateHigh", "num"), "estimated_revenue_avg": ("revenueEstimateAvg", "num"),
    "estimated_revenue_low": ("revenueEstimateLow", "num"), "estimated_revenue_high": ("revenueEstimateHigh", "num"),
    "number_analysts_estimated_eps": ("earningsEstimateNumberOfAnalysts", "int"),
    "number_analyst_estimated_revenue": ("revenueEstimateNumberOfAnalysts", "int"),
}
FORWARD_EPS = {
    "date": ("date", "day"), "fiscal_period": ("period", "text"), "mean": ("earningsEstimateAvg", "num"),
    "low_estimate": ("earningsEstimateLow", "num"), "high_estimate": ("earningsEstimateHigh", "num"),
    "number_of_analysts": ("earningsEstimateNumberOfAnalysts", "int"),
}
HOLDERS = {
    "date": ("date", "day"), "name": ("name", "text"), "total_shares_percent": ("totalShares", "num"),
    "total_assets_percent": ("totalAssets", "num"), "current_shares": ("currentShares", "num"), "change": ("change", "num"),
    "change_percent": ("change_p", "num"),
}
EVENTS = {
    "country": ("country", "text"), "event": ("type", "text"), "consensus": ("estimate", "num"), "previous": ("previous", "num"),
    "actual": ("actual", "num"), "comparison": ("comparison", "text"), "period": ("period", "text"), "change": ("change", "num"),
    "change_percentage": ("change_percentage", "num"),
}
INCOME = {
    "totalRevenue": "revenue", "costOfRevenue": "cost_of_revenue", "grossProfit": "gross_profit",
    "researchDevelopment": "research_and_development_expense",
    "sellingGeneralAdministrative": "selling_general_and_administrative_expense",
    "totalOperatingExpenses": "total_operating_expenses", "operatingIncome": "operating_income", "ebit": "ebit",
    "ebitda": "ebitda", "depreciationAndAmortization": "depreciation_and_amortization",
    "interestExpense": "interest_expense", "interestIncome": "interest_income", "incomeBeforeTax": "income_before_tax",
    "incomeTaxExpense": "income_tax_expense", "netIncome": "net_income",
    "netIncomeApplicableToCommonShares": "net_income_to_common",
}
BALANCE = {
    "totalAssets": "total_assets", "totalCurrentAssets": "total_current_assets",
    "cashAndEquivalents": "cash_and_cash_equivalents", "cashAndShortTermInvestments": "cash_and_short_term_investments",
    "netReceivables": "net_receivables", "inventory": "inventory",
    "propertyPlantAndEquipmentNet": "property_plant_equipment_net", "goodWill": "goodwill",
    "intangibleAssets": "intangible_assets", "totalLiab": "total_liabilities",
    "totalCurrentLiabilities": "total_current_liabilities", "accountsPayable": "accounts_payable",
    "shortTermDebt": "short_term_debt", "longTermDebt": "long_term_debt", "shortLongTermDebtTotal": "total_debt",
    "netDebt": "net_debt", "totalStockholderEquity": "total_shareholders_equity", "retainedEarnings": "retained_earnings",
    "commonStock": "common_stock", "commonStockSharesOutstanding": "common_shares_outstanding",
}
CASHFLOW = {
    "totalCashFromOperatingActivities": "net_cash_from_operating_activities",
    "totalCashflowsFromInvestingActivities": "net_cash_from_investing_activities",
    "totalCashFromFinancingActivities": "net_cash_from_financing_activities", "capitalExpenditures": "capital_expenditure",
    "freeCashFlow": "free_cash_flow", "depreciation": "depreciation_and_amortization",
    "stockBasedCompensation": "stock_based_compensation", "dividendsPaid": "dividends_paid", "netIncome": "net_income",
    "changeInCash": "net_change_in_cash", "beginPeriodCashFlow": "cash_at_beginning_of_period",
    "endPeriodCashFlow": "cash_at_end_of_period",
}
STATEMENTS = {"income": ("Income_Statement", INCOME), "balance": ("Balance_Sheet", BALANCE), "cash": ("Cash_Flow", CASHFLOW)}
#: Country profile field to indicator (fixed values).
PROFILE_INDICATORS = {
    "population": "population_total", "gdp_usd": "gdp_current_usd", "gdp_yoy": "gdp_growth_annual",
    "cpi_yoy": "inflation_consumer_prices_annual", "jobless_rate": "unemployment_total_percent",
    "govt_debt_gdp": "debt_percent_gdp",
}
ASSETS = "https://assets.example.com"

#: Texts of any length are read; the reader's own limit is 20 million characters.
WHOLE = {"mode": "PERMISSIVE", "maxStringLen": str(2 ** 31 - 1)}
#: A news story's fields, where no variant holds it.
STORY = ("struct<date string, title string, content string, link string, symbols array<string>, tags array<string>, "
         "sentiment map<string,double>>")

# --- reading ---------------------------------------------------------------------------------


def value(text: Column, kind: str) -> Column:
    """A provider's text as the kind of its field."""
    return {"text": lambda t: t, "num": x.number, "int": x.whole, "day": x.day, "pct": x.percent,
            "bool": lambda t: t.try_cast("boolean"), "pos": lambda t: F.nullif(x.number(t), F.lit(0.0)),
            "epoch": lambda t: F.timestamp_seconds(F.nullif(x.number(t), F.lit(0.0)))}[kind](text)


def _first(values: list[Column], kind: str) -> Column:
    """The first value that is not null or zero-like; the last one as it is."""
    found, *others = values
    for other in others:
        empty = F.lit(0.0) if kind == "num" else F.lit("")
        found = F.coalesce(F.nullif(found, empty) if kind in ("num", "text") else found, other)
    return found


def field(doc: Column, path: str, kind: str) -> Column:
    """One value of a variant; `a|b` reads b where a is null or zero-like."""
    steps = ["".join(f"['{s}']" for s in one.split(".")) for one in path.split("|")]
    return _first([value(F.try_variant_get(doc, f"${s}", "string"), kind) for s in steps], kind)


def pick(landed: DataFrame, fields: dict[str, tuple[str, str]], doc: str = "doc") -> DataFrame:
    """`symbol` and the mapped fields of each document."""
    return landed.select("symbol", *[field(F.col(doc), p, k).alias(o) for o, (p, k) in fields.items()])


def _type(paths: list[list[str]]) -> str:
    """The type, all texts, of what lies at the paths."""
    tree: dict[str, list[list[str]]] = {}
    for step, *rest in paths:
        tree.setdefault(step, []).append(rest)
    return "struct<" + ",".join(f"`{s}`:" + (_type(below) if all(below) else "string") for s, below in tree.items()) + ">"


def pick_all(landed: DataFrame, fields: dict[str, tuple[str, str]], doc: str = "doc", where: Column | None = None) -> DataFrame:
    """`pick` for wide maps, of the documents that `where` holds for: all texts are read in one
    walk of a document, and a filter on the document or the result reads no document again."""
    paths = [one.split(".") for p, _ in fields.values() for one in p.split("|")]
    texts = F.array(F.try_variant_get(F.col(doc), "$", _type(paths)))
    # Filters do not move below a generator, so what they ask is read once.
    read = landed.select("symbol", F.explode(texts if where is None else F.when(where, texts)).alias("_texts"))

    def at(one: str) -> Column:
        found = F.col("_texts")
        for step in one.split("."):
            found = found[step]
        return found

    return read.select("symbol", *[_first([value(at(one), k) for one in p.split("|")], k).alias(o) for o, (p, k) in fields.items()])


def documents(landed: DataFrame) -> DataFrame:
    return landed.select(F.upper("symbol").alias("symbol"), F.parse_json("payload").alias("doc"))


def _listed(members: Column) -> Column:
    return F.transform(members, lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))


def _members(text: Column, kind: str) -> Column:
    """`key, value` of each member of a list or a keyed object, read leniently; values are of type `kind`."""
    as_list, as_map = F.from_json(text, f"array<{kind}>", WHOLE), F.from_json(text, f"map<string,{kind}>", WHOLE)
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), _listed(as_list)).otherwise(F.map_entries(as_map))


def entries(landed: DataFrame, section: str | None = None, plain: str | None = None) -> DataFrame:
    """One row per member of a section that is a list or a keyed object: `symbol, key, doc`.

    A variant holds 128 MiB. With `plain`, a struct type, the members of bodies that no variant
    can be made of come in a column `plain` of that type, and all others in `doc`.
    """
    text = F.col("payload") if section is None else F.get_json_object("payload", f"$.{section}")
    # A body is parsed once. What that finds no member in (a key written twice, a section that
    # is text or cut off) is read leniently from the section's text.
    path = "$" if section is None else "$" + "".join(f"['{s}']" for s in section.split("."))
    landed = landed.select("symbol", "payload", F.from_json("payload", "variant", WHOLE).alias("_doc"))
    members = F.coalesce(F.map_entries(F.try_variant_get("_doc", path, "map<string,variant>")),
                         _listed(F.try_variant_get("_doc", path, "array<variant>")), _members(text, "variant"))
    out = [F.col("_m.key").alias("key"), F.col("_m.value").alias("doc")]
    if plain:
        def row(m, doc, rest):
            return F.struct(m["key"].alias("key"), doc.cast("variant").alias("value"), rest.cast(plain).alias("plain"))

        members = F.coalesce(F.transform(members, lambda m: row(m, m["value"], F.lit(None))),
                             F.transform(_members(text, plain), lambda m: row(m, F.lit(None), m["value"])))
        out.append(F.col("_m.plain").alias("plain"))
    return landed.select(F.upper("symbol").alias("symbol"), F.explode(members).alias("_m")).select("symbol", *out)


# --- bundles ------------------------------------------------------------------------------------


def statements(landed: DataFrame, statement: str = "income", period: str = "annual", limit: int | None = None) -> DataFrame:
    """Long statement rows `symbol, period_ending, fiscal_year, fiscal_period, item, value, text`.

    The newest `limit` periods per symbol. Known items are renamed, others snake-cased;
    a value that is no number keeps its text.
    """
    section, names = STATEMENTS[statement]
    bucket = "yearly" if period == "annual" else "quarterly"
    # one parse of a body serves both paths
    head = documents(landed).select("symbol", F.try_variant_get("doc", "$.General.FiscalYearEnd", "string").alias("_fye"),
                                    F.explode(F.try_variant_get("doc", f"$.Financials.{section}.{bucket}",
                                                                "map<string,map<string,string>>")).alias("_key", "_items"))
    head = head.withColumn("_date", F.try_element_at("_items", F.lit("date")))
    if limit:
        from marketloom.operators.topk import newest

        # a period's items are ranked as one text, a fraction of their map in the sort's memory
        packed = head.select("symbol", "_fye", "_date", F.to_json("_items").alias("_items"))
        kept = newest(packed, limit, ("symbol",), (F.col("_date").desc_nulls_last(),)).drop("rank")
        head = kept.withColumn("_items", F.from_json("_items", "map<string,string>"))
    month = x.fiscal_month(F.col("_fye"))
    head = head.withColumn("period_ending", x.day(F.col("_date"))).filter("period_ending is not null")
    quarter = F.concat(F.lit("Q"), x.fiscal_quarter(F.col("period_ending"), month))
    items = head.select("symbol", "period_ending", x.fiscal_year(F.col("period_ending"), month).alias("fiscal_year"),
                        (F.lit("FY") if period == "annual" else quarter).alias("fiscal_period"),
                        F.explode("_items").alias("_item", "_text"))
    # a text is read as a number once; what holds no number is not tried
    known = (items.filter(~F.col("_item").isin("date", "filing_date", "currency_symbol"))
             .withColumn("value", x.double(F.col("_text"))))
    return known.select("symbol", "period_ending", "fiscal_year", "fiscal_period",
                        F.coalesce(x.lookup(names, F.col("_item")), x.snake(F.col("_item"))).alias("item"), "value",
                        F.when(F.col("value").isNull(), F.nullif("_text", F.lit(""))).alias("text"))


def key_metrics(landed: DataFrame) -> DataFrame:
    has = F.try_variant_get("doc", "$.Highlights", "variant").isNotNull() | F.try_variant_get(
        "doc", "$.Valuation", "variant").isNotNull()
    return pick_all(documents(landed), METRICS, where=has).withColumn("fiscal_period", F.lit("TTM"))


def share_statistics(landed: DataFrame) -> DataFrame:
    has = F.try_variant_get("doc", "$.SharesStats", "variant").isNotNull()
    out = pick_all(documents(landed), SHARES, where=has)
    free = F.when((F.col("float_shares") != 0) & (F.col("outstanding_shares") != 0),
                  F.round(F.col("float_shares") / F.col("outstanding_shares") * 100, 4))
    return out.withColumn("free_float", free)


def profile(landed: DataFrame) -> DataFrame:
    """Company profile; the chief executive is the first officer whose title says so."""
    logo = F.col("logo_url")
    out = pick_all(documents(landed), PROFILE | {"logo_url": ("General.LogoURL", "text")}).withColumn(
        "logo_url", F.when(F.startswith(logo, F.lit("/")), F.concat(F.lit(ASSETS), logo)).otherwise(logo))
    boss = (entries(landed, "General.Officers").withColumn("_n", F.col("key").try_cast("int"))
            .filter(F.contains(F.upper(field(F.col("doc"), "Title", "text")), F.lit("CEO")))
            .groupBy("symbol").agg(F.min_by(field(F.col("doc"), "Name", "text"), "_n").alias("ceo")))
    return out.join(boss, "symbol", "left")


def executives(landed: DataFrame) -> DataFrame:
    out = pick(entries(landed, "General.Officers"), {"name": ("Name", "text"), "title": ("Title", "text"),
                                                     "year_born": ("YearBorn", "int")})
    return out.filter("name <> '' and title <> ''")


def eps_history(landed: DataFrame) -> DataFrame:
    return pick(entries(landed, "Earnings.History"), EPS_HISTORY).filter("date is not null")


def estimates(landed: DataFrame) -> DataFrame:
    return pick(entries(landed, "Earnings.Trend"), ESTIMATES).filter("date is not null")


def forward_eps(landed: DataFrame) -> DataFrame:
    return pick(entries(landed, "Earnings.Trend"), FORWARD_EPS).filter("date is not null")


def price_target(landed: DataFrame) -> DataFrame:
    return pick_all(documents(landed), TARGET).filter("target_consensus <> 0")


def institutional_ownership(landed: DataFrame) -> DataFrame:
    """Dated positions with their rank by shares held among the symbol's, nulls as zero, ties by name.

    The places come from one sort of all rows, so a symbol of many holders is no task of its own.
    """
    from marketloom.operators.topk import placed

    held = pick(entries(landed, "Holders.Institutions"), HOLDERS).filter("date is not null")
    order = {"symbol": F.col("symbol"), "_weight": -F.coalesce("current_shares", F.lit(0.0)), "name": F.col("name"), "date": F.col("date")}
    rows = placed(held.withColumn("_weight", order["_weight"]), [F.col(c).asc_nulls_first() for c in order], "_place")
    first = rows.groupBy("symbol").agg(F.min("_place").alias("_first"))
    ties = Window.partitionBy(*order)  # positions alike in all of these share a rank
    return rows.withColumn("_place", F.min("_place").over(ties)).join(first, "symbol").select(
        *held.columns, (F.col("_place") - F.col("_first") + 1).alias("rank"))


def ownership(landed: DataFrame) -> DataFrame:
    both = entries(landed, "Holders.Institutions").unionByName(entries(landed, "Holders.Funds"))
    return (pick(both, HOLDERS).filter("date is not null and name <> ''")
            .select("symbol", F.col("name").alias("investor_name"), "date", F.col("date").alias("filing_date"),
                    "current_shares", "total_shares_percent"))


def insider_trades(landed: DataFrame) -> DataFrame:
    docs = entries(landed)
    code = field(F.col("doc"), "code", "text")
    return pick(docs.withColumn("symbol", F.upper(F.coalesce(F.nullif(code, F.lit("")), "symbol"))), INSIDER)


def government_trades(landed: DataFrame) -> DataFrame:
    docs = entries(landed)
    out = docs.select(*[field(F.col("doc"), p, k).alias(o) for o, (p, k) in GOVERNMENT.items()])
    return out.withColumn("symbol", F.nullif("symbol", F.lit(""))).filter("date is not null")


def etf_info(landed: DataFrame) -> DataFrame:
    return pick_all(documents(landed), ETF)


def etf_holdings(landed: DataFrame) -> DataFrame:
    docs = entries(landed, "ETF_Data.Holdings")
    return docs.select(F.upper("symbol").alias("fund"), F.nullif(F.upper("key"), F.lit("")).alias("symbol"),
                       *[field(F.col("doc"), p, k).alias(o) for o, (p, k) in {
                           "name": ("Name", "text"), "weight": ("Assets_%", "pct"), "sector": ("Sector", "text"),
                           "industry": ("Industry", "text"), "country": ("Country", "text"), "region": ("Region", "text")}.items()])


def etf_weights(landed: DataFrame, section: str = "Sector_Weights", name: str = "sector") -> DataFrame:
    """Sector or region weights as fractions; members without a weight drop."""
    docs = entries(landed, f"ETF_Data.{section}")
    return docs.select("symbol", F.col("key").alias(name), field(F.col("doc"), "Equity_%", "pct").alias("weight")).filter(
        "weight is not null")


def esg(landed: DataFrame) -> DataFrame:
    out = pick_all(documents(landed), ESG).filter("esg_score is not null")
    return out.withColumn("disclosure_date", F.col("period_ending"))


def symbol_meta(landed: DataFrame) -> DataFrame:
    """Name, logo, yearly range and feed of each symbol; sentinels are null."""
    from marketloom.functions.classify import feed_of

    docs = documents(landed)
    logo = x.clean(field(F.col("doc"), "General::LogoURL", "text"))
    return docs.select("symbol", x.clean(field(F.col("doc"), "General::Name", "text")).alias("name"),
                       F.when(F.startswith(logo, F.lit("/")), F.concat(F.lit(ASSETS), logo)).otherwise(logo).alias("logo_url"),
                       field(F.col("doc"), "Technicals::52WeekHigh", "num").alias("week52_high"),
                       field(F.col("doc"), "Technicals::52WeekLow", "num").alias("week52_low"),
                       feed_of(F.col("symbol")).alias("asset_class"))


def cached_bundles(cache: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """The newest bundle per symbol that is still fresh."""
    newest = latest(cache, ("symbol",), (F.col("fetched_at").desc(),))
    return newest.filter(F.col("fetched_at") >= now - F.expr(f"INTERVAL {int(ttl_hours)} HOURS"))


# --- lists ---------------------------------------------------------------------------------------


def provider_bars(landed: DataFrame, intraday: bool = False) -> DataFrame:
    """Bars with a close and a readable date; intraday stamps are epoch seconds in UTC."""
    docs = entries(landed)
    fields = {c: (c, "num") for c in ("open", "high", "low", "close", "volume")} | {"adjusted_close": ("adjusted_close", "num")}
    at = field(F.col("doc"), "timestamp", "epoch") if intraday else field(F.col("doc"), "date", "day")
    out = docs.select("symbol", at.alias("date"), *[field(F.col("doc"), p, k).alias(o) for o, (p, k) in fields.items()])
    return out.filter("close is not null and date is not null")


def dividends(landed: DataFrame) -> DataFrame:
    return pick(entries(landed), DIVIDENDS).filter("ex_dividend_date is not null")


def splits(landed: DataFrame) -> DataFrame:
    docs = entries(landed)
    num, den = x.split_parts(field(F.col("doc"), "split", "text"))
    out = docs.select("symbol", field(F.col("doc"), "date", "day").alias("date"), num.alias("numerator"), den.alias("denominator"))
    return out.filter("date is not null and numerator is not null and denominator is not null").withColumn(
        "split_ratio", F.concat_ws(":", x.short(F.col("numerator")), x.short(F.col("denominator"))))


def split_calendar(landed: DataFrame) -> DataFrame:
    """Announced splits; a row without a date, a symbol or positive shares cannot stand."""
    docs = entries(landed)
    d = F.col("doc")
    out = docs.select(F.upper(field(d, "code", "text")).alias("symbol"), field(d, "split_date", "day").alias("date"),
                      field(d, "new_shares", "pos").alias("numerator"), field(d, "old_shares", "pos").alias("denominator"),
                      field(d, "optionable", "text").alias("optionable"))
    return out.filter("date is not null and symbol <> '' and numerator is not null and denominator is not null")


def earnings_calendar(landed: DataFrame) -> DataFrame:
    docs = entries(landed).withColumn("symbol", F.upper(field(F.col("doc"), "code", "text")))
    return pick(docs, EARNINGS_CALENDAR).filter("symbol <> '' and report_date is not null")


def ipo_calendar(landed: DataFrame, symbol: str | None = None) -> DataFrame:
    docs = entries(landed).withColumn("symbol", F.nullif(F.upper(field(F.col("doc"), "code", "text")), F.lit("")))
    if symbol:
        docs = docs.filter(F.substring_index("symbol", ".", 1) == symbol.upper().split(".")[0])
    return pick(docs, IPO_CALENDAR)


def market_caps(landed: DataFrame) -> DataFrame:
    return pick(entries(landed), {"date": ("date", "day"), "market_cap": ("value", "num")}).filter(
        "date is not null and market_cap is not null")


def classify_events(events: DataFrame, taxonomy: DataFrame, event: str = "event") -> DataFrame:
    """Source and category of each event name: exact, else ignoring case, else null.

    `taxonomy(source, category, event)` is a dimension; Spark broadcasts it when its
    own size says so.
    """
    exact = taxonomy.select(F.col("event").alias(event), F.struct("source", "category").alias("_exact")).dropDuplicates([event])
    folded = (taxonomy.groupBy(F.lower("event").alias("_low"))
              .agg(F.max_by(F.struct("source", "category"), "event").alias("_fold")))
    best = F.coalesce("_exact", "_fold")
    return (events.join(exact, event, "left").join(folded, F.lower(event) == F.col("_low"), "left")
            .withColumns({"source": best["source"], "category": best["category"]}).drop("_exact", "_fold", "_low"))


def economic_calendar(landed: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Releases with their classification; windows that overlap give each release once."""
    docs = entries(landed)
    at = F.try_to_timestamp(field(F.col("doc"), "date", "text"))
    rows = docs.select(at.alias("date"), *[field(F.col("doc"), p, k).alias(o) for o, (p, k) in EVENTS.items()])
    return classify_events(rows.dropDuplicates(), taxonomy)


def news(landed: DataFrame) -> DataFrame:
    """Stories with a date and a title; the body stays whole, however long, the excerpt is its
    first 280 characters; an empty body is null."""
    docs = entries(landed, plain=STORY)

    def part(name: str, kind: str = "string") -> Column:
        return F.coalesce(F.try_variant_get("doc", f"$.{name}", kind), F.col(f"plain.{name}"))

    body = F.nullif(part("content"), F.lit(""))
    tags = {c: part(c, "array<string>") for c in ("symbols", "tags")}
    return docs.select(part("date").alias("date"), part("title").alias("title"), body.alias("body"),
                       x.excerpt(body).alias("excerpt"), part("link").alias("url"),
                       *[F.when(F.size(v) > 0, v).alias(n) for n, v in tags.items()],
                       part("sentiment", "map<string,double>").alias("sentiment")).filter(
        "date <> '' and title <> ''")


def currency_pairs(landed: DataFrame, text: str = "") -> DataFrame:
    docs = entries(landed)
    out = docs.select(F.upper(field(F.col("doc"), "Code", "text")).alias("symbol"),
                      F.nullif(field(F.col("doc"), "Name", "text"), F.lit("")).alias("name"),
                      x.clean(field(F.col("doc"), "Currency", "text")).alias("currency"))
    return _search(out.filter("symbol <> ''"), text)


def index_list(landed: DataFrame, text: str = "") -> DataFrame:
    docs = entries(landed)
    d = F.col("doc")
    out = docs.select(F.upper(field(d, "Code", "text")).alias("code"), F.nullif(field(d, "Name", "text"), F.lit("")).alias("name"),
                      F.nullif(field(d, "Currency", "text"), F.lit("")).alias("currency"),
                      x.clean(field(d, "Country", "text")).alias("country")).filter("code <> ''")
    found = _search(out.withColumnRenamed("code", "symbol"), text)
    return found.withColumn("symbol", F.concat("symbol", F.lit(".INDX")))


def _search(rows: DataFrame, text: str) -> DataFrame:
    needle = F.lit(text.upper())
    return rows.filter(F.contains(F.upper("symbol"), needle) | F.coalesce(F.contains(F.upper("name"), needle), F.lit(False)))


def currency_snapshots(landed: DataFrame, base: str, direct: bool = True) -> DataFrame:
    docs = entries(landed)
    pair = F.substring_index(field(F.col("doc"), "code", "text"), ".", 1)
    rows = docs.withColumn("symbol", x.counter_of(pair, F.lit(base.upper()), direct))
    return pick(rows, SNAPSHOT).withColumnRenamed("symbol", "counter_currency").withColumn("base_currency", F.lit(base.upper()))


def _exchange_symbol(code: str, exchange: str) -> Column:
    return F.upper(F.trim(F.concat_ws(".", field(F.col("doc"), code, "text"), F.nullif(field(F.col("doc"), exchange, "text"), F.lit("")))))


def screener(landed: DataFrame) -> DataFrame:
    docs = entries(landed).filter(field(F.col("doc"), "code", "text") != "")
    rows = docs.withColumns({"symbol": _exchange_symbol("code", "exchange")})
    return rows.select("symbol", F.nullif(field(F.col("doc"), "exchange", "text"), F.lit("")).alias("exchange"),
                       *[field(F.col("doc"), p, k).alias(o) for o, (p, k) in SCREENER.items()])


#: Screener parameter -> (column, comparison) (fixed values).
SCREENS = {
    "exchange": ("exchange", "="), "sector": ("sector", "="), "industry": ("industry", "="),
    "market_cap_min": ("market_cap", ">="), "market_cap_max": ("market_cap", "<="), "price_min": ("price", ">="),
    "price_max": ("price", "<="), "dividend_yield_min": ("dividend_yield", ">="), "volume_min": ("avg_volume_1d", ">="),
}


def screen(rows: DataFrame, sort: str = "market_cap", descending: bool = True, limit: int = 50, offset: int = 0, **wanted) -> DataFrame:
    """Conjunction of the given filters, sorted, paged."""
    for name, value in wanted.items():
        column, op = SCREENS[name]
        if value is not None:
            c = F.col(column)
            rows = rows.filter(c == value if op == "=" else c >= value if op == ">=" else c <= value)
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.orderBy(order, "symbol").offset(offset).limit(limit)


def quotes(landed: DataFrame) -> DataFrame:
    docs = entries(landed)
    code = F.nullif(field(F.col("doc"), "code", "text"), F.lit(""))
    return pick(docs.withColumn("symbol", F.upper(F.coalesce(code, "symbol"))), QUOTE)


def search_rows(landed: DataFrame) -> DataFrame:
    rows = entries(landed).withColumn("symbol", _exchange_symbol("Code", "Exchange"))
    return rows.select("symbol", F.nullif(field(F.col("doc"), "Exchange", "text"), F.lit("")).alias("exchange"),
                       *[field(F.col("doc"), p, k).alias(o) for o, (p, k) in SEARCH.items()])


# --- macro ------------------------------------------------------------------------------------------


def macro_series(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """`country, indicator, date, value` within the window, country codes resolved."""
    out = rows.filter("value is not null and date is not null").withColumn("country", x.country(F.col("country")))
    if start:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    return out.filter(F.col("date") <= F.lit(end).cast("date")) if end else out


#: Consumer price transform to indicator (fixed values).
CPI = {"yoy": "inflation_consumer_prices_annual", "index": "consumer_price_index"}


def country_profile(series: DataFrame, indicators: dict[str, str] | None = None) -> DataFrame:
    """Newest value per country and indicator, one column each; a missing one is null."""
    wanted = indicators or PROFILE_INDICATORS
    newest = series.filter(F.col("indicator").isin(*wanted.values())).groupBy("country", "indicator").agg(
        F.max_by("value", "date").alias("value"))
    wide = newest.groupBy("country").pivot("indicator", list(wanted.values())).agg(F.first("value"))
    return wide.select("country", *[F.col(f"`{i}`").alias(f) for f, i in wanted.items()])


def treasury_rates(rows: DataFrame) -> DataFrame:
    """`date, tenor, rate` in percent to one row per date with a fraction per maturity."""
    named = rows.withColumn("maturity", x.lookup(x.TENORS, F.col("tenor"))).filter(
        "maturity is not null and date is not null and rate is not null")
    return named.groupBy("date").pivot("maturity", list(x.TENORS.values())).agg(F.first(F.col("rate") / 100))


def yield_curve(rates: DataFrame, wanted: DataFrame) -> DataFrame:
    """Long curve as of each wanted date, in maturity order; `month_4` has no slot."""
    names = [m for m in x.TENORS.values() if m != "month_4"]
    facts = rates.select(F.lit("curve").alias("curve"), F.col("date").cast("timestamp").alias("time"),
                         F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("maturity"), F.col(m).alias("rate"))
                                   for i, m in enumerate(names)]).alias("points"))
    asked = wanted.select(F.lit("curve").alias("curve"), F.col("wanted").cast("timestamp").alias("time")).distinct()
    # curves are daily: a bucket holds a year of them, and the key's carry a row per year
    hit = asof.backward(asked, facts, ("curve",), "time", None, Layout(bucket_seconds=365 * 86400))
    return (hit.filter("fact_time is not null")
            .select(F.to_date("time").alias("wanted"), F.to_date("fact_time").alias("date"), F.inline("points"))
            .filter("rate is not null"))


def trailing_yield(bars: DataFrame, paid: DataFrame, limit: int | None = None) -> DataFrame:
    """Dividends of the last 365 days over close; with a limit, the newest rows per symbol."""
    from marketloom.operators.topk import newest

    priced = bars.filter("close <> 0")
    out = asof.trailing_sum(priced, paid, 365).withColumn("trailing_dividend_yield", F.col("trailing") / F.col("close"))
    if limit is not None:
        out = newest(out, limit, ("symbol",), (F.col("date").desc(),))
    return out.select("symbol", "date", "trailing_dividend_yield")
