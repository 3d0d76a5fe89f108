"""The worked bitemporal scenarios: boundary instants, identity answers, differences."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from marketloom.operators import identity, promotion, temporal
from marketloom.operators.temporal import parse_context

PX = ("listing_id string, market_date string, close double, available_at string, system_from string, system_to string, observed_at string, "
      "assertion_id string, assertion_status string, supersedes_assertion_id string")


def stamps(df):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in df.columns if c.endswith(("_at", "_from", "_to"))})


@pytest.fixture(scope="module")
def prices(spark):
    a, b = "2026-09-14 20:05:00", "2026-09-15 09:20:00"
    return stamps(spark.createDataFrame([
        ("l", "2026-09-14", 231.4, a, a, None, a, "p1", "current", None),
        ("l", "2026-09-14", 231.4, a, b, b, a, "p1", "superseded", None),
        ("l", "2026-09-14", 231.74, b, b, None, b, "p2", "current", "p1")], PX))


@pytest.mark.parametrize("context,want", [
    ({"mode": "known_at", "known_at": "2026-09-14T20:05:00Z"}, [231.4]),
    ({"mode": "known_at", "known_at": "2026-09-15T09:19:59.999999Z"}, [231.4]),
    ({"mode": "known_at", "known_at": "2026-09-15T09:20:00Z"}, [231.74]),
    ({"mode": "known_at", "known_at": "2026-09-14T20:04:59Z"}, []),
    (None, [231.74]),
    ({"mode": "delta_snapshot"}, [231.4, 231.74]),
    ({"mode": "captured_by", "known_at": "2026-09-15T00:00:00Z"}, [231.4])])
def test_trade_correction(prices, context, want):
    got = temporal.assertions(prices, parse_context(context), False).collect()
    assert sorted(r.close for r in got) == want


def test_context_is_checked():
    for bad in ({"mode": "x"}, {"mode": "known_at"}, {"mode": "known_at", "known_at": "2024-01-01"}, {"mode": "effective_on"},
                {"availability_policy": "other"}, {"versions": {"a": "b"}}):
        with pytest.raises(ValueError):
            parse_context(bad)


def test_compare_calls_it_a_correction(prices):
    a, b = parse_context({"mode": "known_at", "known_at": "2026-09-14T21:00:00Z"}), parse_context()
    out = identity.compare(temporal.assertions(prices, a, False), temporal.assertions(prices, b, False), ("listing_id", "market_date"), a, b)
    got = {r.field: r.classification for r in out.collect()}
    assert got["close"] == "corrected"


def make_silver(spark):
    iv = ("effective_from string, effective_to string, observed_at string, available_at string, system_from string, system_to string, "
          "capture_id string, assertion_id string, assertion_status string, supersedes_assertion_id string")
    t = "2020-01-01"

    def rel(cols, rows):
        return stamps(spark.createDataFrame([(*r[0], r[1], r[2], t, t, t, None, "c", r[3], "current", None) for r in rows], f"{cols}, {iv}"))

    lst = ("listing_id string, instrument_id string, issuer_id string, security_id string, exchange_id string, mic string, symbol string, provider_symbol string, "
           "currency string, status string, name string, instrument_type string")
    row = lambda sym: ("lst_1", "ins_1", "iss_1", "sec_1", "x", "X", sym, sym, "USD", "s", "Name", "stock")
    ids = "identifier_type string, identifier string, listing_id string, instrument_id string, security_id string, issuer_id string"
    return {
        "listings": rel(lst, [(row("OLD"), t, "2022-01-01", "l1"), (row("NEW"), "2022-01-01", None, "l2")]),
        "issuers": rel("issuer_id string, name string", [(("iss_1", "Issuer"), t, None, "i1")]),
        "instruments": rel("instrument_id string, issuer_id string, name string, instrument_type string", [(("ins_9", "iss_1", "n", "stock"), t, None, "n9")]),
        "securities": rel("security_id string, instrument_id string, issuer_id string, cusip string, predecessor_security_id string, successor_security_id string",
                          [(("sec_1", "ins_1", "iss_1", "C1", None, "sec_2"), t, None, "s1"), (("sec_8", "ins_8", "iss_1", "C8", None, None), t, None, "s8")]),
        "identifiers": rel(ids, [(("ticker", "OLD", "lst_1", "ins_1", "sec_1", None), t, "2022-01-01", "d1"), (("ticker", "NEW", "lst_1", "ins_1", "sec_1", None), "2022-01-01", None, "d2"),
                                 (("isin", "DUP", "lst_1", None, "sec_1", None), t, None, "d3"), (("isin", "DUP", "lst_2", None, "sec_2", None), t, None, "d4")]),
    }


def ask(spark, silver, context, history, *names):
    df = spark.createDataFrame([(n, n, None) for n in names], "request string, identifier string, identifier_type string")
    out = identity.resolve(df, silver, parse_context(context), history).collect()
    return sorted((r.request, r.listing_id, r.symbol, r.reason, r.status) for r in out)


def test_resolution(spark):
    silver = make_silver(spark)
    assert ask(spark, silver, None, True, "NEW", "OLD", "nobody", "sec_8", "lst_1") == [
        ("NEW", "lst_1", "NEW", "active", "resolved"), ("OLD", "lst_1", "NEW", "historical_alias", "resolved"),
        ("lst_1", "lst_1", "NEW", "active", "resolved"), ("nobody", None, None, None, "unresolved"), ("sec_8", None, None, "active", "resolved")]
    assert ask(spark, silver, None, False, "OLD") == [("OLD", None, None, None, "none_live")]
    assert {r[4] for r in ask(spark, silver, None, True, "DUP")} == {"ambiguous"}
    at = {"mode": "effective_on", "effective_at": "2021-01-01T00:00:00Z"}
    assert ask(spark, silver, at, True, "OLD") == [("OLD", "lst_1", "OLD", "active", "resolved")]
    assert ask(spark, silver, at, True, "NEW") == [("NEW", None, None, None, "not_effective")]
    assert {r[4] for r in ask(spark, silver, at, True, "DUP")} == {"resolved"}


def test_binding():
    assert identity.bind("EquityHistorical", {"symbol": "A", "start_date": "2024-01-01", "end_date": "2024-01-02"})["start_date"] == date(2024, 1, 1)
    for model, bad in (("EquityInfo", {}), ("EquityInfo", {"symbol": "A", "x": 1}), ("MarketCalendar", {"start_date": "bad", "end_date": "2024-01-01"}),
                       ("MarketCalendar", {"start_date": "2024-01-01", "end_date": "2024-01-01", "include_closed": "yes"})):
        with pytest.raises(ValueError):
            identity.bind(model, bad)


def test_payload_shapes(spark):
    df = spark.createDataFrame([('{"results": []}',), ('{"results": {"ExchangeHolidays": {}}}',), ("{bad",), ('{"results": "x"}',)], "p string")
    got = df.select(promotion.well_formed(F.col("p"), "price_daily").alias("a"), promotion.well_formed(F.col("p"), "exchange_calendar").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, False), (False, True), (False, False), (False, False)]
    land = spark.createDataFrame([("cal", "cap", "2024-01-01", '{"results":{"ExchangeHolidays":{"0":{"Date":"2024-07-03","Holiday":"Eve","Type":"Half_Day"},"1":{"Date":"x"}}}}')],
                                 "calendar_id string, capture_id string, observed_at string, payload string").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    rows = promotion.exchange_holidays(land).collect()
    assert [(str(r.session_date), r.market_effect, r.special_close) for r in rows] == [("2024-07-03", "early_close", True)]


def test_evidence_not_later_than_its_state(spark):
    states = stamps(spark.createDataFrame([("f", "2024-01-01", ["e1"]), ("f", "2024-01-02", ["e2", "e9"])], "fixture_id string, known_from string, evidence_event_ids array<string>"))
    ev = stamps(spark.createDataFrame([("f", "e1", "2024-01-01"), ("f", "e2", "2024-01-03")], "fixture_id string, event_id string, known_from string"))
    got = sorted((r.event_id, r.problem) for r in temporal.state_problems(states, ev).collect())
    assert got == [("e2", "evidence is later than its state"), ("e9", "unknown evidence")]
