"""Sessions, sources, requests, quality, live state on small hand-made inputs."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions import classify, dialect, preview
from marketloom.functions import requests as rq
from marketloom.functions import scalar as x
from marketloom.operators import bars, etl, promotion, quality, sessions, topk
from marketloom.sources import schema as sc
from marketloom.sources import store as st
from marketloom.sources import ticks as tk
from marketloom.streaming import live

LINES = """2023-05-12 09:15:00,309.5,100,Q,
2023-05-12 09:30:00.001,310.55,500,Q,T
2023-05-12 09:30:10,310.65,300,Q,

2023-05-12 09:30:59.5,310,200,Q,
2023-05-12 09:31:00,310.03,150,Q,
2023-05-12 15:59:59,308.9,400,Q,
2023-05-12 16:00:00,308.97,10000,Q,
"""
GOLDEN = {"13:15": (309.5, 309.5, 309.5, 309.5, 100), "13:30": (310.55, 310.65, 310.0, 310.0, 1000), "13:31": (310.03,) * 4 + (150,),
          "19:59": (308.9,) * 4 + (400,), "20:00": (308.97,) * 4 + (10000,)}


def test_golden_minute_bars(spark, tmp_path):
    (tmp_path / "MSFT_trades_2023-05-12.txt").write_text(LINES)
    (tmp_path / "_skip_trades.txt").write_text("junk")
    (tmp_path / "BAD_trades_x.txt").write_text("2023-05-12 09:30:00,1,1,Q,\n\n2023-05-12 09:30:00,1,1\n")
    parsed = tk.read(spark, str(tmp_path))
    t = tk.trades(tk.sound_files(parsed)).select(F.col("symbol").alias("sym"), "time", "price", F.col("volume").alias("size"),
                                                 F.monotonically_increasing_id().alias("seq"))
    assert [r.sym for r in t.select("sym").distinct().collect()] == ["MSFT"]
    for session, wanted in (("regular", ("13:30", "13:31", "19:59")), ("all", tuple(GOLDEN))):
        got = {r.date.strftime("%H:%M"): (r.open, r.high, r.low, r.close, r.volume) for r in bars.from_ticks(t, "1m", session=session).collect()}
        assert got == {k: GOLDEN[k] for k in wanted}
    bad = tk.rejects(spark, str(tmp_path)).collect()
    assert [(r.file.split("/")[-1], r.first_line, r.bad_lines) for r in bad] == [("BAD_trades_x.txt", 3, 1)]


def test_clock_changes_are_reported(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",), ("2024-11-03 02:30:00",), ("2024-11-03 00:30:00",), ("x",)], "t string")
    at, problem = tk.local_to_utc(F.col("t"))
    got = [r.p for r in df.select(problem.alias("p")).collect()]
    assert got == ["nonexistent local time", "ambiguous local time", None, None, "unreadable stamp"]


def test_regular_session_follows_the_clock(spark):
    df = spark.createDataFrame([("2024-01-10 14:30:00", True), ("2024-01-10 14:29:59", False), ("2024-07-10 13:30:00", True),
                                ("2024-07-10 20:00:00", False), ("2024-01-10 20:59:59", True)], "t string, want boolean")
    rows = df.select("want", sessions.in_regular(F.col("t").cast("timestamp")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_symbols(spark):
    want = {"AAPL": ("us", "AAPL.US"), "BRK-B": ("us", "BRK-B.US"), "btc-usd": ("crypto", "BTC-USD.CC"), "EURUSD": ("forex", "EURUSD.FOREX"),
            "TALA.TO": ("unsupported", "TALA.TO"), "X.CC": ("crypto", "X.CC"), "ABCDEF": ("us", "ABCDEF.US")}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    got = {r.s: (r.f, r.t) for r in df.select("s", classify.feed_of(F.col("s")).alias("f"), classify.snapshot_ticker(F.col("s")).alias("t")).collect()}
    assert got == want


def test_request_text():
    reqs = rq.parse_requests("sma:period=50,ema:period=20bd,avwap:anchor=2024-01-02T14:30:00,bbands:k=2:source=local")
    assert [r.name for r in reqs] == ["sma", "ema", "avwap", "bbands"]
    assert reqs[1].units == {"period": "bd"} and reqs[1].params["period"] == 20
    assert reqs[2].params["anchor"] == "2024-01-02T14:30:00" and reqs[3].source == "local"
    assert rq.with_anchor("rsi", "2024-01-01") == "avwap:anchor=2024-01-01,rsi"
    assert rq.with_anchor("avwap", "2024-01-01") == "avwap"
    for bad in ("sma:period=50bx", "nope", "sma:source=moon", "sma:units=1"):
        with pytest.raises((ValueError, KeyError)):
            rq.parse_requests(bad)
    assert rq.parse_anchors("2024-01-01,aapl=2024-02-02T10:00:00Z,x=bad", "d") == ("2024-01-01", {"AAPL": "2024-02-02T10:00:00Z"})
    assert rq.study_window_start("2020-01-01", date(2024, 5, 1)) == date(2020, 1, 1)
    assert rq.default_window(None, date(2024, 2, 29), date(2024, 5, 1)) == (date(2023, 2, 28), date(2024, 2, 29))
    b = rq.bundle("m", {"panes": [{"id": "price", "indicators": [{"name": "sma", "period": 20}]}, {"indicators": [{"name": "rsi"}]}]})
    assert [r.name for r in b.requests()] == ["sma", "rsi"]
    with pytest.raises(ValueError):
        rq.bundle("m", {"panes": [{"id": "a", "indicators": []}]})


def test_calendar_rules():
    assert etl.latest_complete_monday(datetime(2024, 1, 20, 7)) == date(2024, 1, 8)
    assert etl.latest_complete_monday(datetime(2024, 1, 20, 8)) == date(2024, 1, 15)
    assert etl.daily_due(datetime(2024, 1, 17, 2, 4), set()) is None
    assert etl.daily_due(datetime(2024, 1, 17, 2, 5), set()) == date(2024, 1, 17)
    assert etl.daily_due(datetime(2024, 1, 15, 9), set()) is None


def test_fiscal_labels_and_splits(spark):
    df = spark.createDataFrame([("2023-09-30", 9), ("2023-12-31", 9), ("2024-03-31", None)], "d string, m int").withColumn("d", F.to_date("d"))
    got = [tuple(r) for r in df.select(x.fiscal_year(F.col("d"), F.col("m")), x.fiscal_quarter(F.col("d"), F.col("m"))).collect()]
    assert got == [(2023, 4), (2024, 1), (2024, 1)]
    num, den = x.split_parts(F.col("s"))
    rows = spark.createDataFrame([("4.000000/1.000000",), ("3",), ("2/0",), ("x/1",)], "s string").select(num.alias("n"), den.alias("d")).collect()
    assert [(r.n, r.d) for r in rows[:3]] == [(4.0, 1.0), (3.0, 1.0), (2.0, 1.0)] and rows[3].n is None


def test_preview_refuses(spark):
    df = spark.createDataFrame([("a%b", 1), ("axb", 2)], "t string, n int")
    assert [r.n for r in preview.preview(df, None, [{"field": "t", "operator": "contains", "value": "A%"}]).collect()] == [1]
    for bad in ({"field": "t;", "operator": "eq", "value": 1}, {"field": "t", "operator": "like", "value": 1}, {"field": "t", "operator": "eq", "value": None},
                {"field": "t", "operator": "in", "value": []}, {"field": "t", "operator": "between", "value": [1]}):
        with pytest.raises(ValueError):
            preview.predicate(df, bad)


def test_conform_and_enforce(spark):
    df = spark.createDataFrame([(1.0, 2.5), (None, 3.0)], "a double, b double")
    out, lossy = sc.conform(df, T.StructType.fromDDL("a bigint, b bigint"))
    assert lossy == ["b"] and dict(out.dtypes) == {"a": "bigint", "b": "double"}
    with pytest.raises(ValueError):
        sc.enforce(df, T.StructType.fromDDL("a double"))
    dated = sc.normalize_dates(spark.createDataFrame([("2024-01-02", 1)], "Date string, v int"))
    assert dated.columns == ["date", "v"] and dated.first().date == datetime(2024, 1, 2)


def test_comparison_keeps_non_finite_apart(spark):
    cols = "symbol string, date string, open double, high double, low double, close double, volume double"
    a = spark.createDataFrame([("A", "d", 1.0, float("nan"), 1.0, 2.0, 5.0), ("A", "e", 1.0, 1.0, 1.0, 1.0, 1.0)], cols)
    b = spark.createDataFrame([("A", "d", 1.005, 1.0, 1.0, 0.0, 5.0)], cols)
    got = {r.field: (r.finite, r.bps) for r in quality.discrepancies(a, b).collect()}
    assert got == {"high": (False, None), "close": (True, None)}
    assert [tuple(r) for r in quality.coverage_gaps(a, b).collect()] == [("A", "e", "ours_only")]


def test_store_lifecycle(spark, tmp_path):
    s = st.Store(spark, str(tmp_path), "lib")
    mk = lambda rows: spark.createDataFrame(rows, "symbol string, date string, v double").withColumn("date", F.col("date").cast("timestamp"))
    s.overwrite(mk([("A", "2024-01-01 10:00:00", 1.0), ("A", "2024-01-02 10:00:00", 2.0), ("B", "2024-01-01 11:00:00", 3.0)]), {"k": "v"}, datetime(2024, 2, 1))
    s.append(mk([("A", "2024-01-02 12:00:00", 4.0)]), None, datetime(2024, 2, 2))
    assert s.replace_days(mk([("A", "2024-01-02 09:00:00", 9.0)]), None, datetime(2024, 2, 3)) == [date(2024, 1, 2)]
    vals = lambda df: sorted(r.v for r in df.collect())
    assert vals(s.read()) == [1.0, 3.0, 9.0]
    assert vals(s.read(version=1)) == [1.0, 2.0, 3.0, 4.0]
    assert vals(s.read(as_of="2024-02-01 12:00:00")) == [1.0, 2.0, 3.0]
    assert vals(s.read(["A"], "2024-01-01", "2024-01-01")) == [1.0]
    assert vals(s.trailing(1)) == [3.0, 9.0]
    assert vals(s.window(symbols=["A"])) == [9.0]
    with pytest.raises(ValueError):
        s.append(spark.createDataFrame([("A", 1)], "symbol string, v int"))
    s.overwrite(spark.createDataFrame([("A", "2024-03-01", "new")], "symbol string, date string, note string").withColumn("date", F.col("date").cast("timestamp")),
                None, datetime(2024, 2, 4))
    assert [r.note for r in s.read(["A"]).collect()] == ["new"]
    assert st.libraries(spark, str(tmp_path)) == ["lib"]
    now = st.snapshot_versions(s)
    assert st.newer_available(now.limit(0), now).first().newer and not st.newer_available(now, now).first().newer
    with pytest.raises(LookupError):
        st.manifest(s, ["A"], {"A": 99})
    assert s.vacuum(0, datetime(2024, 3, 1)) == [2, 3]


def test_silence_windows(spark):
    cases = [("crypto", "2024-01-06 03:00", True), ("us", "2024-01-05 14:30", True), ("us", "2024-01-05 20:00", False), ("us", "2024-01-06 15:00", False),
             ("forex", "2024-01-05 20:59", True), ("forex", "2024-01-05 21:00", False), ("forex", "2024-01-07 22:00", True), ("forex", "2024-01-06 10:00", False)]
    df = spark.createDataFrame(cases, "feed string, t string, want boolean")
    assert all(r.want == r.got for r in df.select("want", live.expects_ticks(F.col("feed"), F.col("t").cast("timestamp")).alias("got")).collect())


def test_stream_of_many_files_equals_batch(spark, tmp_path):
    from tests.test_series import ticks
    pdf = ticks(240, 5)
    for i in range(4):
        spark.createDataFrame(pdf.iloc[i::4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = bars.from_ticks(spark.createDataFrame(pdf), "1h", count=True)
    stream = live.replay(spark, str(tmp_path / "in"), batch.sparkSession.createDataFrame(pdf).schema, 1)
    out = live.settled(live.drain(live.live_bars(stream, "1h"), "update", "t"), ("sym", "date"))
    key = lambda df: sorted((r.sym, r.date, r.open, r.high, r.low, r.close, r.volume, r.trades) for r in df.collect())
    assert key(out) == key(batch)
    both = stream.unionByName(live.replay(spark, str(tmp_path / "in"), stream.schema, 1))
    assert live.drain(live.dedupe(both), "append", "d").count() == len(pdf)


def test_java_pattern():
    assert dialect.java_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"


def test_shipped_bundles_and_catalog(spark):
    from marketloom.operators import indicators as ind
    assert {n: len(rq.shipped(n).requests()) for n in rq.SHIPPED} == {"classic-momentum": 5, "volatility-squeeze": 5}
    rows = ind.catalog(spark).collect()
    assert len({r.name for r in rows if r.name != "mean_tr"}) == 34 and {r.kind for r in rows} == {
        "window", "cumulative", "recurrence", "stateful", "session"}


def test_landing_receipts_and_counts(spark, tmp_path):
    from marketloom.operators import identity, promotion, topk
    from marketloom.operators.temporal import parse_context
    landed = promotion.land(spark.createDataFrame([("x" * 10,)], "payload string")).first()
    assert landed.bytes == 10 and len(landed.content_hash) == 64
    r = identity.receipt("sql", parse_context(), spark.createDataFrame([("silver.listings", 3)], "symbol string, version long"), "req", "fp").first()
    assert (r.relation, r.version, r.mode) == ("silver.listings", 3, "current_corrected")
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("c", -1.0)], "code string, weight double")
    assert [x.code for x in topk.by_weight(df, "weight", "code").collect()] == ["b", "a", "c"]
    watched, counts = quality.observed(df, "checks", missing=F.col("weight").isNull())
    watched.write.mode("overwrite").parquet(str(tmp_path / "w"))
    assert counts.get == {"rows": 3, "missing": 1}


def test_landing_keeps_long_bodies_whole(spark):
    body = '{"results": [' + ", ".join(f'{{"date": "2024-01-{i % 28 + 1:02d}", "close": "{i}"}}' for i in range(60_000)) + "]}"
    assert len(body) > 2_000_000
    landed = promotion.land(spark.createDataFrame([("l", "c", body)], "listing_id string, capture_id string, payload string"))
    assert landed.selectExpr("payload = '' or bytes = length(payload) as whole").first().whole
    rows = promotion.daily_prices(landed.withColumn("observed_at", F.lit("2024-02-01").cast("timestamp")))
    assert rows.count() == 60_000


def test_limits_are_honoured_or_refused(spark):
    many = spark.range(25_000)
    assert preview.preview(many).count() == 25_000 and preview.preview(many, limit=20_000).count() == 20_000
    assert topk.capped(many, 20_000, [F.col("id")]).count() == 20_000
    for refused in (lambda: preview.preview(many, limit=0), lambda: topk.page(many, [F.col("id")], 0, 0)):
        with pytest.raises(ValueError):
            refused()
    placed = topk.placed(many.repartition(7), [F.col("id").desc()])
    assert placed.where(F.col("place") + F.col("id") != 25_000).count() == 0
