"""Bucketed scans, as-of reads and range algebra against plain references, cut small."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import intervals
from marketloom.operators import asof, bars, ranges, series, topk
from marketloom.operators.series import Layout, Prefix

CUT = Layout(keys=("sym",), order=("time", "seq"), bucket_seconds=3600, rows_per_part=16)


def ticks(n=400, seed=0, symbols=("HOT", "HOT", "HOT", "B", "C")):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "sym": rng.choice(symbols, n), "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20 * 3600, n), unit="s"),
        "price": rng.uniform(1, 9, n).round(2), "size": rng.integers(0, 5, n).astype(float), "seq": np.arange(n)})


@pytest.mark.parametrize("layout", [CUT, CUT.with_(bucket_seconds=1 << 40, rows_per_part=1 << 20)])
def test_scan_equals_pandas(spark, layout):
    pdf = ticks()
    df = spark.createDataFrame(pdf).repartition(7)
    out = series.scan(df, layout, {
        "total": Prefix("sum", F.col("size")), "before": Prefix("sum", F.col("size"), False), "n": Prefix("count"),
        "hi": Prefix("max", F.col("price")), "lo": Prefix("min", F.col("price"), False),
        "last_big": Prefix("last", F.when(F.col("size") > 2, F.col("price")))})
    got = series.previous(out, layout, {"prev": "price"}).toPandas().sort_values(["sym", "time", "seq"]).reset_index(drop=True)
    want = pdf.sort_values(["sym", "time", "seq"]).reset_index(drop=True)
    g = want.groupby("sym")
    np.testing.assert_allclose(got.total, g["size"].cumsum())
    np.testing.assert_allclose(got.before.fillna(0), g["size"].cumsum() - want["size"])
    assert (got.n == g.cumcount() + 1).all()
    np.testing.assert_allclose(got.hi, g.price.cummax())
    np.testing.assert_allclose(got.lo, g.price.cummin().groupby(want.sym).shift())
    np.testing.assert_allclose(got.prev, g.price.shift())
    np.testing.assert_allclose(got.last_big, want.price.where(want["size"] > 2).groupby(want.sym).ffill())


def test_null_order_values_come_first(spark):
    pdf = ticks(60)
    df = spark.createDataFrame(pdf).withColumn("time", F.when(F.col("seq") % 7 != 0, F.col("time"))).withColumn(
        "sym", F.when(F.col("sym") != "C", F.col("sym"))).repartition(3)
    got = series.previous(series.number(df, CUT), CUT, {"prev": "seq"}).orderBy("seq").select("seq", "_pos", "prev").collect()
    w = Window.partitionBy("sym").orderBy("time", "seq")
    want = df.withColumns({"_pos": F.row_number().over(w) - 1, "prev": F.lag("seq").over(w)}).orderBy("seq").select("seq", "_pos", "prev").collect()
    assert len(got) == 60 and got == want
    assert series.drop_halo(series.parts(df, CUT, 3)).count() == 60


def test_parts_hold_exact_halos(spark):
    df = spark.createDataFrame(ticks()).repartition(3)
    rows = series.parts(df, CUT, 5).select("sym", "_pos", "_part", "_halo").toPandas()
    own = rows[~rows._halo]
    assert len(own) == 400 and (own._part == own._pos // 16).all()
    for (sym, part), g in rows.groupby(["sym", "_part"]):
        if part and not g[~g._halo].empty:
            assert sorted(g[g._halo]._pos) == list(range(part * 16 - 5, part * 16))


def test_asof_equals_merge_asof(spark):
    facts = ticks(300, 1)
    asked = ticks(200, 2)[["sym", "time", "seq"]].rename(columns={"seq": "request"})
    got = asof.backward(spark.createDataFrame(asked), spark.createDataFrame(facts), layout=CUT).toPandas().sort_values("request")
    left = asked.sort_values("time")
    right = facts.sort_values(["time", "seq"])
    want = pd.merge_asof(left, right, on="time", by="sym").sort_values("request")
    np.testing.assert_allclose(got.price.astype(float), want.price.astype(float))
    assert (got.seq.fillna(-1).astype(int).to_numpy() == want.seq.fillna(-1).astype(int).to_numpy()).all()


def test_bars_do_not_depend_on_order_or_partitions(spark):
    pdf = ticks(500, 3)
    one = bars.from_ticks(spark.createDataFrame(pdf), "1h").toPandas()
    two = bars.from_ticks(spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(9), "1h").toPandas()
    key = ["sym", "date"]
    pd.testing.assert_frame_equal(one.sort_values(key).reset_index(drop=True), two.sort_values(key).reset_index(drop=True))


def test_equal_times_break_by_arrival_and_zero_size_has_no_vwap(spark):
    rows = [("A", "2024-01-01 10:00:00", 5.0, 0.0, 2), ("A", "2024-01-01 10:00:00", 7.0, 0.0, 3), ("A", "2024-01-01 09:59:59", 6.0, 0.0, 9)]
    df = spark.createDataFrame(rows, "sym string, time string, price double, size double, seq long").withColumn("time", F.col("time").cast("timestamp"))
    b = bars.from_ticks(df, "1d").first()
    assert (b.open, b.close, b.vwap, b.volume) == (6.0, 7.0, None, 0.0)
    assert topk.latest_tick(df).first().price == 7.0
    assert topk.newest(df, 0).count() == 0


DAY = pd.Timestamp("2024-01-01")


def naive_subtract(req, cov):
    have = {d for s, e in cov for d in range(s, e + 1)}
    gaps, run = [], None
    for d in range(req[0], req[1] + 2):
        if d <= req[1] and d not in have:
            run = run if run is not None else d
        elif run is not None:
            gaps.append((run, d - 1))
            run = None
    return gaps


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6)), max_size=12), st.integers(0, 50), st.integers(0, 30))
def test_subtract_and_coalesce_properties(spark, covered, start, length):
    cov = [(s, s + n) for s, n in covered]
    at = lambda d: (DAY + pd.Timedelta(days=d)).to_pydatetime()
    df = spark.createDataFrame([("A", at(s), at(e)) for s, e in cov], "sym string, s timestamp, e timestamp")
    req = spark.createDataFrame([("r", "A", at(start), at(start + length))], "request string, sym string, start timestamp, end timestamp")
    lay = Layout(keys=("sym",), bucket_seconds=5 * 86400)
    got = sorted(((r.s - at(0)).days, (r.e - at(0)).days) for r in ranges.subtract(req, df, "1d", layout=lay, slice_seconds=4 * 86400).collect())
    assert got == naive_subtract((start, start + length), cov)
    merged = ranges.coalesce(df, "1d", layout=lay)
    again = ranges.coalesce(merged, "1d", layout=lay)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, again.collect()))
    assert {d for r in merged.collect() for d in range((r.s - at(0)).days, (r.e - at(0)).days + 1)} == {d for s, e in cov for d in range(s, e + 1)}


def test_refresh_wants_the_whole_request(spark):
    req = spark.createDataFrame([("r", "L", "2024-01-01", "2024-01-10")], "request string, listing_id string, start string, end string").withColumns(
        {"start": F.to_date("start"), "end": F.to_date("end")})
    held = spark.createDataFrame([("L", "2024-01-03")], "listing_id string, day string").withColumn("day", F.to_date("day"))
    rows = ranges.missing_weekdays(req, held, policy="refresh").collect()
    assert [(str(r.s), str(r.e)) for r in rows] == [("2024-01-01", "2024-01-10")]


@pytest.mark.parametrize("text,want", [("5m", (5, "m")), ("m", (1, "m")), ("1M", (1, "mo")), ("3mon", (3, "mo")), ("2 weeks", (2, "w"))])
def test_interval_grammar(text, want):
    assert intervals.parse(text) == want


@pytest.mark.parametrize("bad", ["", "5x", "0d", "-1m"])
def test_interval_grammar_rejects(bad):
    with pytest.raises(ValueError):
        intervals.parse(bad)


def test_week_and_month_labels_match_pandas(spark):
    pdf = pd.DataFrame({"symbol": "A", "date": pd.date_range("2024-01-03 10:00", periods=200, freq="31h"), "price": np.arange(200.0), "size": 1.0})
    df = spark.createDataFrame(pdf)
    for interval, rule in (("1w", "1W"), ("2w", "2W"), ("1mo", "1ME"), ("3mo", "3ME")):
        got = bars.resample(df, interval).toPandas().sort_values("date")
        want = pdf.set_index("date").resample(rule)["price"].agg(["first", "last"]).dropna()
        assert list(got.date) == list(want.index), interval
        assert list(got.open) == list(want["first"]) and list(got.close) == list(want["last"])


def test_null_keys_are_a_series(spark):
    rows = [("a", 1, 1.0), (None, 1, 2.0), (None, 2, 1.0), ("a", 90_000, 5.0), (None, 90_000, 4.0)]
    df = spark.createDataFrame(rows, "sym string, t long, v double")
    lay = Layout(keys=("sym",), order=("t",), bucket_seconds=3600)
    got = {(r.sym, r.t): r.run for r in series.scan(df, lay, {"run": Prefix("sum", F.col("v"))}).collect()}
    assert got == {("a", 1): 1.0, ("a", 90_000): 6.0, (None, 1): 2.0, (None, 2): 3.0, (None, 90_000): 7.0}


def test_one_row_that_explodes(spark):
    df = spark.range(1).select(F.lit("s").alias("sym"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(200_000).cast("long"))).alias("t"))
    lay = Layout(keys=("sym",), order=("t",), bucket_seconds=1000)
    out = series.number(df, lay)
    assert out.where(F.col(series.POS) != F.col("t") - 1).count() == 0 and out.count() == 200_000
