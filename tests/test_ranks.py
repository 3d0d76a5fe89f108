"""Rank selection and sketches against sorted lists."""

import math
import random

from pyspark.sql import functions as F

from marketloom.operators import ranges, ranks

WANTED = {"lo": (0.0, "disc"), "q": (0.3, "disc"), "med": (0.5, "cont"), "below": (0.5, "low"), "hi": (0.97, "cont")}


def cont(v, share):
    at = share * (len(v) - 1)
    a, b = v[math.floor(at)], v[math.ceil(at)]
    return a + (at - math.floor(at)) * (b - a)


def test_quantiles_of_skewed_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CELLS", 8)  # many rounds
    r = random.Random(3)
    rows = [(k, r.choice([r.gauss(0, 1), r.gauss(0, 1) * 10.0 ** r.randrange(-200, 200), 5.0, 5.0, None, float("nan"), float("inf")])) for k in ("a", None, "b") for _ in range(200)]
    rows += [("one", 7.0), ("same", -1.5), ("same", -1.5), ("none", None)]
    got = {x["k"]: x for x in ranks.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", WANTED).collect()}
    assert set(got) == {"a", None, "b", "one", "same"}
    for k, row in got.items():
        v = sorted(x for key, x in rows if key == k and x is not None and math.isfinite(x))
        assert row.lo == v[0] and row.q == v[max(math.ceil(0.3 * len(v)) - 1, 0)] and row.below == v[(len(v) - 1) // 2]
        assert math.isclose(row.med, cont(v, 0.5), rel_tol=1e-12) and math.isclose(row.hi, cont(v, 0.97), rel_tol=1e-12)


def test_sketches_of_days_add_up(spark):
    r = random.Random(5)
    rows = [("k" if i % 3 else None, i % 9, math.exp(r.gauss(0, 3)), i % 500) for i in range(6000)] + [("k", 1, 0.0, 9), ("k", 1, -2.0, 9)]
    df = spark.createDataFrame(rows, "k string, d int, v double, who long")
    days = ranks.day_sketches(df, ["k"], F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")), "v", "who", 0.02)
    assert days.count() == 9
    for x in ranks.roll_up(days, ["k"], {"med": 0.5, "high": 0.99}, 0.02).collect():
        v = sorted(row[2] for row in rows if row[0] == x.k and row[2] > 0)
        assert x.n == len(v)
        for got, share in ((x.med, 0.5), (x.high, 0.99)):
            want = v[math.floor(share * (len(v) - 1))]
            assert abs(got - want) <= 0.02 * want * (1 + 1e-9)
        who = len({row[3] for row in rows if row[0] == x.k and row[2] > 0})
        assert abs(x.members - who) <= max(1, 3 * 1.04 / 128 * who)


def test_null_keys_have_gaps_too(spark):
    day = lambda n: f"2024-01-{n:02d}"
    cov = spark.createDataFrame([(k, day(a), day(b)) for k in (None, "x") for a, b in ((3, 5), (6, 7), (12, 12))], "sym string, s string, e string")
    cov = cov.select("sym", F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"))
    req = spark.createDataFrame([(1, None, day(1), day(20)), (2, "x", day(8), day(9)), (3, "y", day(2), day(2)), (4, "x", day(12), day(12)), (5, "x", day(7), day(13))],
                                "request long, sym string, start string, end string")
    req = req.select("request", "sym", F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("end"))
    got = sorted((r.request, r.s.day, r.e.day) for r in ranges.subtract(req, cov, "1d").collect())
    assert got == [(1, 1, 2), (1, 8, 11), (1, 13, 20), (2, 8, 9), (3, 2, 2), (5, 8, 11), (5, 13, 13)]
