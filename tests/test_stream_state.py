"""Keyed stream processors, without a stream where none is needed."""

import json
import random

import numpy as np
import pandas as pd
import pytest

from marketloom.operators import indicators as ind
from marketloom.streaming import live, stateful


class Held:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers, self.held = set(), Held()

    def getValueState(self, name, schema):  # noqa: N802
        return self.held

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


REQUESTS = [ind.resolve("sma", period=4), ind.resolve("willr", period=5), ind.resolve("bbands", period=3), ind.resolve("ema", period=6),
            ind.resolve("macd", fast=3, slow=6, signal=4), ind.resolve("atr", period=5), ind.resolve("rsi", period=5)]


def run(segments, delay):
    p = stateful._Indicators(REQUESTS, 60_000_000, delay)
    handle = Handle()
    p.init(handle)
    rows = {}
    for s in segments:
        for out in p.handleInputRows(("A",), iter(s if isinstance(s, list) else [s]), None):
            for r in out.to_dict("records"):
                rows[r["date"]] = r
    return rows, np.frombuffer(handle.held.value[0], stateful._BAR), json.loads(handle.held.value[1])


def test_indicators_carried_over_batches_equal_one_batch():
    r = random.Random(4)
    base = pd.Timestamp("2024-01-01")
    ticks = pd.DataFrame({"time": [base + pd.Timedelta(seconds=7 * i + r.randrange(90)) for i in range(1500)], "seq": range(1500),
                          "price": [100 + r.gauss(0, 1) if r.random() > 0.05 else None for _ in range(1500)], "size": [r.choice([1.0, None, 3.0]) for _ in range(1500)]})
    whole, _, _ = run([ticks], 10**12)
    carried, bars, ends = run([ticks[a:a + 111] for a in range(0, 1500, 111)], 120_000_000)
    assert list(carried) == list(whole) and len(bars) < 20 and ends
    for date, want in whole.items():
        for name, value in want.items():
            got = carried[date][name]
            assert got == value or pd.isna(got) and pd.isna(value) or abs(got - value) < 1e-9, (date, name)
    chunks, _, _ = run([[ticks[:400], ticks[400:700]], ticks[700:]], 10**12)
    assert chunks.keys() == whole.keys()


def test_expiries_in_any_batches():
    base = pd.Timestamp("2024-01-01")
    at = lambda s: base + pd.Timedelta(seconds=s)
    rows = [(0, 10), (5, 10), (15, 3), (17, 2), (17, 9), (26, 1), (40, 5), (41, 1)]
    lapses = [(5, 15), (17, 26), (26, 27)]  # at the instant of its lapse a renewal begins anew; 41 + 1 is still open

    def walk(cuts):
        p, handle, out = stateful._Expiry(), Handle(), []
        p.init(handle)
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            frame = pd.DataFrame({"at": [at(s) for s, _ in rows[a:b]], "ttl": [float(t) for _, t in rows[a:b]]})
            out += [x for f in p.handleInputRows(("k",), iter([frame]), None) for x in f.itertuples(index=False)]
        assert handle.timers == {int(at(42).timestamp() * 1000)}
        out += [x for f in p.handleExpiredTimer(("k",), None, None) for x in f.itertuples(index=False)]
        assert not handle.held.exists() and not list(p.handleExpiredTimer(("k",), None, None))
        return [((x.since - base).total_seconds(), (x.expired - base).total_seconds()) for x in out]

    for cuts in ([], [1, 3, 5], [2, 4, 6, 7]):
        assert walk(cuts) == [*lapses, (41, 42)]


def test_unknown_requests_are_refused(spark):
    ticks = spark.createDataFrame([], "sym string, time timestamp, price double, size double, seq long")
    with pytest.raises(ValueError, match="supertrend"):
        stateful.indicator_stream(ticks, [ind.resolve("supertrend")], "1h")


def test_the_state_store_setting_is_restored(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(KeyError):
        with stateful.keyed_state(spark):
            assert "RocksDB" in spark.conf.get(key)
            raise KeyError
    assert spark.conf.get(key) == before


def test_a_drain_without_batches_is_empty(spark, tmp_path):
    spark.range(0).selectExpr("id AS v").write.parquet(str(tmp_path / "in"))
    stream = live.replay(spark, str(tmp_path / "in"), "v long")
    assert live.drain(stream).count() == 0
    pushed = live.drain(stream, on_batch=lambda df, i: df.selectExpr("v AS w"))
    assert pushed.columns == ["w", "batch_id"] and pushed.count() == 0
