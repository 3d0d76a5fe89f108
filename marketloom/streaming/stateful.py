"""Keyed state for live ticks: expiries that fire by event time, indicators carried bar by bar.

Both processors hold a small state per key and read nothing else: a batch costs what it
brings, not what came before. They need the RocksDB state store (`keyed_state`).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketloom.functions import intervals
from marketloom.operators.indicators import Request
from marketloom.operators.series import _smooth as smooth
from marketloom.streaming.live import STALE_SECONDS, expects_ticks

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed processors need, for queries started inside."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _micros(stamps: pd.Series) -> np.ndarray:
    return stamps.to_numpy("datetime64[us]").astype(np.int64)


def _stamps(micros) -> pd.Series:
    return pd.Series(np.asarray(micros, np.int64).astype("datetime64[us]"))


# --- expiries -------------------------------------------------------------------------------


class _Expiry(StatefulProcessor):
    """State: the newest renewal and when it lapses, in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [(_micros(r["at"]), r["ttl"].to_numpy(np.float64)) for r in rows]
        at = np.concatenate([p[0] for p in parts])
        until = at + np.round(np.concatenate([p[1] for p in parts]) * 1e6).astype(np.int64)
        if self.held.exists():
            old_at, old = self.held.get()
            at, until = np.append(at, old_at), np.append(until, old)
            newer = at >= old_at  # a renewal older than the one held changes nothing
            at, until = at[newer], until[newer]
        order = np.lexsort((until, at))
        at, until = at[order], until[order]
        last = np.append(at[1:] > at[:-1], True)  # of renewals at one instant the longest holds
        at, until = at[last], until[last]
        lapsed = np.flatnonzero(at[1:] >= until[:-1])
        self.held.update((int(at[-1]), int(until[-1])))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.handle.registerTimer(-(-int(until[-1]) // 1000))
        if len(lapsed):
            yield self._rows(key, at[lapsed], until[lapsed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.held.exists():
            at, until = self.held.get()
            self.held.clear()
            yield self._rows(key, [at], [until])

    @staticmethod
    def _rows(key, at, until) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "since": _stamps(at), "expired": _stamps(until)})

    def close(self) -> None:
        pass


def expiries(renewals: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """`key, since, expired`: once for every lapse of `renewals(key, at, ttl seconds)`.

    A key lapses when event time reaches its newest renewal plus that renewal's span; a
    renewal at that instant or later begins anew. Late renewals, `delay` behind the newest,
    are left out; one older than the newest of its key changes nothing.
    """
    rows = renewals.select(F.col(key).alias("key"), "at", F.col("ttl").cast("double").alias("ttl")).withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(
        _Expiry(), "key string, since timestamp, expired timestamp", "append", "eventTime").withColumnRenamed("key", key)


def lease_expiries(renewals: DataFrame, ttl_seconds: int = 60, delay: str = "1 hour") -> DataFrame:
    """Symbols whose lease lapses, as it lapses. `renewals(sym, at, ttl)`; a null ttl takes the default."""
    clean = renewals.select(F.upper(F.trim("sym")).alias("sym"), "at", F.coalesce("ttl", F.lit(ttl_seconds)).alias("ttl")).filter("sym <> ''")
    return expiries(clean, "sym", delay)


def silences(ticks: DataFrame, seconds: int = STALE_SECONDS, delay: str = "1 hour") -> DataFrame:
    """`feed, last_tick, silent`: once for every time a feed falls silent for `seconds`
    at an hour when it ought to tick."""
    out = expiries(ticks.select("feed", F.col("time").alias("at"), F.lit(seconds).alias("ttl")), "feed", delay)
    return out.select("feed", F.col("since").alias("last_tick"), F.col("expired").alias("silent")).filter(expects_ticks(F.col("feed"), F.col("expired")))


# --- indicators -----------------------------------------------------------------------------

_BAR = np.dtype([("date", "i8"), ("open", "f8"), ("open_at", "i8"), ("open_seq", "i8"), ("high", "f8"), ("low", "f8"), ("close", "f8"), ("close_at", "i8"), ("close_seq", "i8"), ("volume", "f8")])


class Carry:
    """Recurrence values at the bar before the kept ones; what evaluating leaves behind."""

    def __init__(self, ends: dict[str, float], anchored: bool):
        self.ends, self.anchored, self.values = ends, anchored, {}

    def smooth(self, name: str, x: np.ndarray, alpha: float) -> np.ndarray:
        """y' = (1 - alpha) y + alpha x; the first kept bar is the anchor, whose value is known."""
        y = np.full(len(x), np.nan)
        start = self.ends.get(name)
        if self.anchored:
            y[0] = np.nan if start is None else start
            y[1:] = smooth(x[1:], alpha, start)
        else:
            y[:] = smooth(x, alpha, None)
        self.values[name] = y
        return y


def _rolled(fn: Callable, x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1:] = fn(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
    return out


def _change(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.nan)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


def _sma(b, carry, p):
    return {"sma": _rolled(np.mean, b["close"], p["period"])}


def _bbands(b, carry, p):
    mid, sd = _rolled(np.mean, b["close"], p["period"]), _rolled(np.std, b["close"], p["period"])
    return {"bb_mid": mid, "bb_up": mid + p["k"] * sd, "bb_lo": mid - p["k"] * sd}


def _willr(b, carry, p):
    high, low = _rolled(np.max, b["high"], p["period"]), _rolled(np.min, b["low"], p["period"])
    return {"willr": _ratio(-100 * (high - b["close"]), high - low)}


def _ema(b, carry, p):
    return {"ema": carry.smooth(f"ema{p['period']}", b["close"], 2 / (p["period"] + 1))}


def _rsi(b, carry, p):
    n, d = p["period"], np.nan_to_num(_change(b["close"]))
    gain, loss = (carry.smooth(f"{side}{n}", np.maximum(sign * d, 0), 1 / n) for side, sign in (("gain", 1), ("loss", -1)))
    return {"rsi": _ratio(100 * gain, gain + loss)}


def _atr(b, carry, p):
    before = b["close"] - _change(b["close"])
    span = np.fmax(b["high"] - b["low"], np.fmax(np.abs(b["high"] - before), np.abs(b["low"] - before)))
    return {"atr": carry.smooth(f"range{p['period']}", span, 1 / p["period"])}


def _macd(b, carry, p):
    line = carry.smooth(f"ema{p['fast']}", b["close"], 2 / (p["fast"] + 1)) - carry.smooth(f"ema{p['slow']}", b["close"], 2 / (p["slow"] + 1))
    signal = carry.smooth(f"macd{p['fast']},{p['slow']},{p['signal']}", line, 2 / (p["signal"] + 1))
    return {"macd": line, "macd_signal": signal, "macd_hist": line - signal}


@dataclass(frozen=True)
class Study:
    """How one indicator goes on from kept bars: `lookback` earlier bars and recurrence ends."""

    lookback: Callable[[dict], int]
    run: Callable[[np.ndarray, Carry, dict], dict[str, np.ndarray]]


STUDIES: dict[str, Study] = {
    "sma": Study(lambda p: p["period"], _sma), "bbands": Study(lambda p: p["period"], _bbands), "willr": Study(lambda p: p["period"], _willr),
    "ema": Study(lambda p: 1, _ema), "rsi": Study(lambda p: 2, _rsi), "atr": Study(lambda p: 2, _atr), "macd": Study(lambda p: 1, _macd)}


def _bars_of(ticks: pd.DataFrame, width: int) -> np.ndarray:
    """Bars of some ticks (date, time, seq, price, size columns), by date."""
    order = np.lexsort((ticks["seq"].to_numpy(np.int64), _micros(ticks["time"])))
    at, seq = _micros(ticks["time"])[order], ticks["seq"].to_numpy(np.int64)[order]
    price, size = ticks["price"].to_numpy(np.float64)[order], np.nan_to_num(ticks["size"].to_numpy(np.float64))[order]
    date = at // width * width
    first = np.flatnonzero(np.append(True, date[1:] != date[:-1]))
    last = np.append(first[1:], len(at)) - 1
    out = np.zeros(len(first), _BAR)
    for name, values in (("date", date[first]), ("open", price[first]), ("open_at", at[first]), ("open_seq", seq[first]), ("close", price[last]), ("close_at", at[last]), ("close_seq", seq[last]),
                         ("high", np.maximum.reduceat(price, first)), ("low", np.minimum.reduceat(price, first)), ("volume", np.add.reduceat(size, first))):
        out[name] = values
    return out


def _merged(bars: np.ndarray) -> np.ndarray:
    """One bar per date: pieces of a bar put together."""
    bars = bars[np.argsort(bars["date"], kind="stable")]
    if not len(bars):
        return bars
    first = np.flatnonzero(np.append(True, bars["date"][1:] != bars["date"][:-1]))
    out = bars[first].copy()
    out["high"], out["low"] = np.maximum.reduceat(bars["high"], first), np.minimum.reduceat(bars["low"], first)
    out["volume"] = np.add.reduceat(bars["volume"], first)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bars))))
    opens = np.lexsort((bars["open_seq"], bars["open_at"], group))[first]
    closes = np.lexsort((bars["close_seq"], bars["close_at"], group))[np.append(first[1:], len(bars)) - 1]
    for name in ("open", "open_at", "open_seq"):
        out[name] = bars[name][opens]
    for name in ("close", "close_at", "close_seq"):
        out[name] = bars[name][closes]
    return out


class _Indicators(StatefulProcessor):
    """State: the bars that may still change and the lookback before them, and every
    recurrence at the first of those once bars have been let go."""

    def __init__(self, requests: list[Request], width: int, delay: int):
        self.requests, self.width, self.delay = requests, width, delay
        self.lookback = max(STUDIES[r.name].lookback(r.params) for r in requests)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "bars binary, ends string, anchored boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept, ends, anchored = np.zeros(0, _BAR), {}, False
        if self.held.exists():
            raw, text, anchored = self.held.get()
            kept, ends = np.frombuffer(bytes(raw), _BAR), json.loads(text)
        fresh = np.zeros(0, _BAR)
        for chunk in rows:
            chunk = chunk[chunk["price"].notna()]
            if len(chunk):
                fresh = _merged(np.concatenate([fresh, _bars_of(chunk, self.width)]))
        if not len(fresh):
            return
        bars = _merged(np.concatenate([kept, fresh]))
        carry, outs = Carry(ends, anchored), {}
        for r in self.requests:
            for name, values in STUDIES[r.name].run(bars, carry, r.params).items():
                outs[name + r.suffix] = values
        touched = int(np.searchsorted(bars["date"], fresh["date"][0]))
        yield pd.DataFrame({"symbol": key[0], "date": _stamps(bars["date"][touched:]), **{c: bars[c][touched:] for c in ("open", "high", "low", "close", "volume")},
                            **{n: v[touched:] for n, v in outs.items()}})
        # bars wholly behind the delay can change no more; the lookback before the rest stays
        open_ = int(np.searchsorted(bars["date"] + self.width, bars["close_at"].max() - self.delay, side="right"))
        drop = max(0, open_ - self.lookback - 1)
        if drop:
            ends = {n: float(v[drop]) for n, v in carry.values.items() if not np.isnan(v[drop])}
            anchored = True
        self.held.update((bars[drop:].tobytes(), json.dumps(ends), anchored))

    def close(self) -> None:
        pass


def indicator_stream(ticks: DataFrame, requests: list[Request], interval: str, delay: str = "1 day") -> DataFrame:
    """Bars and indicators of `ticks(sym, time, price, size, seq)` from the first bar that a
    batch touches on, per symbol. A tick less than `delay` late revises its bar and all after it.

    Prices are unadjusted: closes stand for adjusted closes. Ticks without a price are left
    out, a missing size counts 0. Requests that `STUDIES` lacks are refused.
    """
    unknown = sorted({r.name for r in requests} - set(STUDIES))
    if unknown:
        raise ValueError(f"no incremental form of {', '.join(unknown)}")
    seconds = pd.Timedelta(delay).total_seconds()
    width = int(intervals.width_seconds(interval) * 1_000_000)
    names = [c for r in requests for c in r.columns()]
    schema = "symbol string, date timestamp, open double, high double, low double, close double, volume double, " + ", ".join(f"`{c}` double" for c in names)
    src = ticks.select("sym", "time", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), "seq").withWatermark("time", delay)
    return src.groupBy("sym").transformWithStateInPandas(_Indicators(requests, width, int(seconds) * 1_000_000), schema, "update", "eventTime")
