"""Texts as byte arrays: words, rolling hashes and window minima, vectorised over a chunk.

Tasks receive Arrow batches whose text column is binary. `chunks` cuts a batch into
pieces of a few megabytes (one text is never cut), so memory is bounded by the chunk
or by the longest single text. Hashes are 64-bit polynomials over random byte values;
all their prefix sums wrap, which is what arithmetic modulo 2**64 needs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import ship

CHUNK = 1 << 20
#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (9, 10, 11, 12, 13, 32)
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
IS_SPACE = np.isin(np.arange(256), SPACES)
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"
_U = np.uint64


def ready(spark: SparkSession) -> None:
    """Send the package to the workers and keep Arrow batches of texts small."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def tidy(fn):
    """Give memory back when a partition is done: workers live on between tasks."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Roll:
    """Hashes of any span of a sequence of 64-bit values, each in constant time."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        n = len(values)
        power, inverse = self._powers.get(base, (np.zeros(0, _U), np.zeros(0, _U)))
        if len(power) < n + 1:
            m = max(n + 1, CHUNK + 1)
            power, inverse = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(m, b, _U)]))
                              for b in (base, pow(base, -1, 1 << 64)))
            if m <= 2 * CHUNK:  # tables for one very long text are not kept
                self._powers[base] = power, inverse
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * power[:n], out=self.sums[1:])
        self.inverse = inverse

    def span(self, start, end) -> np.ndarray:
        """Hash of values[start:end]; spans of other lengths hash differently."""
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (np.asarray(end) - np.asarray(start)).astype(_U) * _U(0xA24BAED4963EE407))


_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def byte_roll(data: np.ndarray) -> Roll:
    return Roll(BYTE_VALUES[data], 0xC2B2AE3D27D4EB4F)


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, n + 1 offsets into them), whole texts only;
    a null text is empty."""
    array = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + n + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def runs(outside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of positions not `outside`, cut at text borders: starts, ends and, per
    text, the index of its first run (n + 1 values)."""
    n = len(outside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~outside
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = outside[:-1], outside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[filled], after[filled[1:] - 1] = True, True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(IS_SPACE[data], offsets)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i + width] for every i with a whole window, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def owners(counts: np.ndarray) -> np.ndarray:
    """0 0 1 2 2 2 ... for counts 2 1 3 ..."""
    return np.repeat(np.arange(len(counts)), counts)


def within(counts: np.ndarray) -> np.ndarray:
    """0 1 0 0 1 2 ... for counts 2 1 3 ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count values each."""
    return np.repeat(starts, counts) + within(counts)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def bitmap(keys: DataFrame, column: str, bits: int = 23) -> np.ndarray:
    """A Bloom filter with one hash over 64-bit keys, folded by Spark into at most
    2**(bits - 6) words: a fixed size whatever the input, 1 MB by default. Keys are
    well-mixed hashes; their upper bits pick the bit."""
    cell = F.shiftrightunsigned(F.col(column), 64 - bits)
    folded = (keys.select(F.shiftright(cell, 6).cast("int").alias("w"), cell.bitwiseAND(F.lit(63)).cast("int").alias("b"))
              .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow())
    out = np.zeros(1 << (bits - 6), np.int64)
    out[folded["w"].to_numpy()] = folded["v"].to_numpy()
    return out


def in_bitmap(keys: np.ndarray, words_: np.ndarray, bits: int = 23) -> np.ndarray:
    cell = keys.view(_U) >> _U(64 - bits)
    return (words_.view(_U)[(cell >> _U(6)).astype(np.int64)] >> (cell & _U(63)) & _U(1)).astype(bool)
