"""Segment-partition edit join over lines: near copies of an earlier line go.

A line is what stands between line feeds; lines without a word are left alone and never
counted. Lines are compared as UTF-8 bytes. The first occurrence of a line is the one
with the smallest (doc_id, line number); every later occurrence of the same bytes goes.
A first occurrence goes too when a line with an earlier first occurrence lies within
`edits` byte edits of it. Lines shorter than `min_bytes` go only as exact copies.

The join: each distinct line is cut into edits + 1 segments; a line within `edits` edits
shares at least one of them, shifted by no more than the edits on either side allow. So
every line puts (length, segment number, segment) into the index and probes it, for each
shorter or equal length in reach, with the substrings that the length difference lets
meet that segment. Lines that meet are compared first by a 64-bit byte census, whose
distance bounds the edits from below; the rest is verified by a banded bit-parallel edit
distance.

A line goes for one earlier line in reach, so a group of many near copies is not paired
out: under each key a line first takes the few earlier lines with the nearest census. A
line that these do not settle takes more of the same key's lines in a second round, and all
of them in the last: what is left undecided is small, and nothing is capped for good. Lines
that go still serve as evidence against later ones.

Columns besides doc_id and text are carried along as they are, whatever their names; an
empty table gives no rows; equal lines in one document tie by line number. A text of any
length is held whole by one task. A null text is empty. A null doc_id comes last. Rows that repeat one doc_id and text
keep the same lines. A document left without lines keeps an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import text as T
from marketloom.session import settle

_U = np.uint64
_CLASS = (T.BYTE_VALUES >> _U(60)).astype(np.int64)  # 16 classes of bytes for the census
LAST = (1 << 63) - 1


def lines_of(data: np.ndarray, offsets: np.ndarray):
    """Start, end, text and number in its text of every line that holds a word."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([breaks + 1, offsets[:-1]]))
    starts = starts[starts < offsets[-1]]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    at = np.searchsorted(breaks, starts)
    ends = np.minimum(np.append(breaks, offsets[-1])[at], offsets[1:][doc])
    number = at - np.searchsorted(breaks, offsets[:-1])[doc]
    solid = np.concatenate([[0], np.cumsum(~T.IS_SPACE[data])])
    held = solid[ends] > solid[starts]
    return starts[held], ends[held], doc[held], number[held]


@T.tidy
def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in T.chunks(batch):
            starts, ends, doc, number = lines_of(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(T.signed(T.byte_roll(data).span(starts, ends))), batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(number, pa.int32())],
                names=["line", "id", "number"])


def _segment(length: np.ndarray, edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of a line of that length; the longer segments come last."""
    size, over = length // (edits + 1), length % (edits + 1)
    long_before = np.maximum(i - (edits + 1 - over), 0)
    return i * size + long_before, size + (i >= edits + 1 - over)


def _census(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each of 16 classes of bytes occurs, modulo 16, four bits each."""
    size = ends - starts
    counts = np.bincount(np.repeat(np.arange(len(starts)) * 16, size) + _CLASS[data[T.spread(starts, size)]], minlength=16 * len(starts))
    return ((counts.reshape(-1, 16).astype(_U) & _U(15)) << (np.arange(16, dtype=_U) * _U(4))).sum(axis=1, dtype=_U)


def census_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most twice the edit distance: each edit changes two counts at most."""
    out = np.zeros(len(a), np.int64)
    for i in range(16):
        d = ((a >> _U(4 * i)) - (b >> _U(4 * i))) & _U(15)
        out += np.minimum(d, _U(16) - d).astype(np.int64)
    return out


def _keys(edits: int, min_bytes: int):
    """Index rows (probe false) and probes of every distinct line of a chunk, with its first place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch):
                starts, ends, doc, number = lines_of(data, offsets)
                ids = batch.column(0).slice(a, b - a).to_numpy()[doc]
                long = np.flatnonzero(ends - starts >= min_bytes)
                long = long[np.lexsort((number[long], ids[long]))]
                starts, ends = starts[long], ends[long]
                roll = T.byte_roll(data)
                line, sample = np.unique(roll.span(starts, ends), return_index=True)
                starts, ends, ids, number = starts[sample], ends[sample], ids[long][sample], number[long][sample]
                size, census = ends - starts, _census(data, starts, ends)
                out: list[tuple] = []
                for less in range(edits + 1):
                    length = size - less  # of the index lines to be met
                    for i in range(edits + 1):
                        at, n = _segment(length, edits, i)
                        salt = (length * (edits + 1) + i).astype(_U) * _U(0x9E3779B97F4A7C15)
                        if not less:
                            out.append((roll.span(starts + at, starts + at + n) ^ salt, slice(None), False))
                        # edits left of the segment are at most i, right of it at most edits - i
                        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                            if not less and not shift:
                                continue  # the line's own index row; index rows meet each other
                            fits = (length >= min_bytes) & (at + shift >= 0) & (at + shift + n <= size)
                            p = starts[fits] + (at + shift)[fits]
                            out.append((roll.span(p, p + n[fits]) ^ salt[fits], fits, True))
                for key, of, probe in out:
                    key = T.mix(key) & ~_U(1) | _U(probe)  # index rows of a key sort before its probes
                    yield pa.RecordBatch.from_arrays([*(pa.array(T.signed(x)) for x in (key, line[of], census[of])), pa.array(ids[of]), pa.array(number[of], pa.int32())],
                                                     names=["key", "line", "census", "id", "number"])

    return T.tidy(run)


def _nearest(later, earlier, distance, cap: int):
    """The `cap` pairs of each later row with the least distance; pairs with equal distance by row."""
    order = np.lexsort((earlier, distance, later))
    later, earlier, distance = later[order], earlier[order], distance[order]
    kept = np.arange(len(later)) - np.searchsorted(later, later) < cap
    return later[kept], earlier[kept], distance[kept]


def _meet(edits: int, cap: int | None, most: int = 1 << 20):
    """Pairs (a, b) of a line and an earlier one that meet under a key and whose census
    allows the edits; for each open row the `cap` nearest, or all. Rows come sorted by key,
    index rows (last bit 0) before probes; a probe meets all index rows of its key, an index
    row those after it. Where a row has more than `cap`, the rows of its key come out too
    (key set), to be read by the next round."""

    def pairs(key, line, census, ids, number, open_):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])  # one line from many chunks: its first place
        full, line, census, ids, number, open_ = (x[new] for x in (key, line, census, ids, number, open_))
        probe, key = (full & 1) > 0, full >> 1
        index, probes = np.flatnonzero(~probe), np.arange(len(key))
        low, high = np.searchsorted(key[index], key), np.searchsorted(key[index], key, side="right")
        low = np.where(probe, low, np.searchsorted(index, probes) + 1)
        many = high - low
        probes, low, many = probes[many > 0], low[many > 0], many[many > 0]
        held, total, a = (np.zeros(0, np.int64),) * 3, np.zeros(len(key), np.int64), 0
        while a < len(probes):
            b = max(a + 1, int(np.searchsorted(np.cumsum(many[a:a + most]), most, side="right")) + a)
            x = np.repeat(probes[a:b], many[a:b])
            y = index[T.spread(low[a:b], many[a:b])]
            a = b
            first = (ids[x] > ids[y]) | (ids[x] == ids[y]) & (number[x] > number[y])
            x, y = np.where(first, x, y), np.where(first, y, x)
            use = (line[x] != line[y]) & open_[x]
            x, y = x[use], y[use]
            distance = census_distance(census[x].view(_U), census[y].view(_U))
            near = distance <= 2 * edits
            x, y, distance = x[near], y[near], distance[near]
            if cap is None:
                yield _pair_rows(line[x], line[y])
                continue
            total += np.bincount(x, minlength=len(key))
            held = _nearest(*(np.concatenate(z) for z in zip(held, (x, y, distance), strict=True)), cap)
        if cap is not None:
            yield _pair_rows(line[held[0]], line[held[1]])
            more = total > cap
            crowd = np.isin(key, key[more])
            if crowd.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line[crowd]), pa.nulls(int(crowd.sum()), pa.int64()), *(pa.array(x[crowd]) for x in (full, census, ids)), pa.array(number[crowd], pa.int32()), pa.array(more[crowd])],
                    names=MET_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1] & -2))
            held = [x[last:] for x in rows]
            if last:
                yield from pairs(*(x[:last] for x in rows))
        if held is not None:
            yield from pairs(*held)

    return T.tidy(run)


MET = "a long, b long, key long, census long, id long, number int, open boolean"
MET_NAMES = [c.split()[0] for c in MET.split(", ")]


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    n = both.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=MET_NAMES)


def edit_within(pairs: list[tuple[bytes, bytes]], edits: int) -> np.ndarray:
    """Which pairs lie within `edits` byte edits. Common ends are cut off; then all pairs
    advance together, one column of the distance matrix a step. A pair's band of
    2 * edits + 1 rows around the diagonal is the low bits of one word that holds the
    signs of the vertical differences, and moves down by one row a column."""
    out = np.zeros(len(pairs), bool)
    rest: list[tuple[int, bytes, bytes]] = []
    for i, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > edits:
            continue
        n = min(len(a), len(b))
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        unlike = np.flatnonzero(x[:n] != y[:n])
        head = int(unlike[0]) if len(unlike) else n
        unlike = np.flatnonzero(x[len(a) - (n - head):][::-1] != y[len(b) - (n - head):][::-1])
        tail = int(unlike[0]) if len(unlike) else n - head
        a, b = a[head:len(a) - tail], b[head:len(b) - tail]
        if min(len(a), len(b)) == 0:
            out[i] = max(len(a), len(b)) <= edits
        else:
            rest.append((i, a, b))
    rest.sort(key=lambda r: len(r[2]))
    for at in range(0, len(rest), 4096):
        block = rest[at:at + 4096]
        out[np.array([r[0] for r in block])] = _banded([r[1] for r in block], [r[2] for r in block], edits)
    return out


def _banded(left: list[bytes], right: list[bytes], edits: int) -> np.ndarray:
    width = 2 * edits + 1
    mask, top = _U((1 << width) - 1), _U(1 << width - 1)
    m, n = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    rows = np.frombuffer(b"".join(left) + b"\0", np.uint8)
    columns = np.frombuffer(b"".join(right), np.uint8)
    row_at, column_at = np.cumsum(m) - m, np.cumsum(n) - n
    slant = m - n
    here = (_U(1) << (edits + slant).astype(_U))  # the diagonal that ends in the corner
    score = np.abs(slant)
    # bit t is row j - edits + t of column j; rows from 1 on begin as +1
    plus = np.full(len(m), 0, _U) | (mask >> _U(edits) << _U(edits))
    minus = np.zeros(len(m), _U)
    live = np.arange(len(m))
    for j in range(1, int(n.max()) + 1):
        live = live[(n[live] >= j) & (score[live] <= edits)]
        if not len(live):
            break
        c = columns[column_at[live] + j - 1]
        same = np.zeros(len(live), _U)
        for t in range(width):
            row = j - edits + t
            if row >= 1:
                inside = row <= m[live]
                same |= (inside & (rows[row_at[live] + np.where(inside, row - 1, 0)] == c)).astype(_U) << _U(t)
        vp, vn = plus[live], minus[live]
        x = same | vn
        level = ((((x & vp) + vp) ^ vp) | x) & mask  # diagonal step costs nothing
        hp = (vn | ~(level | vp)) & mask
        hn = vp & level
        score[live] += ((level & here[live]) == 0) & (j > -slant[live])
        plus[live] = ((hn | ~((level >> _U(1)) | hp)) & mask) | top
        minus[live] = (hp & (level >> _U(1))) & ~top
    return score <= edits


def _chosen(wanted: np.ndarray):
    """Lines whose name is in the bitmap, once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in T.chunks(batch):
                starts, ends, _, _ = lines_of(data, offsets)
                line, sample = np.unique(T.byte_roll(data).span(starts, ends), return_index=True)
                sample = sample[T.in_bitmap(line, wanted)]
                line = line[T.in_bitmap(line, wanted)]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(line)), pa.array([raw[s:e] for s, e in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)], pa.binary())],
                                                 names=["line", "bytes"])

    return T.tidy(run)


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = edit_within(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), edits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return T.tidy(run)


def near_lines(docs: DataFrame, edits: int, min_bytes: int, caps: tuple[int | None, ...] = (4, 64, None)) -> DataFrame:
    """Names of the lines that have an earlier line within `edits` edits, of (id, text) rows."""
    rows = docs.mapInArrow(_keys(edits, min_bytes), "key long, line long, census long, id long, number int").withColumn("open", F.lit(True))
    spelled = marked = None
    for cap in caps:
        dealt = rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key", "line", "id", "number")
        met = settle(dealt.mapInArrow(_meet(edits, cap), MET), "met")
        pairs = met.where("key is null").select("a", "b").distinct()
        if spelled is None:  # lines of the crowded keys are asked for by later rounds
            names = met.select("a").unionByName(met.where("b is not null").select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "line")
            names = settle(names, "names")
            spelled = docs.mapInArrow(_chosen(T.bitmap(names, "line")), "line long, bytes binary").join(names, "line", "left_semi").groupBy("line").agg(F.min("bytes").alias("bytes"))
            spelled = settle(spelled, "lines")
        near = (pairs.join(spelled.withColumnsRenamed({"line": "a", "bytes": "x"}), "a").join(spelled.withColumnsRenamed({"line": "b", "bytes": "y"}), "b")
                .select("a", "b", "x", "y").mapInArrow(_verify(edits), "a long, b long").select(F.col("a").alias("line")))
        marked = settle((near if marked is None else near.unionByName(marked)).distinct(), "near")
        crowd = met.where("key is not null").select("key", F.col("a").alias("line"), "census", "id", "number", "open", F.shiftright("key", 1).alias("group"))
        going = crowd.where("open").join(marked, "line", "left_anti").select("group", "line").distinct().withColumn("go", F.lit(True))
        if cap is None or going.isEmpty():
            return marked
        rows = (crowd.join(going.select("group").distinct(), "group", "left_semi").join(going, ["group", "line"], "left")
                .select("key", "line", "census", "id", "number", F.coalesce("go", F.lit(False)).alias("open")))
    return marked


def removed_lines(docs: DataFrame, edits: int, min_bytes: int) -> DataFrame:
    """id and its removed lines, (number, line name) each, of (id, text) rows."""
    seen = settle(docs.mapInArrow(_occurrences, "line long, id long, number int"), "occurrences")
    first = seen.groupBy("line").agg(F.min(F.struct("id", "number")).alias("first"), F.count("*").alias("n"))
    later = near_lines(docs, edits, min_bytes).withColumn("near", F.lit(True))
    special = first.join(later, "line", "left").where("n > 1 or near")
    return seen.join(special, "line").where(F.coalesce("near", F.lit(False)) | (F.struct("id", "number") != F.col("first"))).groupBy("id").agg(
        F.collect_set(F.struct("number", "line")).alias("gone"))


@T.tidy
def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (row, id, text, gone) without their removed lines."""
    for batch in batches:
        lists = batch.column(3)
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        flat = lists.flatten()
        numbers, names = flat.field("number").to_numpy(), flat.field("line").to_numpy()
        for a, b, data, offsets in T.chunks(batch):
            starts, ends, doc, number = lines_of(data, offsets)
            name = T.byte_roll(data).span(starts, ends).view(np.int64)
            held = np.bincount(doc, minlength=b - a)
            texts, lost = [], []
            first = np.searchsorted(doc, np.arange(b - a + 1))
            for i in range(b - a):
                raw = data[offsets[i]:offsets[i + 1]].tobytes()
                go = dict(zip(numbers[at[a + i]:at[a + i + 1]].tolist(), names[at[a + i]:at[a + i + 1]].tolist(), strict=True))
                s = slice(first[i], first[i + 1])
                gone = {k for k, x in zip(number[s].tolist(), name[s].tolist(), strict=True) if go.get(k) == x} if go else ()
                lost.append(len(gone))
                texts.append(b"\n".join(x for k, x in enumerate(raw.split(b"\n")) if k not in gone) if gone else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(held.astype(np.int64)), pa.array(lost, pa.int64())],
                names=["row", "kept", "n_lines", "n_removed"])


def _side(touched: np.ndarray, side: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=["row", "id", "text"]).filter(
                pa.array(T.in_bitmap(batch.column(0).to_numpy(), touched) == side))

    return T.tidy(run)


def drop_lines(docs: DataFrame, edits: int = 2, min_bytes: int = 24) -> DataFrame:
    """row (all columns as given), kept (the text without its removed lines), n_lines and
    n_removed of every row."""
    row = docs.select(F.struct("*").alias("row"))
    id_ = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST))
    docs = row.select("row", id_.alias("id"), F.col("row.text").cast("binary").alias("text"))
    gone = settle(removed_lines(docs.select("id", "text"), edits, min_bytes), "gone")
    touched = T.bitmap(gone.select(F.xxhash64("id").alias("h")), "h")
    named = docs.select(F.xxhash64("id").alias("h"), "row", "id", "text")
    schema = "row " + row.schema[0].dataType.simpleString() + ", id long, text binary"
    maybe, never = (named.mapInArrow(_side(touched, side), schema) for side in (True, False))
    parts = maybe.join(gone, "id", "left").select("row", "id", "text", "gone").unionByName(
        never.withColumn("gone", F.lit(None).cast(dict(gone.dtypes)["gone"])))
    return parts.mapInArrow(_strip, "row " + row.schema[0].dataType.simpleString() + ", kept string, n_lines long, n_removed long")
