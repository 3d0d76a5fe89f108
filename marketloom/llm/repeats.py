"""Repeated windows of a fixed width, found without a row per window.

A sequence (words or bytes of a text) has a window at every position. Each window picks
one sample inside it, the position of its smallest hash over `k` units: equal windows
pick the same place, so they meet at equal samples. Neighbouring windows mostly pick the
same sample and form a run of window starts, so a text of n units has about
2n / (width - k + 2) runs. A run has a name (hash) of its sample and a name of its whole
span, from the first window's start to the last window's end. Then:

* runs whose sample name occurs once are dropped: none of their windows repeats;
* sorted by (sample name, span name), neighbours with equal spans decide all windows of
  the run at once;
* where one sample name has several spans, the first row of each span is cut into cells of
  `cell` window starts, on a grid that the sample fixes. A cell has a name of its own span
  and one of its core, the units that all windows of the grid cell share. Cells are sorted
  and decided as the runs were, with the core in the sample's place;
* what still differs around an equal core, the edges of repeats, gives its windows one by
  one, and these are sorted by name and decided by their neighbours.

All three sorts stream: a task keeps no more of a key's rows than one for each span.

Two questions are answered: `EARLIER` (does the window also start in a document with a
smaller id?) and `ELSEWHERE` (does it start at any other place?). A text sends each of its
spans once. Rows repeat, so what is found for an id holds for the spans of that name in
each text with that id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import text as T
from marketloom.session import scratch_path, settle

RUNS = "sample long, span long, id long, twice long"
_U = np.uint64
COVERED, PROBE = 1, 2


@dataclass(frozen=True)
class Kind:
    """What a window is. Texts are cut into units by `units`: unit starts, unit ends and
    the first unit of each text; `values` are the units' 64-bit values."""

    width: int
    k: int
    cell: int
    by_words: bool
    earlier: bool  # only windows of smaller ids count; else any other place

    def units(self, data: np.ndarray, offsets: np.ndarray):
        if not self.by_words:
            return None, None, offsets
        return T.words(data, offsets)

    def roll(self, data: np.ndarray, starts, ends) -> T.Roll:
        if not self.by_words:
            return T.byte_roll(data)
        return T.Roll(T.byte_roll(data).span(starts, ends))


def _runs_of(kind: Kind, roll: T.Roll, first: np.ndarray):
    """Runs of a chunk: text, first and last window start (units of the chunk), names."""
    n_units = first[-1]
    none = np.zeros(0, np.int64)
    if n_units < kind.width:
        return none, none, none, none.view(_U), none.view(_U)
    at = np.arange(n_units - kind.k + 1)
    names = roll.span(at, at + kind.k)
    low = _U(32)  # the upper half of the name, then the place: the same rule in every chunk
    packed = (names >> low << low) | at.astype(_U)
    picked = (T.window_minimum(packed, kind.width - kind.k + 1) & ((_U(1) << low) - _U(1))).astype(np.int64)
    many = np.diff(first)
    doc = T.owners(many)[:len(picked)]
    whole = np.arange(len(picked)) + kind.width <= first[1:][doc]
    change = np.ones(len(picked), bool)
    change[1:] = (picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1])
    begins = np.flatnonzero(change & whole)
    stop = np.ones(len(picked), bool)
    stop[:-1] = change[1:] | ~whole[1:]
    ends = np.flatnonzero(stop & whole)
    return doc[begins], begins, ends, names[picked[begins]], roll.span(begins, ends + kind.width)


def _in_text(span: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Names of spans within their text."""
    return span ^ T.mix(doc.astype(_U) + _U(1))


def _emit_runs(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in T.chunks(batch):
                starts, ends, first = kind.units(data, offsets)
                doc, _, _, sample, span = _runs_of(kind, kind.roll(data, starts, ends), first)
                # once a text, however often it repeats a span itself
                _, one, many = np.unique(_in_text(span, doc), return_index=True, return_counts=True)
                if len(one):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(T.signed(sample[one])), pa.array(T.signed(span[one])), pa.array(ids[a:b][doc[one]]), pa.array((many > 1).astype(np.int64))],
                        names=["sample", "span", "id", "twice"])

    return T.tidy(run)


def _firsts(change: np.ndarray) -> np.ndarray:
    """For each row the index of the first row of its group, given where groups begin."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def _decide_runs(kind: Kind, counted: bool):
    """Rows (sample, span, id, and `twice` if counted, else place) sorted; out go rows with
    something to do."""

    def pick(rows: list[np.ndarray], last: bool):
        sample, span, ids, place, seen = rows
        n = len(sample)
        new_sample, new_span = np.ones(n, bool), np.ones(n, bool)
        new_sample[1:] = sample[1:] != sample[:-1]
        new_span[1:] = new_sample[1:] | (span[1:] != span[:-1])
        lead = _firsts(new_span)
        group = np.cumsum(new_sample) - 1
        spans = np.bincount(group, weights=new_span)
        many = spans[group] > 1
        if kind.earlier:
            first = ids == ids[lead]
            begin = np.flatnonzero(new_sample)
            several = ((np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)) | (np.maximum.reduceat(seen, begin) > 0))[group]
            covered, many, note = ~first, many & several, several
        else:
            first = lead == np.arange(n)
            of = np.cumsum(new_span) - 1
            again = np.maximum.reduceat(seen, np.flatnonzero(new_span))
            covered = note = ~first | (np.bincount(of)[of] > 1) | (again[of] > 0)
        open_ = np.zeros(n, bool) if last else group == group[-1]
        # first rows of a key that may go on wait; what is known of the key is kept with them
        wait = open_ & first
        role = np.where(covered, COVERED, 0) | np.where(first & many, PROBE, 0)
        out = (role > 0) & ~wait
        keep = [x[wait] for x in (sample, span, ids, place)] + [note[wait].astype(np.int64)]
        return [sample[out], span[out], ids[out], place[out], role[out]], keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            seen = rows[3] if counted and not kind.earlier else np.zeros(len(rows[0]), np.int64)
            rows = [np.concatenate([h, r]) for h, r in zip(held, [*rows, seen], strict=True)]
            if not len(rows[0]):
                continue
            out, held = pick(rows, False)
            yield from send(out)
        if len(held[0]):
            yield from send(pick(held, True)[0])

    def send(out):
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(out[2]), pa.array(out[3]), pa.array(out[1]), pa.array(out[4].astype(np.int8))], names=["id", "place", "span", "role"])

    return T.tidy(run)


def _lists(columns: pa.Array, *fields: str):
    """Row offsets and the flat fields of a column of lists of structs."""
    flat = columns.flatten()
    return np.concatenate([[0], np.cumsum(columns.value_lengths().fill_null(0).to_numpy())]), [flat.field(f).to_numpy() for f in fields]


def _own(kind: Kind, roll: T.Roll, first: np.ndarray, doc: np.ndarray, begin: np.ndarray, extra: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which spans are in the text under their name: others belong to another text with this id."""
    fits = np.flatnonzero(begin + extra + kind.width <= np.diff(first)[doc])
    at = begin[fits] + first[doc[fits]]
    return fits[roll.span(at, at + extra[fits] + kind.width) == name[fits].view(_U)]


def _cells(kind: Kind, roll: T.Roll, begin: np.ndarray, extra: np.ndarray):
    """Cells of runs (in units of the chunk): run, first and last window start, core and span names."""
    if not len(begin):
        return begin, begin, begin, begin.view(_U), begin.view(_U)
    inner = kind.width - kind.k + 1
    at = T.spread(begin, np.full(len(begin), inner))
    packed = (roll.span(at, at + kind.k) >> _U(32) << _U(32)).reshape(-1, inner)
    sample = begin + packed.argmin(axis=1)  # the first of equal ones, as in the runs
    w, run = T.spread(begin, extra + 1), T.owners(extra + 1)
    grid = (sample[run] - w) // kind.cell
    new = np.ones(len(w), bool)
    new[1:] = (grid[1:] != grid[:-1]) | (run[1:] != run[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(w)) - 1
    run, q, low, high = run[head], grid[head], w[head], w[tail]
    left = sample[run] - q * kind.cell
    core = T.mix(roll.span(left, left - kind.cell + 1 + kind.width) + q.astype(_U))
    return run, low, high, core, roll.span(low, high + kind.width)


def _probe(kind: Kind):
    """Texts with their runs: covered windows as spans, the cells still to be decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (span, role) = _lists(batch.column(3), "span", "role")
            for a, b, data, offsets in T.chunks(batch):
                starts, ends, first = kind.units(data, offsets)
                roll = kind.roll(data, starts, ends)
                doc, begin, end, _, here = _runs_of(kind, roll, first)
                rows = slice(at[a], at[b])
                told, of = np.unique(_in_text(span[rows].view(_U), T.owners(np.diff(at[a:b + 1]))), return_inverse=True)
                does = np.zeros(len(told) + 1, np.int64)
                np.bitwise_or.at(does, of, role[rows].astype(np.int64))
                here = _in_text(here, doc)
                found = np.searchsorted(told, here)
                known = (found < len(told)) & (told[np.minimum(found, len(told) - 1)] == here) if len(told) else np.zeros(len(here), bool)
                begin, extra, doc, does = (begin - first[doc])[known], (end - begin)[known], doc[known], does[found[known]]
                covered, probes = (does & COVERED) > 0, np.flatnonzero(does & PROBE)
                of, low, high, core, name = _cells(kind, roll, begin[probes] + first[doc[probes]], extra[probes])
                of = probes[of]
                cells = (low - first[doc[of]]) << 17 | (high - low) << 1 | ~covered[of]

                def lists_of(owner, values):
                    order = np.argsort(owner, kind="stable")
                    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(b - a + 1)), pa.int32()), pa.array(values[order]))

                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(3)), lists_of(doc[covered], (begin << 16 | extra)[covered]),
                     lists_of(doc[of], T.signed(core)), lists_of(doc[of], T.signed(name)), lists_of(doc[of], cells)],
                    names=["id", "doc_id", "text", "covered", "cores", "spans", "places"])

    return T.tidy(run)


def _open_windows(kind: Kind):
    """Windows of texts (id, text, cells) still undecided: name, id and place << 1 | wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at, (place, span) = _lists(batch.column(2), "place", "span")
            for a, b, data, offsets in T.chunks(batch):
                starts, ends, first = kind.units(data, offsets)
                roll = kind.roll(data, starts, ends)
                doc, rows = T.owners(np.diff(at[a:b + 1])), slice(at[a], at[b])
                begin, extra, wanted = place[rows] >> 17, place[rows] >> 1 & 0xFFFF, place[rows] & 1
                own = _own(kind, roll, first, doc, begin, extra, span[rows])
                begin, extra, doc, wanted = begin[own], extra[own], doc[own], wanted[own]
                w, of = T.spread(begin, extra + 1), T.owners(extra + 1)
                x = w + first[doc[of]]
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(roll.span(x, x + kind.width))), pa.array(ids[a:b][doc[of]]), pa.array(w << 1 | wanted[of])], names=["name", "id", "place"])

    return T.tidy(run)


def _decide_windows(kind: Kind):
    """Rows (name, id, place << 1 | wanted) sorted by name and id: wanted repeated ones."""

    def pick(rows, last: bool):
        name, ids, place, seen = rows
        n = len(name)
        new = np.ones(n, bool)
        new[1:] = name[1:] != name[:-1]
        lead = _firsts(new)
        if kind.earlier:
            first = ids == ids[lead]
            repeated = ~first
        else:
            first = lead == np.arange(n)
            of = np.cumsum(new) - 1
            again = np.maximum.reduceat(seen, np.flatnonzero(new))
            repeated = ~first | (np.bincount(of)[of] > 1) | (again[of] > 0)
        wait = np.zeros(n, bool) if last else first & (lead == lead[-1])
        out = repeated & ~wait & ((place & 1) > 0)
        return [ids[out], place[out] >> 1 << 16, name[out]], [x[wait] for x in (name, ids, place)] + [repeated[wait].astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            rows = [np.concatenate([h, r]) for h, r in zip(held, [*rows, np.zeros(len(rows[0]), np.int64)], strict=True)]
            if len(rows[0]):
                out, held = pick(rows, False)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["id", "place", "span"])
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pick(held, True)[0]], names=["id", "place", "span"])

    return T.tidy(run)


def _split(touched: np.ndarray, side: bool):
    """Texts whose id may have runs, or those whose id has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = T.in_bitmap(batch.column(0).to_numpy(), touched) == side
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=["id", "doc_id", "text"]).filter(pa.array(here))

    return T.tidy(run)


def _finish(kind: Kind, with_text: bool):
    """Removed units of each text: those covered by the spans of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered = batch.column(3)
            cat, cflat = np.concatenate([[0], np.cumsum(covered.value_lengths().fill_null(0).to_numpy())]), covered.flatten().to_numpy()
            sat, (splace, sname) = _lists(batch.column(4), "place", "span")
            for a, b, data, offsets in T.chunks(batch):
                starts, ends, first = kind.units(data, offsets)
                c, cdoc = cflat[cat[a]:cat[b]], T.owners(np.diff(cat[a:b + 1]))
                s, sdoc = splace[sat[a]:sat[b]], T.owners(np.diff(sat[a:b + 1]))
                if len(s):
                    own = _own(kind, kind.roll(data, starts, ends), first, sdoc, s >> 16, s & 0xFFFF, sname[sat[a]:sat[b]])
                    c, cdoc = np.concatenate([c, s[own]]), np.concatenate([cdoc, sdoc[own]])
                begin, size = (c >> 16) + first[cdoc], (c & 0xFFFF) + kind.width
                n = int(first[-1])
                edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + size, minlength=n + 1)
                gone = np.cumsum(edge)[:n] > 0
                spans_from, spans_to, spans_first = T.runs(~gone, first)
                n_removed = np.concatenate([[0], np.cumsum(gone)])
                n_removed = n_removed[first[1:]] - n_removed[first[:-1]]
                kept = []
                for i in range(b - a):
                    lo, hi = int(first[i]), int(first[i + 1])
                    if kind.by_words:
                        spelled = data[starts[lo]:ends[hi - 1]].tobytes().split() if hi > lo else []
                        kept.append(b" ".join([spelled[w] for w in np.flatnonzero(~gone[lo:hi]).tolist()] if n_removed[i] else spelled))
                    else:
                        kept.append(data[lo:hi][~gone[lo:hi]].tobytes() if n_removed[i] else data[lo:hi].tobytes())
                doc = T.owners(np.diff(spans_first))
                out = [batch.column(1).slice(a, b - a), pa.array(np.diff(first)), pa.array(n_removed), pa.array(np.diff(spans_first)),
                       pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    out += [pa.ListArray.from_arrays(pa.array(spans_first, pa.int32()), pa.array((spans_from - first[doc]).astype(np.int64))),
                            pa.ListArray.from_arrays(pa.array(spans_first, pa.int32()), pa.array((spans_to - first[doc]).astype(np.int64))), pa.array(kept, pa.binary())]
                    names += ["span_starts", "span_ends", "kept"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return T.tidy(run)


def settle_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write `df` bucketed by `key` in the shared folder and read it back: later joins on
    the key leave these rows where they are and move only the other side."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = f"{label}_{path[-32:]}"
    (df.write.option("path", path).option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
     .sortBy(key).saveAsTable(name))
    return spark.table(name)


def remove_repeats(docs: DataFrame, kind: Kind, with_text: bool = False) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 of every row of (id, doc_id, text); with
    `with_text` also the removed spans (unit numbers) and the kept bytes."""
    docs = docs.select("id", "doc_id", F.col("text").cast("binary").alias("text"))
    runs = docs.where("id IS NOT NULL").select("id", "text").mapInArrow(_emit_runs(kind), RUNS)
    todo = settle(runs.repartition("sample").sortWithinPartitions("sample", "span", "id").mapInArrow(
        _decide_runs(kind, True), "id long, place long, span long, role byte").select("id", "span", "role"), "runs")
    by_id = todo.groupBy("id").agg(F.collect_set(F.struct("span", "role")).alias("runs"))
    touched = T.bitmap(todo.select(F.xxhash64("id").alias("h")).distinct(), "h")
    hashed = docs.select(F.xxhash64("id").alias("h"), "id", "doc_id", "text")
    maybe, never = (hashed.mapInArrow(_split(touched, side), "id long, doc_id long, text binary") for side in (True, False))
    probed = settle_by(maybe.join(by_id, "id", "left").mapInArrow(
        _probe(kind), "id long, doc_id long, text binary, covered array<long>, cores array<long>, spans array<long>, places array<long>"), "id", "probed")
    cells = probed.where(F.size("places") > 0).select("id", F.explode(F.arrays_zip("cores", "spans", "places")).alias("c")).select(
        F.col("c.cores").alias("sample"), F.col("c.spans").alias("span"), "id", F.col("c.places").alias("place"))
    decided = settle(cells.repartition("sample").sortWithinPartitions("sample", "span", "id", "place").mapInArrow(_decide_runs(kind, False), "id long, place long, span long, role byte"), "cells")
    open_ = decided.where(F.col("role").bitwiseAND(F.lit(PROBE)) > 0).groupBy("id").agg(F.collect_set(F.struct("place", "span")).alias("cells"))
    windows = probed.select("id", "text").join(open_, "id").select("id", "text", "cells").mapInArrow(_open_windows(kind), "name long, id long, place long")
    single = windows.repartition("name").sortWithinPartitions("name", "id", "place").mapInArrow(_decide_windows(kind), "id long, place long, span long")
    shut = decided.where((F.col("role").bitwiseAND(F.lit(COVERED)) > 0) & (F.col("place").bitwiseAND(F.lit(1)) == 1)).select(
        "id", F.shiftright("place", 1).alias("place"), "span")
    found = shut.unionByName(single).groupBy("id").agg(F.collect_set(F.struct("place", "span")).alias("found"))
    out = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string" + (
        ", span_starts array<long>, span_ends array<long>, kept binary" if with_text else "")
    ready = never.select("id", "doc_id", "text", F.array().cast("array<long>").alias("covered"), F.array().cast("array<struct<place:bigint,span:bigint>>").alias("found"))
    return ready.mapInArrow(_finish(kind, with_text), out).unionByName(
        probed.select("id", "doc_id", "text", "covered").join(found, "id", "left").mapInArrow(_finish(kind, with_text), out))
