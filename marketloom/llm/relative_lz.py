"""Relative Lempel-Ziv parse of documents, in words, against the blocks of earlier documents.

Blocks. A text is cut where its content says so: the windows of `width` words whose smallest
`k`-word hash lies at the same place form a block, so each window is in exactly one block,
and neighbouring blocks overlap by `width` - 1 words. That hash is the block's anchor.

Index. Every block of every document is a reference block. Sorted by anchor and name, each
name's first row (smallest doc_id, then smallest place) is its source; every other document
that holds the block is told that source. Nothing is kept of a key but its source, or, until
a second document turns up, the blocks of one document.

Parse. A text's own task goes through its blocks from the left and extends a factor while the
next block has the same source document and goes on there where the last one ended. A factor
is thus a copy: start, words, source, source_start. None is shorter than `width` words.

Factor boundaries. A block that no earlier document holds whole may still share windows with
one of another spelling around an equal anchor: the ends of copies, and copies shorter than a
block. Such blocks are compared in cells and, where these differ, window by window, by the
names and sorts of `repeats`. So no window is missed: what factors and these windows cover is
what `width` words cover that also start in a document with a smaller id.

Words are runs of anything but the six ASCII white-space characters, compared as they
are. A null or empty text has no words; a text shorter than `width` words loses none.
Rows with equal doc_id are one document seen again: they never remove each other, and a
factor may go on from one of them into the other. A null doc_id is smaller than none: its row
removes nothing and loses nothing. Each input row gives one row; extra columns are dropped.
Equal windows of one document tie without effect. An empty table gives no rows. A text of any
length is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import repeats as R
from marketloom.llm import text as T
from marketloom.session import settle

_U = np.uint64
LONGEST = 1 << 16  # windows in one covered span; longer factors give several
FACTORS = ["factor_starts", "factor_words", "factor_sources", "factor_source_starts"]


def _emit_blocks(kind: R.Kind):
    """Anchor, name, document and first place of each distinct block of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in T.chunks(batch):
                starts, ends, first = kind.units(data, offsets)
                doc, begin, _, anchor, block = R._runs_of(kind, kind.roll(data, starts, ends), first)
                _, one = np.unique(R._in_text(block, doc), return_index=True)
                if len(one):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(T.signed(anchor[one])), pa.array(T.signed(block[one])), pa.array(ids[a:b][doc[one]]), pa.array(begin[one] - first[doc[one]])],
                        names=["anchor", "block", "id", "at"])

    return T.tidy(run)


def _look_up():
    """Blocks sorted by anchor, name, id and place: COVERED ones with their source, and as
    PROBE each name's first row where an anchor has several names and several documents."""

    def pick(rows: list[np.ndarray], last: bool):
        anchor, block, ids, at, apart, spelled, sent = rows
        n = len(anchor)
        new_anchor, new_block = np.ones(n, bool), np.ones(n, bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_block[1:] = new_anchor[1:] | (block[1:] != block[:-1])
        lead, group, begin = R._firsts(new_block), np.cumsum(new_anchor) - 1, np.flatnonzero(new_anchor)
        apart = (np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)) | (np.maximum.reduceat(apart, begin) > 0)
        spelled = (np.bincount(group, weights=new_block) > 1) | (np.maximum.reduceat(spelled, begin) > 0)
        told = (apart & spelled)[group]
        role = np.where(ids != ids[lead], R.COVERED, np.where(new_block & told & (sent == 0), R.PROBE, 0))
        out = np.flatnonzero(role)
        # an anchor that may go on: its last source, or all of them until its role is known
        held = np.zeros(0, np.int64) if last else lead[-1:] if told[-1] else np.flatnonzero(new_block & (group == group[-1]))
        flags = [np.full(len(held), x, np.int64) for x in (apart[-1], spelled[-1], told[-1])]
        return [ids[out], block[out], role[out].astype(np.int8), ids[lead[out]], at[lead[out]]], [x[held] for x in (anchor, block, ids, at)] + flags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 7
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            rows = [np.concatenate([h, r]) for h, r in zip(held, new + [np.zeros(len(new[0]), np.int64)] * 3, strict=True)]
            if len(rows[0]):
                out, held = pick(rows, False)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["id", "block", "role", "source", "source_at"])

    return T.tidy(run)


def _factors(doc, begin, extra, source, source_at):
    """Greedy factors of covered blocks in text order: text, start, windows, source, source start."""
    head = np.ones(len(doc), bool)
    head[1:] = ((doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (begin[1:] != begin[:-1] + extra[:-1] + 1)
                | (source_at[1:] - source_at[:-1] != begin[1:] - begin[:-1]))
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(doc))[:len(heads)] - 1
    return doc[heads], begin[heads], begin[tails] + extra[tails] - begin[heads] + 1, source[heads], source_at[heads]


def _parse(kind: R.Kind):
    """Texts with what the index told of their blocks: factors, the windows these cover, and
    the cells of blocks that no earlier document holds whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (block, role, source, source_at) = R._lists(batch.column(3), "block", "role", "source", "source_at")
            for a, b, data, offsets in T.chunks(batch):
                starts, ends, first = kind.units(data, offsets)
                roll = kind.roll(data, starts, ends)
                doc, begin, end, _, here = R._runs_of(kind, roll, first)
                here, lo, hi = R._in_text(here, doc), int(at[a]), int(at[b])
                told, row = np.unique(R._in_text(block[lo:hi].view(_U), T.owners(np.diff(at[a:b + 1]))), return_index=True)
                found = np.searchsorted(told, here)
                known = np.flatnonzero(found < len(told))
                known = known[told[found[known]] == here[known]]
                row, doc, extra = lo + row[found[known]], doc[known], (end - begin)[known]
                begin = begin[known] - first[doc]
                hit, open_ = np.flatnonzero(role[row] == R.COVERED), np.flatnonzero(role[row] == R.PROBE)
                of, start, many, src, src_at = _factors(doc[hit], begin[hit], extra[hit], source[row[hit]], source_at[row[hit]])
                pieces = -(-many // LONGEST)
                left, owner = T.spread(np.zeros(len(many), np.int64), pieces) * LONGEST, T.owners(pieces)
                covered = (start[owner] + left) << 16 | np.minimum(many[owner] - left, LONGEST) - 1
                cell, low, high, core, name = R._cells(kind, roll, begin[open_] + first[doc[open_]], extra[open_])
                cell = doc[open_[cell]]

                def lists_of(owner, values):
                    order = np.argsort(owner, kind="stable")
                    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(b - a + 1)), pa.int32()), pa.array(values[order]))

                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(3)), lists_of(of[owner], covered),
                     lists_of(of, start), lists_of(of, many + kind.width - 1), lists_of(of, src), lists_of(of, src_at),
                     lists_of(cell, T.signed(core)), lists_of(cell, T.signed(name)), lists_of(cell, (low - first[cell]) << 17 | (high - low) << 1 | 1)],
                    names=["id", "doc_id", "text", "covered", *FACTORS, "cores", "spans", "places"])

    return T.tidy(run)


def _finish(kind: R.Kind, with_text: bool):
    """What `repeats` tells of each text, and its factors."""
    finish = R._finish(kind, with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, done = None, 0

        def feed():
            nonlocal here, done
            for batch in batches:
                here, done = batch, 0
                yield batch

        for out in finish(feed()):
            lists = [here.column(i).slice(done, out.num_rows) for i in range(5, 9)]
            done += out.num_rows
            sizes, words = lists[0].value_lengths().fill_null(0).to_numpy(), lists[1].flatten().to_numpy()
            longest = np.zeros(len(sizes), np.int64)
            np.maximum.at(longest, T.owners(sizes), words)
            more, names = [pa.array(sizes.astype(np.int64)), pa.array(longest)], ["n_factors", "longest_factor"]
            if with_text:
                more, names = more + lists, names + FACTORS
            yield pa.RecordBatch.from_arrays(out.columns + more, names=out.schema.names + names)

    return run


def drop_repeats(docs: DataFrame, width: int = 13, k: int = 4, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256, n_factors, longest_factor (words) of
    every row; `with_text` adds the removed spans (word numbers), the factors and the kept text."""
    kind = R.Kind(width, min(k, width), 3, True, True)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = docs.where("id IS NOT NULL").select("id", "text").mapInArrow(_emit_blocks(kind), "anchor long, block long, id long, at long")
    known = settle(blocks.repartition("anchor").sortWithinPartitions("anchor", "block", "id", "at").mapInArrow(
        _look_up(), "id long, block long, role byte, source long, source_at long"), "blocks")
    by_id = known.groupBy("id").agg(F.collect_set(F.struct("block", "role", "source", "source_at")).alias("blocks"))
    touched = T.bitmap(known.select(F.xxhash64("id").alias("h")).distinct(), "h")
    hashed = docs.select(F.xxhash64("id").alias("h"), "id", "doc_id", "text")
    maybe, never = (hashed.mapInArrow(R._split(touched, side), "id long, doc_id long, text binary") for side in (True, False))
    factors = ", ".join(f"{name} array<long>" for name in FACTORS)
    parsed = R.settle_by(maybe.join(by_id, "id", "left").mapInArrow(
        _parse(kind), f"id long, doc_id long, text binary, covered array<long>, {factors}, cores array<long>, spans array<long>, places array<long>"), "id", "parsed")

    cells = parsed.where(F.size("places") > 0).select("id", F.explode(F.arrays_zip("cores", "spans", "places")).alias("c")).select(
        F.col("c.cores").alias("sample"), F.col("c.spans").alias("span"), "id", F.col("c.places").alias("place"))
    decided = settle(cells.repartition("sample").sortWithinPartitions("sample", "span", "id", "place").mapInArrow(
        R._decide_runs(kind, False), "id long, place long, span long, role byte"), "cells")
    open_ = decided.where(F.col("role").bitwiseAND(F.lit(R.PROBE)) > 0).groupBy("id").agg(F.collect_set(F.struct("place", "span")).alias("cells"))
    windows = parsed.select("id", "text").join(open_, "id").select("id", "text", "cells").mapInArrow(R._open_windows(kind), "name long, id long, place long")
    single = windows.repartition("name").sortWithinPartitions("name", "id", "place").mapInArrow(R._decide_windows(kind), "id long, place long, span long")
    shut = decided.where((F.col("role").bitwiseAND(F.lit(R.COVERED)) > 0) & (F.col("place").bitwiseAND(F.lit(1)) == 1)).select(
        "id", F.shiftright("place", 1).alias("place"), "span")
    found = shut.unionByName(single).groupBy("id").agg(F.collect_set(F.struct("place", "span")).alias("found"))

    out = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string" + (
        ", span_starts array<long>, span_ends array<long>, kept binary" if with_text else "") + ", n_factors long, longest_factor long" + (
        f", {factors}" if with_text else "")

    none = {name: F.array().cast("array<long>").alias(name) for name in ("covered", *FACTORS)}
    rest = never.select("id", "doc_id", "text", none["covered"], F.array().cast("array<struct<place:bigint,span:bigint>>").alias("found"), *(none[f] for f in FACTORS))
    told = parsed.join(found, "id", "left").select("id", "doc_id", "text", "covered", "found", *FACTORS)
    both = rest.mapInArrow(_finish(kind, with_text), out).unionByName(told.mapInArrow(_finish(kind, with_text), out))
    return both.withColumn("kept", F.col("kept").cast("string")) if with_text else both
