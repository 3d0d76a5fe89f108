"""N-gram Jaccard self-join by set-relation skipping, and its connected groups.

A document's set holds its distinct word shingles. Equal sets are one node, so copies
are joined once. Tokens are ordered rare first (a fixed-size counting sketch over all
documents marks the frequent ones), a set's prefix are the tokens of which two similar
sets must share one, and inverted lists over prefixes are sorted by set size.

Relations between sets let most of each list be skipped:
* index level: a list is read in the block of sizes that can reach the threshold, and
  inside it entries are skipped by what their positions leave of both sets;
* answer level: each list first yields its members' pairs with its most central set and
  with one set each at random. Their verified links group the highly similar sets; a second reading then takes, of
  each list, the pairs between different groups alone: what a set shares with its own
  group need not be computed again, since the group already has the link. Whatever is
  not skipped is verified, so no link between groups is lost.

Pairs are first compared by parity sketches, whose Hamming distance bounds the symmetric
difference from below: one of 512 bits that travels with the lists, then one of at least
four bits a token. Only what both allow is compared by its sets. Groups are the connected
components, by repeated minimum labels with pointer jumping.

A-Z count as a-z. A text of fewer words than a shingle has its whole sequence as one;
without words or text the set is empty and linked with nothing. Rows repeat as documents
of their own with one node. A null doc_id is never the smallest of a group. Sets of one
size tie by their names, which changes no link. An empty table gives no rows. Columns
besides doc_id and text are not read, whatever their names. A text of any length is held
whole by one task.
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
SKETCH_BITS = 22
BLOCK_BITS = 12
PARITY_BITS = 512
PARITY = tuple(f"p{i}" for i in range(PARITY_BITS // 64))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 63-bit tokens of each text, ascending within it, and n + 1 offsets."""
    starts, ends, first = T.words(data, offsets)
    roll = T.Roll(T.byte_roll(_LOWER[data]).span(starts, ends))
    many = np.diff(first)
    size = np.where(many == 0, 0, np.maximum(many - n + 1, 1))
    at = T.spread(first[:-1], size)
    doc = T.owners(size)
    token = roll.span(at, at + np.minimum(many, n)[doc]) >> _U(1)
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    return token[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def node_of(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A name for each set."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(T.mix(token))])
    size = np.diff(bounds).astype(_U)
    return T.mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ T.mix(size + _U(1)))


def _parity(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of words for each set: whether it has an odd number of tokens in each cell."""
    sets = len(bounds) - 1
    cell = T.owners(np.diff(bounds)) * PARITY_BITS + (token & _U(PARITY_BITS - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=sets * PARITY_BITS) & 1).astype(np.uint8).reshape(sets, PARITY_BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def _members(n: int):
    """A row for each text (its node), and at the end of a partition its token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "key", "node", "n", *PARITY, "block", "counts"]
        seen = False
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch):
                seen = True
                token, bounds = shingle_sets(data, offsets, n)
                np.add.at(counts, (token >> _U(63 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                for c in range(a, b, 2000):
                    d = min(c + 2000, b)
                    part = bounds[c - a:d - a + 1]
                    own = token[part[0]:part[-1]]
                    parity = _parity(own, part - part[0])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(c, d - c), batch.column(1).slice(c, d - c), pa.array(T.signed(node_of(own, part - part[0]))), pa.array(np.diff(part)),
                         *(pa.array(np.ascontiguousarray(x)) for x in parity.T), pa.nulls(d - c, pa.int32()), pa.nulls(d - c, pa.binary())], names=names)
        if seen:
            blocks = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 1 << BLOCK_BITS)
            m = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(m, pa.int64()) for _ in range(4 + len(PARITY))),
                 pa.array(np.arange(m), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=names)

    return T.tidy(run)


def _frequent(members: DataFrame) -> np.ndarray:
    """Bitmap of the token buckets counted far above the mean; 2**SKETCH_BITS bits."""
    mean = (members.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    much = mean + 6 * mean**0.5 + 8

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals.setdefault(block, np.zeros(1 << BLOCK_BITS, np.int64))[:] += np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([np.packbits(x > much).tobytes() for x in totals.values()], pa.binary())], names=["block", "often"])

    rows = members.where("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, often binary").toArrow()
    out = np.zeros(1 << SKETCH_BITS >> 3, np.uint8)
    step = 1 << BLOCK_BITS >> 3
    for block, often in zip(rows["block"].to_pylist(), rows["often"].to_pylist(), strict=True):
        out[block * step:(block + 1) * step] = np.frombuffer(often, np.uint8)
    return out


def _ordered(token: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The tokens with the rare ones of each set first."""
    bucket = token >> _U(63 - SKETCH_BITS)
    often = frequent[(bucket >> _U(3)).astype(np.int64)] >> (_U(7) - (bucket & _U(7))).astype(np.uint8) & 1
    token = token | often.astype(_U) << _U(63)
    return token[np.lexsort((token, T.owners(np.diff(bounds))))]


def _prefixes(n: int, percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in T.chunks(batch):
                token, bounds = shingle_sets(data, offsets, n)
                node, one = np.unique(node_of(token, bounds), return_index=True)
                token = _ordered(token, bounds, frequent)
                size = np.diff(bounds)[one]
                one, node, size = one[size > 0], node[size > 0], size[size > 0]
                prefix = size - (percent * size + 99) // 100 + 1
                at, of, rank = T.spread(bounds[one], prefix), T.owners(prefix), T.within(prefix)
                before = np.where(rank > 0, token[at - 1], _U(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (T.signed(token[at]), T.signed(node[of]), size[of] << 32 | rank, T.signed(before))], names=["token", "node", "place", "before"])

    return T.tidy(run)


def _by_token(handle, columns: int):
    """Whole tokens at a time out of rows sorted by token: handle(rows) for each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * columns
        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [x[last:] for x in rows]
            if last:
                yield from handle([x[:last] for x in rows])
        if len(held[0]):
            yield from handle(held)

    return T.tidy(run)


def _lists(rows):
    """Lists of two sets or more. Each row has its list's lead, the set with the fewest rarer
    tokens before this one, which of a group of near copies is the most central, and the
    set that follows it in an order of the list's own."""
    token, place, node, before = rows
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1]) | (place[1:] != place[:-1])  # one set from many chunks
    token, place, node, before = token[new], place[new], node[new], before[new]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    group = np.cumsum(first) - 1
    begin, size = np.flatnonzero(first), np.bincount(group)
    lead = np.lexsort((node, place & 0xFFFFFFFF, group))[begin][group]
    own = np.lexsort((T.mix((node ^ token).view(_U)), group))
    follows = np.empty(len(own), np.int64)
    follows[own] = own[begin[group] + (T.within(size) + 1) % size[group]]
    many = size[group] > 1
    yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (token, node, place, before, node[lead], node[follows])],
                                     names=["token", "node", "place", "before", "lead", "follows"])


def _can_link(pa_, pb, percent: int) -> np.ndarray:
    """By sizes, and by what the positions of a shared token leave of both sets."""
    na, nb, ia, ib = pa_ >> 32, pb >> 32, pa_ & 0xFFFFFFFF, pb & 0xFFFFFFFF
    most = np.minimum(ia, ib) + 1 + np.minimum(na - ia, nb - ib) - 1
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def _between_groups(percent: int, most: int = 1 << 20):
    """Pairs of a list whose sets lie in different groups; rows sorted by token and size."""

    def handle(rows):
        token, place, node, label, before, *parity = rows
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        group = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        mixed = (np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin))[group]
        token, place, node, label, before, group = token[mixed], place[mixed], node[mixed], label[mixed], before[mixed], group[mixed]
        parity = [p[mixed] for p in parity]
        if not len(token):
            return
        size = place >> 32
        last = np.searchsorted(group, group, side="right")
        reach = 100 * size // percent  # largest set that can link with this one
        rank = group.astype(np.float64) * 2.0**32  # sizes ascend within a group
        stop = np.minimum(np.searchsorted(rank + size, rank + reach, side="right"), last)
        at = np.arange(len(token))
        many = np.maximum(stop - at - 1, 0)
        a, total = 0, np.cumsum(many)
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
            x, y = np.repeat(at[a:b], many[a:b]), T.spread(at[a:b] + 1, many[a:b])
            # with one token before it in both sets, the pair has met in that token's list
            ok = (label[x] != label[y]) & (node[x] != node[y]) & ((before[x] != before[y]) | (before[x] == 0))
            x, y = x[ok], y[ok]
            ok = _can_link(place[x], place[y], percent)
            x, y = x[ok], y[ok]
            apart = sum(np.bitwise_count((p[x] ^ p[y]).view(_U)).astype(np.int64) for p in parity)
            ok = (100 + percent) * apart <= (100 - percent) * ((place[x] >> 32) + (place[y] >> 32))
            one, two = node[x[ok]], node[y[ok]]
            if len(one):
                both = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
            a = b

    return _by_token(handle, 5 + len(PARITY))


def _apart(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches; the longer is folded to the shorter's size."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _parity_allows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([_apart(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], np.int64)
            total = batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array((100 + percent) * apart <= (100 - percent) * total))

    return T.tidy(run)


def _wide(token: np.ndarray) -> bytes:
    bits = 1 << max(10, (4 * len(token) - 1).bit_length())
    odd = np.bincount((token & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sets_of(n: int, wanted: np.ndarray):
    """Sets of the texts (key, text) whose key is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(T.in_bitmap(batch.column(0).to_numpy(), wanted)))
            for _, _, data, offsets in T.chunks(batch):
                token, bounds = shingle_sets(data, offsets, n)
                node, one = np.unique(node_of(token, bounds), return_index=True)
                sets = [token[bounds[i]:bounds[i + 1]] for i in one.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(T.signed(node)), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([_wide(x) for x in sets], pa.binary())], names=["node", "tokens", "wide"])

    return T.tidy(run)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked))

    return T.tidy(run)


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the short sketch allows."""
    one, two = (nodes.select(F.col("node").alias(end), F.struct("n", *PARITY).alias(f"at_{end}")) for end in "ab")
    apart = sum((F.bit_count(F.col(f"at_a.{p}").bitwiseXOR(F.col(f"at_b.{p}"))) for p in PARITY), F.lit(0))
    return pairs.join(one, "a").join(two, "b").where((100 + percent) * apart <= (100 - percent) * (F.col("at_a.n") + F.col("at_b.n"))).select("a", "b")


def _with_both(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """a, b, x, y and the sum of sizes: `column` of both nodes of each pair."""
    one, two = (nodes.select(F.col("node").alias(end), F.col(column).alias(v), F.col("n").alias(f"n{v}")) for end, v in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y", F.col("nx") + F.col("ny"))


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold."""
    allow = _parity_allows(percent)
    likely = settle(_likely(pairs, nodes, percent), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = T.bitmap(nodes.join(wanted, "node", "left_semi"), "key")
    sets = docs.select("key", "text").mapInArrow(_sets_of(n, keys), "node long, tokens binary, wide binary")
    sets = settle(sets.dropDuplicates(["node"]).join(wanted, "node", "left_semi").withColumn("n", F.octet_length("tokens").cast("long")), "sets")
    sure = settle(_with_both(likely, sets.withColumn("n", F.shiftright("n", 3)), "wide").mapInArrow(allow, "a long, b long"), "sure")
    return settle(_with_both(sure, sets, "tokens").mapInArrow(_verify(percent), "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node of the edges (a, b)."""
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "other").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = settle(low.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        labels = step.select("node", F.col("next").alias("label"))
        if step.where("next != label").isEmpty():
            return labels


def join_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the group), key (a name of
    the row's id and text) and first (whether the row is the group's first) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        "doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    found = settle(docs.mapInArrow(_members(n), "doc_id long, key long, node long, n long, " + "".join(f"{p} long, " for p in PARITY) + "block int, counts binary"), "members")
    frequent = _frequent(found)
    members = found.where("block is null").select("doc_id", "key", "node", "n", *PARITY)
    nodes = settle(members.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.min("n").alias("n"), *[F.min(p).alias(p) for p in PARITY]), "nodes")
    prefixes = docs.select("text").mapInArrow(_prefixes(n, percent, frequent), "token long, node long, place long, before long")
    lists = settle(prefixes.select("token", "place", "node", "before").repartition("token").sortWithinPartitions("token", "place", "node").mapInArrow(
        _by_token(_lists, 4), "token long, node long, place long, before long, lead long, follows long"), "lists")
    # a quarter of the lists finds nearly all groups; the second reading takes them all
    pairs = lists.where(F.col("token").bitwiseAND(F.lit(3)) == 0).select("node", F.explode(F.array("lead", "follows")).alias("other")).where(
        "node != other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = _links(docs, nodes, pairs, n, percent)
    groups = components(links)
    labelled = lists.join(groups, "node", "left").join(nodes, "node").select("token", "place", "node", F.coalesce("label", "node").alias("label"), "before", *PARITY)
    rest = settle(labelled.repartition("token").sortWithinPartitions("token", "place", "node").mapInArrow(
        _between_groups(percent), "a long, b long").distinct(), "between")
    more = _links(docs, nodes, rest, n, percent)
    # the groups found so far are paths to their labels
    groups = components(groups.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    labelled = members.join(groups, "node", "left").select(
        "doc_id", "key", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))
    smallest = labelled.where("label is not null").groupBy("label").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("first_key"))
    return labelled.join(smallest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "key",
        F.coalesce(F.col("key") == F.col("first_key"), F.lit(True)).alias("first"))


def first_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each group, by doc_id with null last, all columns as given. Of rows
    that repeat its id and text, one stays. Rows with an empty set are groups of their own."""
    groups = settle(join_groups(docs, n, percent), "groups")
    gone = groups.where("not first").select("key").distinct()
    again = groups.where("first and n_shingles > 0").groupBy("key").count().where("count > 1").select("key")
    rows = docs.select(F.struct("*").alias("row")).withColumn("key", F.xxhash64(F.col("row.doc_id").cast("long"), "row.text"))
    kept = rows.join(gone, "key", "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, "key", "left_anti").unionByName(kept.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select("row.*")
