"""Sum-of-squares packing: documents become token pieces, pieces fill sequences.

Each piece goes where the sum, over residual gaps, of the squared number of open bins
with that gap becomes smallest; a new bin is one of the choices. Pieces come longest first,
which leaves the fewest bins; pieces of one length come in the order of their checksums. A
piece as long as a sequence fills one alone. The pieces are dealt by hash into groups of
about `group` pieces, and each group is packed by one task: it costs at most the few bins
that each group leaves open, and no task or driver sees all pieces. Within a group the
places are the same on every run.

Null and empty texts are one piece holding the end id alone. Repeated rows are packed
as often as they occur. An empty table gives no rows. Columns beside the id and the
text are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import text as T
from marketloom.session import settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_LETTER = ((np.arange(256) >= 65) & (np.arange(256) <= 90)) | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


class WordTokens:
    """Token ids by word, remembered while the worker lives. The tokenizer drops white
    space and never joins what white space parts, nor letters and the stops after them,
    so a text's ids are its words' ids in a row."""

    SLOTS = 20  # 2**20 slots; a word sits in one of two, a newer word may take its place
    MOST_IDS = 2_000_000  # ids remembered; beyond that the memory starts anew
    _made: dict[str, "WordTokens"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in model["vocab"].items():
            self.closes[i] = bool(self.suffix) and token.endswith(self.suffix)
        self.forget()

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        return cls._made.setdefault(path, None) or cls._made.__setitem__(path, cls(path)) or cls._made[path]

    def forget(self) -> None:
        self.keys, self.values = np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys >> np.uint64(64 - self.SLOTS)).astype(np.int64), (keys & np.uint64((1 << self.SLOTS) - 1)).astype(np.int64)

    def learn(self, keys: np.ndarray, spelled: list[str]) -> np.ndarray:
        """Values of new words: where their ids begin, and how many, in one number."""
        simple = [i for i, w in enumerate(spelled) if self.suffix and (
            w.isascii() and (w.isalpha() or not w.strip(".,;:!?")) or w.isalpha() and max(w) < "ɐ" and "İ" not in w)]
        many, parts = np.zeros(len(spelled), np.int64), [None] * len(spelled)
        for a in range(0, len(simple), 1000):  # each is one pre-token: its last id closes a word
            block = simple[a:a + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(spelled[i] for i in block), add_special_tokens=False).ids, np.int32)
            cut = np.flatnonzero(self.closes[ids]) + 1
            if len(cut) != len(block):
                raise ValueError("the tokenizer parts words otherwise than expected")
            for i, part in zip(block, np.split(ids, cut[:-1]), strict=True):
                parts[i], many[i] = part, len(part)
        rest = [i for i, p in enumerate(parts) if p is None]
        for i, found in zip(rest, self.tokenizer.encode_batch([spelled[i] for i in rest], add_special_tokens=False), strict=True):
            parts[i], many[i] = np.array(found.ids, np.int32), len(found.ids)
        flat = np.concatenate(parts)
        at = self.n_ids + np.cumsum(many) - many
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        self.ids[self.n_ids:self.n_ids + len(flat)] = flat
        self.n_ids += len(flat)
        values = at << 24 | many
        one, two = self.slots(keys)
        at = np.where(self.keys[one] == 0, one, two)
        self.keys[at], self.values[at] = keys, values
        return values

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, `end_id` after each text, and n + 1 offsets of the texts."""
        starts, ends, first = T.words(data, offsets)
        if len(starts):
            # "word," is "word" and ",": cut where stops up to the end follow an ASCII letter
            stop = _STOP[data]
            last_other = np.maximum.accumulate(np.where(stop, -1, np.arange(len(data))))[ends - 1]
            cut = np.flatnonzero((last_other >= starts) & (last_other < ends - 1) & _LETTER[data[last_other]])
            starts = np.insert(starts, cut + 1, last_other[cut] + 1)
            ends = np.insert(ends, cut, last_other[cut] + 1)
            first = np.searchsorted(starts, offsets)
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) else np.zeros(0, np.int64)
        folded = _LOWER[data]
        keys = T.byte_roll(folded).span(starts, ends)
        if len(special):  # "<|": special tokens keep their case
            held = np.unique(np.searchsorted(starts, special, side="right") - 1)
            held = held[held >= 0]
            keys[held] = T.byte_roll(data).span(starts[held], ends[held]) ^ np.uint64(0x5851F42D4C957F2D)
        if self.n_ids > self.MOST_IDS:
            self.forget()
        one, two = self.slots(keys)
        values = np.where(self.keys[one] == keys, self.values[one], np.where(self.keys[two] == keys, self.values[two], -1))
        new = np.flatnonzero(values < 0)
        if len(new):
            distinct, sample, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            whole = folded.tobytes()
            raw = data.tobytes() if len(special) else whole
            is_held = set(held.tolist()) if len(special) else ()
            values[new] = self.learn(distinct, [(raw if s in is_held else whole)[starts[s]:ends[s]].decode("utf-8", "replace")
                                                for s in new[sample].tolist()])[inverse]
        where, many = values >> 24, values & 0xFFFFFF
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        per_doc = np.bincount(doc, weights=many, minlength=len(offsets) - 1).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        out = np.full(bounds[-1], end_id, np.int32)
        keep = np.ones(bounds[-1], bool)
        keep[bounds[1:] - 1] = False
        out[keep] = self.ids[T.spread(where, many)]
        return out, bounds


def _pieces(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordTokens.of(path)
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch):
                ids, bounds = memory.encode(data, offsets, end_id)
                total = np.diff(bounds)
                many = -(-total // length)
                doc, piece = T.owners(many), T.within(many)
                start = piece * length
                size = np.minimum(total[doc] - start, length)
                view = memoryview(ids.astype("<u4").tobytes())
                at = (bounds[doc] + start) * 4
                crc = [zlib.crc32(view[x:x + 4 * n]) for x, n in zip(at.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return T.tidy(run)


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1) -> DataFrame:
    """Each document's ids, `end_id` last, cut into pieces of `length`; the last may be shorter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _pieces(tokenizer, length, end_id), PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (all within the capacity), in the given order."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; full bins do not count
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        new_cost = 2 * open_bins[capacity - s] + 1 if s < capacity else 0
        have = open_bins[s:]
        cost = 2 * (open_bins[:capacity + 1 - s] - have) + 2
        cost[0] -= 1  # the bin becomes full and leaves the count
        cost[have == 0] = np.iinfo(np.int64).max
        gap = int(np.argmin(cost))
        if cost[gap] <= new_cost:
            gap += s
            b = held[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        left = gap - s
        if left:
            held[left].append(b)
            open_bins[left] += 1
        bins[i], offsets[i] = b, capacity - gap
    return bins, offsets


def _pack(length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        size = table["length"].to_numpy()
        order = np.lexsort((table["piece"].to_numpy(), table["doc_id"].fill_null(-1).to_numpy(), table["ids_crc32"].to_numpy(), -size))
        bins, offsets = sum_of_squares(size[order], length)
        table = table.take(pa.array(order))
        return pa.table([*(table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array((key[0].as_py() << 32) + bins), pa.array(offsets)],
                        names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, group: int = 100_000, seed: int = 11) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = settle(token_pieces(docs, tokenizer, length, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(_pack(length), PACKED)
