"""Compression classifier: a text is good if a dictionary of good texts packs it better.

Two zstandard dictionaries are trained on good and on bad labelled texts. A text is
compressed block by block with each, so that the dictionaries count from its first to
its last byte. Its feature is the difference of the two compressed sizes over its length;
a logistic curve fitted on labelled texts that trained no dictionary turns it into a score.

Fitting takes a bounded sample: at most `per_class` labelled rows of each class, those
with the smallest seeded hash of the id, half for the dictionaries and half for the
curve. Labels are read there and nowhere else. Scoring compresses every whole text. A
null or empty text has feature 0. Repeated rows are scored alike. Without labelled rows
of both classes every score is one half. Ids that tie in the hash are taken by id. An empty
table gives no rows. A text of any length is compressed whole, in blocks, by one task; texts
over `longest` bytes are not fitted on. Columns besides doc_id and text are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes compressed at once.
BLOCK = 1024


@cache
def _packers(good: bytes, bad: bytes, level: int):
    import zstandard

    out = []
    for raw in (good, bad):
        trained = zstandard.ZstdCompressionDict(raw)
        trained.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=trained, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def features(texts: list[bytes], good: bytes, bad: bytes, level: int) -> np.ndarray:
    by_good, by_bad = _packers(good, bad, level)
    good_size, bad_size = by_good.compress, by_bad.compress
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        gain = 0
        for a in range(0, len(t), BLOCK):
            block = t[a:a + BLOCK]
            gain += len(bad_size(block)) - len(good_size(block))
        out[i] = gain / len(t) if t else 0.0
    return out


class Model:
    """Two dictionaries and a logistic curve: score = 1 / (1 + exp(-(a + b * feature)))."""

    def __init__(self, good: bytes, bad: bytes, level: int, a: float, b: float):
        self.good, self.bad, self.level, self.a, self.b = good, bad, level, a, b

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * features(texts, self.good, self.bad, self.level), -700, 700)))


def train(good: list[bytes], bad: list[bytes], dictionary: int = 112_640, level: int = 3) -> Model:
    import zstandard

    if len(good) < 16 or len(bad) < 16:
        return Model(b"", b"", level, 0.0, 0.0)
    made = []
    for texts in (good[::2], bad[::2]):
        cut = [t[i:i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
        size = min(dictionary, max(1024, sum(map(len, cut)) // 8))
        made.append(zstandard.train_dictionary(size, cut, threads=1).as_bytes())
    rest = good[1::2], bad[1::2]
    x = np.concatenate([features(t, *made, level) for t in rest])
    y = np.concatenate([np.ones(len(rest[0])), np.zeros(len(rest[1]))])
    scale = max(float(np.std(x)), 1e-9)
    design, w = np.stack([np.ones(len(x)), x / scale], 1), np.zeros(2)
    for _ in range(50):  # Newton steps, with a little shrinkage so that parted classes converge
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + 1e-2 * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w -= np.linalg.solve(curve, gradient)
    return Model(*made, level, float(w[0]), float(w[1] / scale))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, seed: int = 5, longest: int = 1 << 16, **how) -> Model:
    """Train on rows of `labels` (held-out ones must not be among them). The sample is at
    most 2 * per_class texts, none of over `longest` bytes, and is all the driver sees."""
    ids: list[tuple[int, int]] = []
    for wanted in (1, 0):
        ids += [(r[0], wanted) for r in labels.where((F.col(label) == wanted) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
                .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class).collect()]
    known = {}
    for i, wanted in ids:
        known.setdefault(i, wanted)
    if not known:
        return train([], [])
    rows = (docs.where(F.col("doc_id").isin(list(known)) & (F.octet_length("text") <= longest)).groupBy("doc_id")
            .agg(F.min("text").alias("text")).select("doc_id", F.col("text").cast("binary").alias("text")).orderBy("doc_id").toArrow())
    found = list(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True))
    return train(*[[t for i, t in found if t and known[i] == wanted] for wanted in (1, 0)], **how)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t or b"" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_score(model), "doc_id long, score double")
