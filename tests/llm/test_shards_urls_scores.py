"""Two-pass shuffle, URL vocabulary and compression classifier."""

import random
import re
import zlib

import numpy as np

from marketloom.llm import compression_classifier as C
from marketloom.llm import two_pass_shuffle as S
from marketloom.llm import url_vocabulary as U


def test_shards(spark, tmp_path):
    rows = [(i, "w" * (i % 50), 1) for i in range(300)] + [(7, None, 1), (7, "", 1), (None, "é", 1), (8, "same", 1), (8, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    for bucket in (1 << 20, 200):
        placed = S.shuffle_into_shards(docs, shards=8, bucket_bytes=bucket)
        got = placed.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((i, t) for i, t, _ in rows), key=repr)
        for shard in range(8):
            slots = sorted(r.slot for r in got if r.shard == shard)
            assert slots == list(range(len(slots))) and len(rows) // 8 <= len(slots) <= len(rows) // 8 + 1
        assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
        again = S.shuffle_into_shards(docs.repartition(2), shards=8, bucket_bytes=bucket).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got))
    S.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 8
    assert S.shuffle_into_shards(docs.limit(0)).count() == 0


def test_fisher_yates_is_even():
    seen = np.zeros((6, 6))
    for seed in range(3000):
        seen[np.arange(6), S.fisher_yates(6, seed)] += 1
    assert abs(seen - 500).max() < 110


def test_urls(spark):
    urls = [None, "", "no scheme/spam", "http://Spam.example.net/x", "https://a.b.net/", "http://net/", "http://example.net/en/casino", "http://x.example.com/de/1?a=b#c",
            "https://w.example.org/fr/spam", "https://example.org/free-win", "https://example.org/free-free", "https://example.org/freewin?casino", "https://ex.org#frag/casino",
            "ftp://ADS.track.io/é/pörn", "https://example.org/sussex", "http://e.org/xxx?u=://a.net/", "https://aorg/fr/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.judge(pages).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r, _ in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        words = set(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), host + path)))
        block = bool(words & set(U.STRICT)) or len(words & set(U.SOFT)) >= 2
        verdict = dict(U.RULES)[rule] if rule else "block" if block else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), url


def _prose(r, good):
    words = ["river", "stone", "walks", "under", "the", "bright", "morning", "and", "sings"] if good else ["BUY", "NOW!!", "$$$", "click", "FREE", "###", "win"]
    return " ".join(r.choice(words) for _ in range(r.randrange(30, 200)))


def test_classifier_on_held_out_texts(spark):
    r = random.Random(2)
    rows = [(i, _prose(r, i % 2 == 0), i % 2 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(900, None, "en"), (901, "", "en"), (None, "x", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows if i < 300], "doc_id long, quality int")
    model = C.fit(docs, labels)
    got = {r.doc_id: r.score for r in C.score(docs, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert all((got[i] >= 0.7) == good for i, _, good in rows if i >= 300)
    same = C.fit(docs.repartition(3), labels.repartition(2))
    assert (same.good, same.bad, same.a, same.b) == (model.good, model.bad, model.a, model.b)
    assert {r.score for r in C.score(docs, C.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert C.score(docs.limit(0), model).count() == 0
