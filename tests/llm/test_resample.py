"""Importance resampling against a plain version, and its edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import resample

DOCS = "doc_id long, text string, source string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=25, least=20, buckets=10_000, longest=2, seed=7):
    own = [(i, *features(t, longest)) for i, t in docs]
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(at(f) for _, _, fs in own for f in fs), Counter(at(f) for x in target for f in features(x, longest)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for i, n, fs in own:
        weight = sum(gain(at(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2], -r[3]))
    place = {id(r): k for k, r in enumerate(fit[: len(fit) * percent // 100], 1)}
    return sorted(((*r, place.get(id(r))) for r in rows), key=repr)


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "中文", "A1b", "a1B"]
    out = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)))) + str(rng.choice(["", ".", "  x-Y\t\n", "İ"]))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, " .,- "), (None, " ".join(words)), (None, None), (5, out[5][1]), (n + 3, "w1 w2 " * 60_000)]


@pytest.mark.parametrize(("percent", "least", "buckets", "longest"), [(25, 20, 10_000, 2), (100, 0, 7, 1), (50, 1, 1 << 16, 3)])
def test_resample_brute(spark, monkeypatch, percent, least, buckets, longest):
    monkeypatch.setattr(resample, "STREAM", 500)
    rows, target = texts(300), [(1, "w1 w2 w3 w4 w5 中文"), (2, None), (3, "w1 w2")]
    d = spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS).repartition(5)
    got = resample.resample(d, spark.createDataFrame(target, "item_id long, text string"), percent, least, longest, buckets)
    assert got.columns == ["doc_id", "source", "n_words", "n_features", "weight", "score", "rank"]
    want = brute(rows, [t for _, t in target], percent, least, buckets, longest)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr) == want


def test_streams_round_trip(spark, monkeypatch):
    monkeypatch.setattr(resample, "STREAM", 100)
    rows = texts(60)
    d = spark.createDataFrame([(i, t, None) for i, t in rows], DOCS)
    packed = resample.streams(d).collect()
    assert len(packed) > 10
    found = []
    for r in packed:
        stream = np.frombuffer(r.stream, np.uint16)
        assert r.offsets[0] == 0 and r.offsets[-1] == len(stream) and len(r.offsets) == len(r.rows) + 1 == len(r.words) + 1
        found += [(x.doc_id, n, sorted(stream[a:b].tolist())) for x, n, a, b in zip(r.rows, r.words, r.offsets, r.offsets[1:])]
    want = [(i, features(t)[0], sorted(zlib.crc32(f.encode()) % 10_000 for f in features(t)[1])) for i, t in rows]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    counts = {r.bucket: r.n for r in resample.bucket_counts(resample.streams(d)).collect()}
    assert counts == dict(Counter(b for _, _, bs in want for b in bs))


def test_resample_edges(spark):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], DOCS)
    assert resample.resample(none, target).count() == 0
    some = spark.createDataFrame([(1, "a b c", "s")], DOCS)
    for c in ("Score", "RANK", "weight", "row", "_d", "_at", "_range", "_first", "rows", "stream", "offsets", "words"):
        some = some.withColumn(c, F.lit("x"))
    got = resample.resample(some, none.select("text"), percent=100, least_words=1).collect()
    assert len(got) == 1 and got[0]["rank"] == 1 and got[0]["rows"] == got[0]["_d"] == got[0]["row"] == "x"
    with pytest.raises(ValueError, match="16 bits"):
        resample.streams(some, buckets=1 << 17)


def test_drawn(spark):
    rows = [(i, " ".join(["w1"] * 30), "s") for i in range(40)]
    d = spark.createDataFrame(rows, DOCS)
    scores = resample.resample(d, d.limit(1))
    kept = resample.drawn(d, scores).collect()
    assert len(kept) == 10 and {r.doc_id for r in kept} == {r.doc_id for r in scores.where("rank <= 10").collect()}
    assert all(r.text == rows[r.doc_id][1] for r in kept)


def test_target_is_preferred(spark):
    rows = [(i, " ".join(["news"] * 30 if i % 4 else [f"code{i % 3}"] * 30), None) for i in range(400)]
    scores = resample.resample(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("code0 code1 code2 " * 50,)], "text string"))
    drawn = [r.doc_id % 4 for r in scores.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and drawn.count(0) > 90
