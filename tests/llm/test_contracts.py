"""The ten operators against SQL or brute force on the generated tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from braidwork.llm import quality, queries
from braidwork.llm.common import table
from tests.oracle import DATA, compare, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.SQL[name]) > 0


def brute_components(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def brute_print(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    out = 0
    for b in range(64):
        if 2 * sum(xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams):
            out |= 1 << b
    return out


def test_simhash(spark):
    _, docs = rows_of_sql("SELECT doc_id, text FROM documents", DATA)
    prints = {i: brute_print(t) for i, t in docs}
    want = brute_components(prints)
    got = queries.QUERIES["op2_simhash_near_dedup"](spark, DATA).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_quality_held_out(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    _, labels = rows_of_sql("SELECT doc_id, quality FROM labels", data)
    got = {r.doc_id: r for r in queries.QUERIES["op3_quality_classifier"](spark, data).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(got[i].score, q) for i, q in labels if got[i].held_out]
    good, bad = ([s for s, q in held if q == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.7 for s in good]) > 0.97


def test_language_held_out(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    _, docs = rows_of_sql("SELECT doc_id, lang FROM documents", data)
    got = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, data).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([got[i].lang_pred == lang for i, lang in docs if got[i].held_out]) > 0.97


def test_nearest_recall(spark):
    _, rows = rows_of_sql("SELECT vec_id, embedding FROM embeddings", DATA)
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got: dict = {}
    for r in queries.QUERIES["op7_nearest_neighbours"](spark, DATA).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        s = x @ x[ids.tolist().index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(dict(zip(ids.tolist(), s))[v] - score) < 1e-9 for v, score in found.values())
        hits += len({v for v, _ in found.values()} & set(ids[order].tolist()))
    assert hits / (5 * len(got)) >= 0.9


def test_mix_nears_targets(spark):
    rows = queries.QUERIES["op9_mix_sources"](spark, DATA.replace("sf0.001", "sf0.01")).collect()
    again = queries.QUERIES["op9_mix_sources"](spark, DATA.replace("sf0.001", "sf0.01")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    by: dict = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        t = by.setdefault((r.source_size, r.target), [0])
        t[0] += r.taken
    total = sum(t[0] for t in by.values())
    assert abs(total - sum(k[1] for k in by)) < 0.05 * total
    assert abs(sum(k[1] for k in by) - 1.5 * sum(k[0] for k in by)) < 1e-3


def test_substring_digest_of_untouched(spark):
    _, docs = rows_of_sql("SELECT doc_id, text FROM documents", DATA)
    text = dict(docs)
    for r in queries.QUERIES["op10_substring_dedup"](spark, DATA).collect():
        if not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(b" ".join((text[r.doc_id] or "").encode().split())).hexdigest()


def plain_statistics(text: str) -> list[float]:
    """The statistics, counted in plain loops over characters and words."""
    raw = text.encode()
    words, n = raw.split(), len(raw)
    k = max(len(words), 1)
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / max(n, 1)
    log = lambda x: math.log1p(1000 * x)
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    thirds = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log1p(len(words)), mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)), math.log1p(max(sizes)), share(range(65, 91)), share(range(97, 123)),
        log(share(range(48, 58))), share(range(128, 256)), log(share(b".,;:'\"-()?")), log(share(b"!#$%&*@^~|<>{}[]\\/=+_`")), log(share(b"!")), log(share(b"|")),
        len(set(words)) / k, max((words.count(w) for w in set(words)), default=0) / k, sum(a == b for a, b in zip(words, words[1:])) / k,
        min(1.0, (len(thirds) if len(words) > 2 else k) / max(k - 2, 1)), log(len(lines) / max(len(words), 1)), len(set(lines)) / max(len(lines), 1),
    ]


def plain_isotonic(x, y, w):
    """The monotone fit by its min-max formula, at each x."""
    mean = lambda a, b: sum(y[i] * w[i] for i in range(a, b + 1)) / sum(w[a : b + 1])
    return [max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i in range(len(x))]


def test_quality_brute(spark):
    """Statistics, weights, calibration and scores of op3 against plain computation on all rows."""
    _, docs = rows_of_sql("SELECT doc_id, text FROM documents", DATA)
    text = {i: t or "" for i, t in docs}
    for t in [*list(text.values())[:40], "", "   ", "a a a", "!|\n\nx", "é" * 50]:
        assert quality.statistics(t.encode()) == pytest.approx(plain_statistics(t))
    _, labels = rows_of_sql("SELECT doc_id, avg(quality) FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id", DATA)
    part = lambda i: zlib.crc32(str(i).encode()) % 4
    rows = [(i, np.array(quality.statistics(text[i].encode())), y) for i, y in labels if i in text and part(i) != 2]
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    held = np.array([part(r[0]) == 3 for r in rows])
    spread = x.std(axis=0)
    model = quality.Model(x.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), 7)
    z = model.expand(x[~held])
    width = z.shape[1]
    penalty = 1e-3 * len(z) / width * np.diag([1.0] * (width - 1) + [0.0]) + 1e-9 * np.eye(width)
    model.weights = np.linalg.solve(z.T @ z + penalty, z.T @ y[~held])
    bins = np.rint(np.clip(model.raw(x[held]), -1, 2) * quality.BINS)
    at = sorted(set(bins))
    means, sizes = [y[held][bins == b].mean() for b in at], [int((bins == b).sum()) for b in at]
    fitted = plain_isotonic(at, means, sizes)
    got = quality.fit(table(spark, DATA, "documents").select("doc_id", "text"), table(spark, DATA, "labels"))
    assert np.allclose(got.weights, model.weights, rtol=1e-3, atol=1e-4)
    for level in set(fitted):  # each level of the fit is one point, at the mean place of its bins
        block = [k for k, f in enumerate(fitted) if f == level]
        place = sum(at[k] * sizes[k] for k in block) / sum(sizes[k] for k in block) / quality.BINS
        assert min(abs(px - place) + abs(py - level) for px, py in zip(*got.points)) < 5e-3
    model.points = got.points
    want = dict(zip(text, model.score(np.array([quality.statistics(t.encode()) for t in text.values()]))))
    for r in queries.QUERIES["op3_quality_classifier"](spark, DATA).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=5e-3)
