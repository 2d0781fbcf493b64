"""The near-dedup stage against brute-force similarity of five-word shingles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from braidwork.llm import similar, simhash
from braidwork.llm.common import table
from tests.oracle import DATA


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(texts):
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in ids if root(i) == i}


@pytest.mark.parametrize("data", [DATA, DATA.replace("sf0.001", "sf0.01")])
def test_stage_drops_all_near_copies(spark, data):
    docs = table(spark, data, "documents")
    want = brute_kept({r.doc_id: r.text for r in docs.collect()})
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_chains_and_stars(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts, i = {}, 0
    for _ in range(3):  # chains whose ends differ, copies of one base, and texts alike but under 0.8
        walk = rng.choice(vocabulary, 300)
        for _ in range(12):
            walk = walk.copy()
            walk[rng.integers(0, 300, 4)] = rng.choice(vocabulary, 4)
            texts[i] = " ".join(walk)
            i += 1
        base = rng.choice(vocabulary, 300)
        for changes in (2, 4, 5, 6, 7, 8) * 4:
            copy = base.copy()
            copy[rng.integers(0, 300, changes)] = rng.choice(vocabulary, changes)
            texts[i] = " ".join(copy)
            i += 1
    want = brute_kept(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for cell in (4096, 7):
        monkeypatch.setattr(similar, "CELL", cell)
        assert {r.doc_id for r in similar.keep_one(docs).collect()} == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "same " * 5), (4, "Same " * 50), (4, "Same " * 50), (None, "one two"), (None, None), (6, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in similar.keep_one(docs).collect()) == [0, 1, 3, 6]
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_other_radii_are_refused(spark):
    prints = np.arange(4, dtype=np.uint64)
    for radius in (-1, 3):
        with pytest.raises(ValueError):
            simhash.near(prints, simhash.planes(prints), 4, radius)
        with pytest.raises(ValueError):
            simhash.links(spark.createDataFrame([(1,)], "fp long"), radius)


def test_candidates_lose_no_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(300)[int(rng.integers(0, 120)) :]], rng.integers(0, 2**63, int(rng.integers(0, 60)), dtype=np.uint64)])) for _ in range(150)]
    bits = np.array([np.frombuffer(np.packbits(np.bincount((h % np.uint64(similar.BITS)).astype(np.int64), minlength=similar.BITS) & 1).tobytes(), np.uint64) for h in sets])
    n, fp, side = np.array([len(h) for h in sets]), np.arange(150) * 7, np.arange(150) % 2
    both = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    true = {(7 * i, 7 * j) for i in range(150) for j in range(i + 1, 150) if both[i][j] >= 0.8 * (n[i] + n[j] - both[i][j]) - 1e-9}
    found = set(similar.candidates(fp, n, bits, fp, side * 0, 0.8, False))
    assert true <= found and len(found) < 2 * len(true)
    across = set(similar.candidates(fp, n, bits, fp, side, 0.8, False))
    assert across == {p for p in found if side[p[0] // 7] != side[p[1] // 7]}
    span = similar.candidates(fp, n, bits, fp, side * 0, 0.8, True)
    assert set(span) <= found and len(span) < 150
    group = simhash_groups(found)
    assert group == simhash_groups(span)


def simhash_groups(pairs):
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in sorted(parent)}


def test_near_fingerprints_are_candidates(spark):
    """SimHash runs in the stage: its pairs span what differs in at most 2 bits, and they alone link near copies, once confirmed."""
    rows = [(10, 0b0), (20, 0b0), (30, 0b11), (40, 0b1111), (50, 0xFF << 20)]
    nodes = spark.createDataFrame(rows, "fp long, sim long")
    pairs = {(r.a, r.b) for r in similar.print_pairs(nodes).collect()}
    group = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert group == {10: 10, 20: 10, 30: 10, 40: 10, 50: 50}
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", *words])), (3, "other text of its own words")], "doc_id long, text string")
    s = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", similar.sketches(F.col("text")).alias("s")).select("doc_id", "text_hash", "text", "s.*")
    no_bands = s.withColumn("bands", F.array().cast("array<long>"))
    found = {r.node: r.root for r in similar.similar_links(no_bands.drop("doc_id", "text"), docs.select("text", F.xxhash64("text").alias("text_hash"))).collect()}
    key = {r.doc_id: r.fp for r in s.collect()}
    assert found[key[1]] == found[key[2]] and key[3] not in found
