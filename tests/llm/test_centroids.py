"""Centroid clustering through kd-trees against rounds that compute every distance."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import centroids


def brute(vectors, k, rounds, seed=2):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in vectors]
    kept.sort(key=lambda p: (hashlib.sha256(f"{seed}:{'null' if p[0] is None else p[0]}".encode()).hexdigest(), p[1].tolist()))
    x = np.array([v for _, v in kept], object)
    c = x[:k].copy()
    near = lambda: np.array([((x - z) ** 2).sum(1) for z in c], object).astype(float).argmin(0)
    for _ in range(rounds):
        to = near()
        for z in range(len(c)):
            if (to == z).any():
                c[z] = [int(s) // int((to == z).sum()) for s in x[to == z].sum(0)]
    to = near()
    far = [int(((x[i] - c[z]) ** 2).sum()) for i, z in enumerate(to)]
    per = {z: sum(d for d, y in zip(far, to) if y == z) for z in range(len(c))}
    names = [hashlib.sha256(",".join(str(int(y)) for y in z).encode()).hexdigest() for z in c]
    return sorted(((i, int(z), d, per[z], sum(far), names[z]) for (i, _), z, d in zip(kept, to, far)), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("n", "dims", "spread", "block", "leaf"), [(600, 4, 0.05, 100, 4), (600, 4, 1.0, 8192, 1), (300, 64, 0.02, 64, 32), (50, 2, 1000.0, 10, 2), (7, 3, 1.0, 100, 32)])
def test_cluster_brute(spark, monkeypatch, n, dims, spread, block, leaf):
    monkeypatch.setattr(centroids, "BLOCK", block)
    monkeypatch.setattr(centroids, "LEAF", leaf)
    rng = np.random.default_rng(n + dims)
    middles = rng.normal(size=(6, dims))
    x = middles[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dims))
    x[: n // 3] = x[0]  # copies
    x[n // 3 : n // 2] = np.round(x[n // 3 : n // 2])  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[1].tolist()), (3, x[-1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert found(centroids.cluster(df, k=9, rounds=3, dimensions=dims)) == brute(rows, 9, 3)


def test_nodes_are_pruned_and_assigned_whole():
    rng = np.random.default_rng(3)
    middles = np.array([[0, 0], [10_000, 0], [0, 10_000]])
    x = np.concatenate([m + rng.integers(-100, 100, (500, 2)) for m in middles]).astype(np.int64)
    order, nodes = centroids.kd_tree(x)
    x = x[order]
    low, high = (np.array([f(x[s:e]) for s, e, _ in nodes]) for f in (lambda p: p.min(0), lambda p: p.max(0)))
    assert sorted(order.tolist()) == list(range(1500))
    for s, e, left in nodes:
        assert left == 0 or (nodes[left, 0] == s and nodes[left, 1] == nodes[left + 1, 0] and nodes[left + 1, 1] == e)
    whole, owner, leaves = centroids.filtered(nodes, low, high, middles.astype(np.int64))
    assert len(leaves) < 8 and len(whole) < 30  # only leaves cut between two groups are open
    assert sum(nodes[w, 1] - nodes[w, 0] for w in [*whole, *(at for at, _ in leaves)]) == 1500
    for w, z in zip(whole, owner):
        own = x[nodes[w, 0] : nodes[w, 1]]
        assert ((own - middles[z]) ** 2).sum(1).max() <= min(((own - m) ** 2).sum(1).min() for i, m in enumerate(middles) if i != z)


def test_equal_centroids_go_to_the_smaller_number():
    x = np.array([[5, 5]] * 10, np.int64)
    order, nodes = centroids.kd_tree(x)
    assert len(nodes) == 1
    whole, _, leaves = centroids.filtered(nodes, x[:1], x[:1], np.array([[9, 9], [5, 4], [5, 4]], np.int64))
    assert not len(whole) and leaves[0][1].tolist() == [1, 2]
    assert centroids._leaf_owners(x, np.array([[9, 9], [5, 4], [5, 4]], np.int64), leaves[0][1]).tolist() == [1] * 10


def test_large_components_are_exact(spark):
    rows = [(i, [131_071.0 - i * 0.25, -131_071.0 + i]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(centroids.cluster(df, k=4, rounds=2, dimensions=2)) == brute(rows, 4, 2)


def test_cluster_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (2, [], 1), (3, [1.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [-inf, 0.0], 1), (8, [1.0, 2.0, 3.0], 1), (9, [1e30, 0.0], 1)]
    assert centroids.cluster(spark.createDataFrame([], kind), dimensions=2).count() == 0
    assert centroids.cluster(spark.createDataFrame(bad, kind), dimensions=2).count() == 0
    some = spark.createDataFrame([*bad, (10, [0.5, -0.5], None), (10, [0.5, -0.5], None), (None, [0.0, 0.0], 2)], kind)
    for c in ("Cluster", "DISTANCE", "inertia", "rows", "row", "x", "_v", "_cluster", "nodes", "low"):
        some = some.withColumn(c, F.lit("y"))
    got = centroids.cluster(some, dimensions=2).collect()
    assert len(got) == 3 and {r["distance"] for r in got} == {0} and all(r["rows"] == r["_v"] == r["x"] == r["_cluster"] == "y" for r in got)
    assert sorted(str(r.label) for r in got) == ["2", "None", "None"]
