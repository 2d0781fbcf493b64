"""Eigenmaps against a dense solution, against PCA on a rolled sheet, and clusters on top of them."""

import numpy as np
import pytest

from braidwork.operators import manifold, similarity


def frame(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")


def rolled(n, seed=1):
    """A sheet rolled up in space, with its place along the roll."""
    rng = np.random.default_rng(seed)
    t = np.sort(1.5 * np.pi * (1 + 2 * rng.random(n)))
    return np.stack([t * np.cos(t), 4 * rng.random(n), t * np.sin(t)], 1), t


def dense(edges, n):
    w = np.zeros((n, n))
    for i, j in edges:
        w[i, j] = 1
    assert (w == w.T).all()
    d = w.sum(1)
    values, vectors = np.linalg.eigh((np.eye(n) + w / np.sqrt(np.outer(d, d))) / 2)
    order = np.argsort(-values)
    return values[order], vectors[:, order] / np.sqrt(d)[:, None]


def trust(x, y, k=10):
    """Trustworthiness: how far off, by rank in ``x``, the neighbours in ``y`` are; 1 is best."""
    far = lambda a: ((a[:, None] - a[None]) ** 2).sum(-1) + np.eye(len(a)) * 1e18
    rank = far(x).argsort(1).argsort(1)
    near = far(y).argsort(1)[:, :k]
    n = len(x)
    off = sum(max(0, rank[i, j] - k + 1) for i in range(n) for j in near[i])
    return 1 - off * 2 / (n * k * (2 * n - 3 * k - 1))


def test_rolled_sheet(spark):
    x, t = rolled(300)
    graph = manifold.neighbour_graph(frame(spark, x), 8, "euclid")
    pairs = [tuple(r) for r in graph.collect()]
    near = ((x[:, None] - x[None]) ** 2).sum(-1) + np.eye(300) * 1e18
    want = {(i, int(j)) for i in range(300) for j in near[i].argsort()[:8]}
    assert set(pairs) == want | {(j, i) for i, j in want} and len(pairs) == len(set(pairs))
    found, values = manifold.eigenmap(graph, 2)
    rows = sorted(found.collect())
    y = np.array([[r.x0, r.x1] for r in rows])
    exact, vectors = dense(pairs, 300)
    assert values == pytest.approx(exact[1:3].tolist(), abs=2e-4)
    for c in range(2):  # the same functions, and signs that do not depend on chance
        cosine = abs(y[:, c] @ vectors[:, c + 1]) / np.linalg.norm(y[:, c]) / np.linalg.norm(vectors[:, c + 1])
        assert cosine > 0.98
        assert y[np.abs(y[:, c]).argmax(), c] > 0
    assert abs(np.corrcoef(y[:, 0].argsort().argsort(), t.argsort().argsort())[0, 1]) > 0.98  # unrolled
    centred = x - x.mean(0)
    pca = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert trust(t[:, None], y[:, :1]) > trust(t[:, None], pca[:, :1]) + 0.05
    again, _ = manifold.eigenmap(graph.repartition(3), 2)
    assert np.abs(np.array([[r.x0, r.x1] for r in sorted(again.collect())]) - y).max() < 1e-5


def test_parts_that_nothing_joins(spark):
    """Three cliques: the coordinates tell them apart and are the same inside each."""
    edges = [(a, b) for c in range(3) for a in range(5 * c, 5 * c + 5) for b in range(5 * c, 5 * c + 5) if a != b]
    found, values = manifold.eigenmap(spark.createDataFrame(edges, "i long, j long"), 2)
    rows = {r.id: (r.x0, r.x1) for r in found.collect()}
    assert values == pytest.approx([1, 1], abs=1e-6)
    middles = [np.mean([rows[i] for i in range(5 * c, 5 * c + 5)], axis=0) for c in range(3)]
    assert all(np.abs(np.array(rows[i]) - middles[i // 5]).max() < 1e-6 for i in rows)
    assert min(np.abs(middles[a] - middles[b]).max() for a in range(3) for b in range(a)) > 0.01


def test_clusters(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(4, 12)) * 4
    owner = rng.integers(0, 4, 200)
    rows = similarity.cluster(frame(spark, middles[owner] + 0.3 * rng.normal(size=(200, 12))), 4, 3).collect()
    assert len(rows) == 200 and len({(owner[r.id], r.cluster) for r in rows}) == 4  # each group is a cluster


def test_each_row_is_at_its_nearest_centre(spark):
    """By the coordinates that ``cluster`` uses: no other cluster's mean is nearer than one's own."""
    x, _ = rolled(200, 4)
    df = frame(spark, x)
    found = {r.id: r.cluster for r in similarity.cluster(df, 4, 3).collect()}
    at = {r.id: np.array([r.x0, r.x1, r.x2]) for r in similarity.coordinates(df, 3).collect()}
    means = {c: np.mean([at[i] for i in found if found[i] == c], axis=0) for c in set(found.values())}
    wrong = [i for i, c in found.items() if np.linalg.norm(at[i] - means[c]) > min(np.linalg.norm(at[i] - m) for m in means.values()) + 1e-3]
    assert len(found) == 200 and len(wrong) <= 4  # k-means may end a step before it has settled
