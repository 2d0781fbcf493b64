"""Exact search that leaves blocks out, against all pairs, and how many blocks it leaves out."""

import numpy as np
import pytest

from braidwork.operators import similarity as S


def frame(spark, rows, key="id", column="v"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"{key} long, {column} array<double>")


def brute(queries, corpus, k, measure, skip_self=True):
    out = []
    for i, q in queries:
        scored = []
        for j, v in corpus:
            if skip_self and i == j:
                continue
            q_, v_ = np.array(q, float), np.array(v, float)
            norm = np.linalg.norm(q_) * np.linalg.norm(v_)
            x = {"cosine": q_ @ v_ / norm if norm else 0.0, "dot": q_ @ v_, "euclid": np.linalg.norm(q_ - v_)}[measure]
            scored.append((round(x, 6) * (1 if measure == "euclid" else -1), j))
        out += [(i, j, abs(s) if measure == "euclid" else -s) for s, j in sorted(scored)[:k]]
    return out


def clustered(n, dims, middles, spread, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(middles, dims)) * 5
    return [(i, c[rng.integers(middles)] + spread * rng.normal(size=dims)) for i in range(n)]


@pytest.mark.parametrize("measure", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize(("spread", "parts", "group"), [(0.1, 12, 16), (3.0, 5, 1000)])
def test_search_brute(spark, monkeypatch, measure, spread, parts, group):
    monkeypatch.setattr(S, "GROUP_ROWS", group)
    rows = clustered(240, 5, 8, spread, 3)
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, np.zeros(5)), (2001, rows[5][1] * 2)]  # copies, ties, no direction
    queries = rows[::7] + [(5000, np.zeros(5)), (5001, np.ones(5))]
    got = S.search(frame(spark, queries, "query_id", "q"), frame(spark, rows), 4, measure, parts=parts).orderBy("query_id", "rank").collect()
    want = sorted(brute(queries, rows, 4, measure), key=lambda r: r[0])
    assert [(r.query_id, r.id) for r in got] == [(i, j) for i, j, _ in want]
    assert [r.score for r in got] == pytest.approx([s for *_, s in want], abs=2e-6)


def test_blocks_are_left_out(spark):
    """3,000 vectors in 30 clusters and 30 blocks: a query visits some, not all."""
    rows = clustered(3000, 16, 30, 0.05, 4)
    corpus = frame(spark, rows)
    queries = corpus.withColumnsRenamed({"id": "query_id", "v": "q"})
    for measure in ("cosine", "euclid"):
        found, visits = S.pruned_search(queries, corpus, 3, measure, True, 30)
        share = visits.count() / (3000 * 30)
        assert found.count() >= 9000
        assert share < 0.1, (measure, share)  # measured: 1 of 30 blocks
    vague = frame(spark, clustered(600, 16, 1, 1.0, 5))
    _, visits = S.pruned_search(vague.withColumnsRenamed({"id": "query_id", "v": "q"}), vague, 3, "euclid", True, 30)
    assert visits.count() <= 600 * 30


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(400, 4)) * rng.lognormal(size=(400, 1)), rng.normal(size=(50, 4)) * 3
    x[:3], q[0] = 0, 0
    for measure in S.MEASURES:
        at = S.Pivots(x[[0, 10, 20, 30]], measure)
        far = at.distance(x)
        home = far.argmin(1)
        radius = np.array([far[home == b, b].max(initial=0) for b in range(4)])
        bound, scores, more = at.best_score(q, radius), S.MEASURES[measure][0](q, x), S.MEASURES[measure][1]
        for b in range(4):
            own = scores[:, home == b]
            assert (own <= bound[:, [b]]).all() if more else (own >= bound[:, [b]]).all()


def test_unusable_vectors_take_no_part(spark):
    """Null, empty, other lengths, nulls and numbers that are not finite inside."""
    good = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])]
    bad = [(4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.1, 0.0])]
    corpus = frame(spark, good + bad)
    queries = corpus.withColumnsRenamed({"id": "query_id", "v": "q"})
    got = sorted((r.query_id, r.id) for r in S.search(queries, corpus, 2).collect())
    assert got == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (9, 10), (10, 9)]
    stats = {r.query_id: r.n for r in S.score_stats(queries, corpus).collect()}
    assert stats == {1: 3, 2: 3, 3: 3, 9: 2, 10: 2}
    assert S.search(queries.limit(0), corpus).count() == 0 and S.search(queries, corpus.limit(0)).count() == 0
    assert S.search(queries.where("query_id = 1"), corpus.where("id = 1")).count() == 0


def test_similarity_of_other_lengths_is_null(spark):
    from braidwork.functions import vectors as V

    rows = spark.createDataFrame([([1.0, 0.0], [1.0]), ([1.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(V.cosine("a", "b")).collect()] == [None, 1.0, None]
