"""Similar users by their ratings, in blocks, against all pairs."""

import random

import numpy as np
import pytest

from braidwork.operators import recommend


def brute(rows, users, k=5, digits=6):
    """(pairs, best): by plain loops; a rating that comes twice meets twice."""
    mine = {}
    for u, i, r in rows:
        if r:
            mine.setdefault(u, []).append((i, r))
    pairs = {}
    for u in mine:
        for o in mine:
            met = [(a, b) for i, a in mine[u] for j, b in mine[o] if i == j] if u != o else []
            if met:
                pairs[u, o] = (len(met), sum(a * b for a, b in met) / (sum(a * a for a, _ in met) ** 0.5 * sum(b * b for _, b in met) ** 0.5))
    score = lambda u, o: round(pairs.get((u, o), (0, 0.0))[1], digits)
    best = {u: sorted(((-score(u, o), o) for o in users if o != u))[:k] for u in users}
    return pairs, best


@pytest.mark.parametrize(("block", "share", "at_once"), [(4096, 0.05, 1 << 22), (7, 0.05, 3), (20, 0.0, 50), (20, 2.0, 1)])
def test_blocks_brute(spark, monkeypatch, block, share, at_once):
    monkeypatch.setattr(recommend, "RATING_USERS", block)
    monkeypatch.setattr(recommend, "RATING_ROWS", 5)
    monkeypatch.setattr(recommend, "RATING_PAIRS", at_once)
    monkeypatch.setattr(recommend, "DENSE_SHARE", share)
    monkeypatch.setattr(recommend, "DENSE_ITEMS", 4)
    rng = random.Random(block)
    rows = [(u, rng.choice([*range(40), *range(5)]), rng.choice([None, 0, 1, 2, 3, -1, -2, 5])) for u in range(60) for _ in range(rng.randrange(9))]
    rows += [(u, 99, 4) for u in range(55)] + [(3, 1, 2), (3, 1, 2), (None, 1, 2)]
    df = spark.createDataFrame(rows, "user long, item long, rating int")
    pairs, best = brute([r for r in rows if r[0] is not None], [*range(58), 70, 71])
    got = {(r.user, r.other): (r.common, r.similarity) for r in recommend.user_cosine(df).collect()}
    assert got.keys() == pairs.keys() and all(got[p] == (n, pytest.approx(s, abs=1e-12)) for p, (n, s) in pairs.items())
    users = spark.createDataFrame([(u,) for u in [*range(58), 70, 71, 71, None]], "user long")
    found = {}
    for r in recommend.similar_by_ratings(df, users).orderBy("user", "rank").collect():
        found.setdefault(r.user, []).append((-r.similarity + 0.0, r.other))
    assert found.keys() == best.keys()
    for u, want in best.items():
        assert found[u] == [(pytest.approx(s, abs=1e-6), o) for s, o in want], u


def test_an_item_that_all_rated(spark):
    """Some 36 million pairs share an item; none is a row."""
    n = 6000
    rng = np.random.default_rng(5)
    rows = [(u, -1, 1 + u % 2) for u in range(n)] + [(int(u), int(u) // 3, int(r)) for u, r in zip(range(n), rng.integers(1, 6, n))]
    df = spark.createDataFrame(rows, "user long, item long, rating int")
    users = df.select("user").distinct()
    got = recommend.similar_by_ratings(df, users, 2).collect()
    assert len(got) == 2 * n
    value = {(u, i): r for u, i, r in rows}
    for r in got[:: n // 50]:
        score = lambda o: (
            1.0 if r.user // 3 != o // 3 else (value[r.user, -1] * value[o, -1] + value[r.user, o // 3] * value[o, o // 3]) / ((value[r.user, -1] ** 2 + value[r.user, o // 3] ** 2) * (value[o, -1] ** 2 + value[o, o // 3] ** 2)) ** 0.5
        )
        want = sorted((-round(score(o), 6), o) for o in range(n) if o != r.user)[:2]
        assert (-r.similarity, r.other) == want[r["rank"] - 1]


def test_no_ratings(spark):
    none = spark.createDataFrame([], "user long, item long, rating int")
    users = spark.createDataFrame([(1,), (2,)], "user long")
    assert recommend.user_cosine(none).count() == 0
    assert [(r.user, r.other, r.similarity) for r in recommend.similar_by_ratings(none, users).orderBy("user").collect()] == [(1, 2, 0.0), (2, 1, 0.0)]
    assert recommend.similar_by_ratings(none, users.limit(0)).count() == 0
    assert recommend.similar_by_ratings(none, users.limit(1)).count() == 0
