"""Users of the same types are compared once, and only what may be among the best is scored and returned."""

import random

import numpy as np
import pyarrow as pa
import pytest

from braidwork.operators import recommend


def brute(sets, k):
    jaccard = lambda a, b: round(len(a & b) / len(a | b), 6)
    return {u: sorted((-jaccard(sets[u], sets[o]), o) for o in sets if o != u)[:k] for u in sets}


def drawn(seed, users, types, most):
    rng = random.Random(seed)
    few = [frozenset(rng.sample(range(types), rng.randrange(1, most))) for _ in range(users // 3)]
    return {u * 7 % 1009: rng.choice(few) if u % 2 else frozenset(rng.sample(range(types), rng.randrange(1, most))) for u in range(users)}


@pytest.mark.parametrize(("types", "most", "block", "tile"), [(12, 6, 2048, 2048), (40, 9, 16, 7), (400, 4, 8, 64)])
def test_against_all_pairs(spark, monkeypatch, types, most, block, tile):
    monkeypatch.setattr(recommend, "BLOCK_USERS", block)
    monkeypatch.setattr(recommend, "TILE_TYPES", tile)
    sets = drawn(types, 120, types, most)
    owned = spark.createDataFrame([(u, t) for u, s in sets.items() for t in s] + [(None, 1)], "user long, type int")
    want = {(u, n + 1): (o, -s + 0.0) for u, found in brute(sets, 4).items() for n, (s, o) in enumerate(found)}
    assert {(r.user, r["rank"]): (r.other, r.similarity) for r in recommend.similar_by_types(owned, 4).collect()} == want


def test_sets_of_many_users_meet_once(spark, monkeypatch):
    """Sixty users of three sets: before, all sixty were compared."""
    seen, real = [], recommend._nearest_sets
    monkeypatch.setattr(recommend, "_nearest_sets", lambda sets, *a: seen.append(sets.count()) or real(sets, *a))
    sets = {u: frozenset({0, 1, 2 + u % 3}) for u in range(60)}
    owned = spark.createDataFrame([(u, t) for u, s in sets.items() for t in s], "user long, type int")
    got = {(r.user, r["rank"]): r.other for r in recommend.similar_by_types(owned).collect()}
    assert seen == [3] and got == {(u, n + 1): o for u, found in brute(sets, 5).items() for n, (_, o) in enumerate(found)}


def test_few_pairs_are_scored(monkeypatch):
    """Of nine million pairs, where each was rounded and sorted before."""
    scored, real = [], recommend.rounded
    monkeypatch.setattr(recommend, "rounded", lambda s, digits: scored.append(s.size) or real(s, digits))
    rng = np.random.default_rng(1)
    sets = [sorted(set(rng.integers(0, 100, 67).tolist())) for _ in range(3000)]
    block = recommend._Sets(pa.table({"id": np.arange(3000), "types": pa.array(sets, pa.list_(pa.int64()))}))
    other = recommend._Sets(pa.table({"id": np.arange(3000), "types": pa.array(sets, pa.list_(pa.int64()))}))
    found = [np.concatenate(x) for x in zip(*recommend._best_sets(block, other, 6, 6))]
    assert len(found[0]) == 6 * 3000 and sum(scored) < 3000**2 / 5
    own = [set(s) for s in sets]
    for u in range(0, 3000, 300):
        want = sorted((-round(len(own[u] & o) / len(own[u] | o), 6), j) for j, o in enumerate(own))[:6]
        assert [(-s, j) for s, j in zip(found[2][found[0] == u], found[1][found[0] == u])] == want


def test_cards_of_similar_users(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(30), rng.choice([None, *range(9)]), c) for c in range(200)]
    owned = spark.createDataFrame(rows, "user long, type int, card long")
    types = {}
    for u, t, _ in rows:
        types.setdefault(u, set()).add(t)
    got = {}
    for r in recommend.with_similar_cards(owned, owned.where("card % 2 = 0").select("type", "card"), 3).collect():
        got.setdefault(r.user, {})[r["rank"]] = r.card
    near = {u: [r.other for r in recommend.similar_by_types(owned, 3).where(f"user = {u}").collect()] for u in (0, 7, 19)}
    for u, others in near.items():
        new = lambda t: t is None or t not in types[u]  # noqa: E731, B023
        some = sorted(c for _, t, c in rows if c % 2 == 0 and t is not None and new(t))[:3]
        theirs = sorted(c for o, t, c in rows if o in others and new(t))[:3]
        assert [c for _, c in sorted(got[u].items())] == sorted(set(some + theirs))[:3]
