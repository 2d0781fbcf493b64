"""Blocks that meet in cogroups, with partitions that are not coalesced: keys of both sides must hash alike."""

import random

import duckdb
import numpy as np
import pytest

from braidwork.operators import recommend
from braidwork.operators import similarity as S
from tests.test_rating_blocks import brute


@pytest.fixture()
def scattered(spark):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_scattered_rating_blocks(scattered, monkeypatch):
    monkeypatch.setattr(recommend, "RATING_USERS", 7)
    rng = random.Random(2)
    rows = [(u, rng.randrange(25), rng.randrange(1, 6)) for u in range(50) for _ in range(5)]
    df = scattered.createDataFrame(rows, "user long, item long, rating int")
    pairs, best = brute(rows, range(50))
    assert {(r.user, r.other): r.common for r in recommend.user_cosine(df).collect()} == {p: n for p, (n, _) in pairs.items()}
    got = recommend.similar_by_ratings(df, df.select("user").distinct()).collect()
    assert {(r.user, r["rank"]): r.other for r in got} == {(u, n + 1): o for u, found in best.items() for n, (_, o) in enumerate(found)}


def test_scattered_type_blocks(scattered, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK_USERS", 9)
    rows = [(u, u * t % 11) for u in range(60) for t in range(1, 5)]
    owned = scattered.createDataFrame(rows, "user long, type int")
    sets = {}
    for u, t in rows:
        sets.setdefault(u, set()).add(t)
    want = {u: [o for _, o in sorted((-round(len(sets[u] & sets[o]) / len(sets[u] | sets[o]), 6), o) for o in sets if o != u)[:5]] for u in sets}
    got = recommend.similar_by_types(owned).collect()
    assert {(r.user, r["rank"]): r.other for r in got} == {(u, n + 1): o for u, found in want.items() for n, o in enumerate(found)}


def test_scattered_score_blocks(scattered, monkeypatch):
    monkeypatch.setattr(S, "GROUP_ROWS", 20)
    rng = np.random.default_rng(4)
    v = scattered.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(100)], "id long, v array<double>")
    got = S.score_stats(v.where("id % 2 = 0").selectExpr("id AS query_id", "v AS q"), v).collect()
    assert {r.query_id: r.n for r in got} == {i: 100 for i in range(0, 100, 2)}


def test_halves_go_away_from_zero_as_in_sql(spark):
    """1/128 = 0.0078125 is a half at the sixth digit."""
    x = np.array([1 / 128, 3 / 128, -1 / 128, 5 / 128, 0.5, 0.0, 1.0, 0.1234565, 0.1234575, -np.inf])
    want = [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [[float(v) for v in x]]).fetchall()]
    assert S.rounded(x, 6).tolist() == want
    both = [(1, t) for t in range(128)] + [(2, 0)]
    got = recommend.similar_by_types(spark.createDataFrame(both, "user long, type int")).collect()
    assert {r.similarity for r in got} == {0.007813}


@pytest.mark.parametrize(("block", "entries", "wave", "at_once"), [(4096, 1 << 22, 1 << 26, 1 << 22), (9, 20, 100, 7)])
def test_rare_items_meet_by_lists(scattered, monkeypatch, block, entries, wave, at_once):
    """Users meet only those that share an item; no pair of blocks is sent."""
    for name, value in {"RATING_USERS": block, "LIST_ENTRIES": entries, "WAVE_ENTRIES": wave, "RATING_PAIRS": at_once}.items():
        monkeypatch.setattr(recommend, name, value)
    monkeypatch.setattr(recommend, "_rating_blocks", None)
    rng = random.Random(8)
    rows = [(u, rng.randrange(300), rng.choice([None, 0, 1, 2, 3, -1, -2, 5])) for u in range(80) for _ in range(rng.randrange(7))]
    rows += [(u, 200, 4) for u in range(6)] + [(3, 200, 2), (None, 1, 2), (90, 200, 5)]
    df = scattered.createDataFrame(rows, "user long, item long, rating int")
    pairs, best = brute([r for r in rows if r[0] is not None], range(85))
    got = {(r.user, r.other): (r.common, r.similarity) for r in recommend.user_cosine(df).collect()}
    assert got.keys() == pairs.keys() and all(got[p] == (n, pytest.approx(s, abs=1e-12)) for p, (n, s) in pairs.items())
    found = {}
    for r in recommend.similar_by_ratings(df, scattered.range(85).withColumnRenamed("id", "user")).orderBy("user", "rank").collect():
        found.setdefault(r.user, []).append((-r.similarity + 0.0, r.other))
    assert found.keys() == best.keys()
    for u, want in best.items():
        assert found[u] == [(pytest.approx(s, abs=1e-6), o) for s, o in want], u
