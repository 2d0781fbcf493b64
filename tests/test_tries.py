"""Compressed prefix trees against all prefixes of all ids."""

import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators import tries


def brute(rows):
    under = {}
    for i, s in rows:
        for n in range(1, len(i or "") + 1):
            under.setdefault(i[:n], []).append((s, i))
    return {p: (min(x)[1], len(x)) for p, x in under.items()}


def rows_of(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "aé中😀z"
    ids = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    return [(i, rng.randrange(1000)) for i in ids] + [(None, 1), ("", 2), ("a", 3), ("a", 0)]


@pytest.mark.parametrize("seed", range(3))
def test_prefixes_brute(spark, seed):
    rows = rows_of(seed)
    got = tries.prefixes(spark.createDataFrame(rows, "id string, seq long")).collect()
    assert {r.prefix: (r.root, r.members) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_nodes_are_linear_in_ids(spark):
    """Ids of 10,000 letters: 60 of them would have 600,000 prefixes."""
    rng = random.Random(9)
    base = "".join(rng.choice("xyz") for _ in range(10_000))
    ids = [base[: rng.randrange(1, 10_000)] + "q" * rng.randrange(0, 10_000) for _ in range(60)]
    got = tries.trie(spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, seq long")).collect()
    assert len(got) < 2 * len(set(ids))
    for r in got:
        mine = [i for i in ids if i.startswith(r.prefix)]
        assert (r.members, r.root, r.length) == (len(mine), mine[0], len(r.prefix))
        assert [i for i in ids if i.startswith(r.prefix[: r.above + 1])] == mine
        assert r.above == 0 or len([i for i in ids if i.startswith(r.prefix[: r.above])]) > len(mine) or r.prefix[: r.above] in ids


@pytest.mark.parametrize("n", [1, 2, 64, 65, 5000])
def test_nearest_smaller_brute(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(0, 50) if n < 5000 else 5000 - abs(2500 - i) for i in range(n)]
    got = {r.at: (r.left, r.right) for r in tries.nearest_smaller(spark.createDataFrame(list(enumerate(values)), "at long, value int")).collect()}
    for i in range(0, n, max(1, n // 200)):
        left = next((j for j in range(i - 1, -1, -1) if values[j] < values[i]), None)
        right = next((j for j in range(i + 1, n) if values[j] < values[i]), None)
        assert got[i] == (left, right)


def test_no_ids(spark):
    none = spark.createDataFrame([], "id string, seq long")
    assert tries.prefixes(none).count() == 0
    assert [tuple(r) for r in tries.prefixes(spark.createDataFrame([("ab", 1)], "id string, seq long")).orderBy("prefix").collect()] == [("a", "ab", 1), ("ab", "ab", 1)]


def test_in_order(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("x")).repartition(7)
    rows = sorted(tries.in_order(df, "x").collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, 1001)) and [r.x for r in rows] == sorted(r.x for r in rows)


def test_batches_and_modes_of_all_rows(spark):
    from braidwork.operators import relational

    df = spark.range(1003).select(((F.col("id") * 7919) % 1003).alias("n"), F.when(F.col("id") % 3 == 0, F.lit("b")).otherwise(F.lit("a")).alias("t")).repartition(5)
    got = {r.n: r.batch for r in relational.batches(df, ["n"], 100).collect()}
    assert got == {n: n // 100 for n in range(1003)}
    by = {(r.t, r.n): r.batch for r in relational.batches(df, ["n"], 100, ["t"]).collect()}
    assert all(b == sorted(n for t, n in by if t == s).index(m) // 100 for (s, m), b in list(by.items())[::97])
    assert [tuple(r) for r in relational.mode_of(df, [], "t").collect()] == [("a", 668)]
    ties = spark.createDataFrame([(1, "y"), (1, "x"), (2, "z"), (2, None), (2, None)], "k int, t string")
    assert sorted(map(tuple, relational.mode_of(ties, ["k"], "t").collect())) == [(1, "x", 1), (2, None, 2)]
    assert relational.mode_of(ties.limit(0), [], "t").count() == 0
