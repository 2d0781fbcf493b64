"""Walks by list ranking and subtrees by intervals, against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from braidwork.operators import trees

SCHEMA = "conv string, id string, parent string, ordinal long"


def forest(seed, convs=12, most=40):
    """Random forests with orphans, equal ordinals, deep and flat trees."""
    rng, rows = random.Random(seed), []
    for c in range(convs):
        n, deep = rng.randint(1, most), rng.random() < 0.4
        for i in range(n):
            parent = None if i == 0 or rng.random() < 0.05 else f"n{i - 1 if deep else rng.randrange(i)}" if rng.random() < 0.97 else "gone"
            rows.append((f"c{c}", f"n{i}", parent, rng.randint(-2, 3)))
    rng.shuffle(rows)
    return rows


def brute(rows):
    """{(conv, id): (root, depth, enter, last)}"""
    kids, known, out = {}, {(c, i) for c, i, _, _ in rows}, {}
    for c, i, p, o in rows:
        kids.setdefault((c, p if (c, p) in known else None), []).append((o, i))

    def walk(c, i, root, depth, n):
        at, n = n, n + 1
        for _, k in sorted(kids.get((c, i), [])):
            n = walk(c, k, root, depth + 1, n)
        out[c, i] = (root, depth, at, n - 1)
        return n

    for c in {r[0] for r in rows}:
        n = 0
        for _, i in sorted(kids.get((c, None), [])):
            n = walk(c, i, i, 0, n)
    return out


@pytest.fixture
def no_closure(monkeypatch):
    monkeypatch.setattr(trees, "ancestors", None)


@pytest.mark.parametrize("seed", range(3))
def test_placed_brute(spark, seed, no_closure):
    rows = forest(seed)
    got = trees.placed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.conv, r.id): (r.root, r.depth, r.enter, r.last) for r in got} == brute(rows) and len(got) == len(rows)


def test_chain_of_100000(spark, no_closure):
    n = 100_000
    chain = spark.range(n).select(F.lit("x").alias("conv"), F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).cast("long").alias("ordinal"))
    p = trees.placed(chain)
    assert not [f for f in p.schema if f.dataType.typeName() in ("array", "map")]
    (r,) = p.agg(F.count("*").alias("n"), F.max("depth").alias("deep"), F.bool_and((F.col("enter") == F.col("id")) & (F.col("depth") == F.col("id")) & (F.col("last") == n - 1) & (F.col("root") == 0)).alias("fine")).collect()
    assert (r.n, r.deep, r.fine) == (n, n - 1, True)


def test_a_star_and_ids_of_numbers(spark, no_closure):
    rows = [("s", 0, None, 0)] + [("s", i, 0, -i) for i in range(1, 3000)]
    got = {r.id: (r.depth, r.enter, r.last) for r in trees.placed(spark.createDataFrame(rows, "conv string, id long, parent long, ordinal long")).collect()}
    assert got[0] == (0, 0, 2999) and all(got[i] == (1, 3000 - i, 3000 - i) for i in range(1, 3000))


@pytest.mark.parametrize(("lo", "hi"), [(0, 0), (5, 4), (0, 15), (1, 16), (3, 1000), (0, 4095), (255, 70_000), (16, 31), (10**9 + 7, 10**9 + 90_000)])
def test_blocks_cover_once(spark, lo, hi):
    (r,) = spark.range(1).select(trees.blocks(F.lit(lo).cast("long"), F.lit(hi).cast("long")).alias("b")).collect()
    held = [x for level, b in r.b for x in range(b << 4 * level, (b + 1) << 4 * level)]
    assert sorted(held) == list(range(lo, hi + 1))
    assert len(r.b) <= 30 * 5


def test_within_brute(spark):
    rng = random.Random(4)
    points = [(f"c{rng.randrange(3)}", rng.randrange(5000), i) for i in range(300)]
    spans = [(f"c{rng.randrange(3)}", a := rng.randrange(5000), a + rng.choice([0, 3, 50, 4000]), i) for i in range(60)]
    got = trees.within(spark.createDataFrame(points, "conv string, at long, p long"), spark.createDataFrame(spans, "conv string, lo long, hi long, s long")).collect()
    want = sorted((p, s) for c, at, p in points for d, lo, hi, s in spans if c == d and lo <= at <= hi)
    assert sorted((r.p, r.s) for r in got) == want


def under(rows, places, c, top):
    _, _, lo, hi = places[c, top]
    return sorted(i for d, i, _, _ in rows if d == c and lo <= places[d, i][2] <= hi)


def test_subtrees_brute(spark, no_closure):
    rows = forest(7)
    places, rng = brute(rows), random.Random(1)
    df = spark.createDataFrame(rows, SCHEMA)
    tops = sorted({(c, i) for c, i, _, _ in rng.sample(rows, 25)}) + [("c0", "unknown"), ("unknown", "n0")]
    roots = spark.createDataFrame(tops, "conv string, top string")
    got = sorted((r.conv, r.top, r.id) for r in trees.subtree(df, roots).collect())
    assert got == sorted((c, t, i) for c, t in tops if (c, t) in places for i in under(rows, places, c, t))
    parents = {(c, i): p for c, i, p, _ in rows}
    gone = {(c, i) for c, t in tops if parents.get((c, t)) is not None for i in under(rows, places, c, t)}
    left = trees.delete(df, roots.withColumnRenamed("top", "id"), cascade=True)
    assert sorted((r.conv, r.id) for r in left.collect()) == sorted({(c, i) for c, i, _, _ in rows} - gone)


def test_moves_under_themselves_brute(spark, no_closure):
    rows = forest(8, convs=4)
    places, rng = brute(rows), random.Random(2)
    by = {}
    for c, i, _, _ in rows:
        by.setdefault(c, []).append(i)
    moves = sorted({(c, rng.choice(by[c]), rng.choice([*by[c], "nowhere"])) for c in by for _ in range(60)}) + [("c0", "same", "same")]
    got = trees.makes_cycle(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(moves, "conv string, id string, new_parent string"))
    want = [m for m in moves if m[1] == m[2] or ((m[0], m[2]) in places and m[2] in under(rows, places, m[0], m[1]))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_split_takes_later_siblings(spark, no_closure):
    rows = [("c", "r", None, 0), ("c", "a", "r", 0), ("c", "b", "r", 1), ("c", "d", "r", 2), ("c", "b1", "b", 0), ("c", "d1", "d", 0), ("c", "a1", "a", 0)]
    cuts = spark.createDataFrame([("c", "b", "new")], "conv string, id string, new_conv string")
    got = {r.id: (r.conv, r.parent, r.ordinal) for r in trees.split(spark.createDataFrame(rows, SCHEMA), cuts).collect()}
    assert got == {"b": ("new", None, 0), "b1": ("new", "b", 0), "d": ("new", "b", 1), "d1": ("new", "d", 0)}
