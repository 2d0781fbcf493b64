import pytest
from pyspark.sql import functions as F

from braidwork.functions.registry import Registry, Step, run
from braidwork.operators import paths


def segments(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (1, 2, [0.0, 1.0]), (2, 0, [1.0, 0.0])]
    return spark.createDataFrame(rows, "doc int, i int, v array<double>")


def test_next_step(spark):
    state = spark.createDataFrame([(1, 0, [1.0, 0.0], True), (2, 0, [1.0, 0.0], False)], "doc int, i int, v array<double>, negative boolean")
    none = spark.createDataFrame([], "doc int, i int")
    seen = spark.createDataFrame([(1, 1)], "doc int, i int")
    every = spark.createDataFrame([(1, 1), (1, 2)], "doc int, i int")
    step = lambda visited: {r.doc: r.next for r in paths.next_step(state, segments(spark), visited).collect()}
    assert step(none) == {1: 1, 2: 0}
    assert step(seen) == {1: 2, 2: 0}
    assert step(every) == {1: 1, 2: 0}


def test_ended(spark):
    ask = lambda path, n, t: spark.range(1).select(paths.ended(F.array(*map(F.lit, path)), F.lit(n), F.lit(t), F.lit(100.0)).alias("x")).first()["x"]
    assert ask([0, 1, 0], 2, 0.0) and ask([0], 3, 90.0) and ask([0] * 5, 3, 1.0) and not ask([0, 1], 3, 1.0)


def test_feature_frame(spark):
    rows = paths.feature_frame(segments(spark).withColumn("p", F.slice("v", 1, 1))).orderBy("doc", "i", "j").collect()
    assert len(rows) == 10 and rows[1].space == [0.0, 1.0, 1.0, 0.9] and rows[0].distance == 0


def test_groups(spark):
    t = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (1, "b")], "cluster int, term string")
    assert [(r.cluster, r.terms) for r in paths.grouped_terms(t).orderBy("pos").collect()] == [(1, ["b", "c"]), (0, ["a"])]


def test_registry(spark):
    r = Registry("thing")
    r.register("a", len)
    r.register("b", max)
    with pytest.raises(ValueError):
        r.register("a", len)
    with pytest.raises(KeyError):
        r.get("c")
    assert r.after("b") == "a"
    steps = [Step(2, "filter", lambda df: F.length("s") > 2), Step(1, "map", lambda df: df.withColumn("s", F.concat("s", F.lit("!")))), Step(0, "filter", lambda df: F.lit(False), enabled=False)]
    assert [x.s for x in run(spark.createDataFrame([("a",), ("bc",)], "s string"), steps).collect()] == ["bc!"]


def test_strategies(spark):
    from braidwork.functions import registry

    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    assert registry.between(df, "a", "b", "cosine").first().distance == 0 and registry.between(df, "a", "b", "euclid").first().distance == 5**0.5
    registry.distances.register("taxi", lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))
    try:
        assert registry.between(df, "a", "b", "taxi").first().distance == 3
    finally:
        registry.distances.unregister("taxi")
