"""Tables beyond the bounds are never broadcast, however small their files are."""

import re

import numpy as np
from pyspark.sql import functions as F

from braidwork.llm import neighbours
from braidwork.llm.common import maybe_broadcast


def joins(df):
    return re.findall(r"(\w+Join)\b", df._jdf.queryExecution().sparkPlan().toString())


def test_small_files_beyond_the_bound_are_sorted(spark):
    left, right = spark.range(2000), spark.range(1000)
    assert joins(left.join(right, "id")) == ["BroadcastHashJoin"]  # what Spark does by sizes
    assert joins(left.join(maybe_broadcast(right, 999), "id")) == ["SortMergeJoin"]
    assert joins(left.join(maybe_broadcast(right, 1000), "id")) == ["BroadcastHashJoin"]
    text = right.select("id", F.lit("a" * 100).alias("t"))
    assert joins(left.join(maybe_broadcast(text, 1000, most_bytes=1000), "id")) == ["SortMergeJoin"]


def test_fronts_of_walks_beyond_the_bound_are_sorted(spark, monkeypatch):
    """Also where Spark would broadcast them by the size of their files; the results stay the same."""
    seen, real = [], neighbours.materialize

    def kept(df, name, *args, **kwargs):
        if name == "walk" and kwargs:
            seen.append(joins(df))
        return real(df, name, *args, **kwargs)

    monkeypatch.setattr(neighbours, "materialize", kept)
    x = neighbours._pack(np.random.default_rng(3).normal(size=(30, 16)))
    nodes = spark.createDataFrame(list(enumerate(x)), "id long, packed binary")
    graph = spark.createDataFrame([(i, (i + k) % 30, 0.0) for i in range(30) for k in (1, 7, 11)], "id long, other long, score float")
    got, sent, sorted_ = [], "BroadcastHashJoin", "SortMergeJoin"
    for most, first, later in ((1 << 20, {sent}, {sent}), (2500, {sent}, {sent, sorted_}), (0, {sorted_}, {sorted_})):
        monkeypatch.setattr(neighbours, "BROADCAST_BYTES", most)
        seen.clear()
        found = neighbours.search(graph, nodes, nodes.where("id < 10"), 16, width=6, step=3)
        got.append(sorted((r.id, r.other, r.score) for r in found.collect()))
        assert set(seen[0]) == first and any(set(plan) == later for plan in seen[1:]), (most, seen)
        assert not most or all(sent in plan for plan in seen)  # queries are few
    assert len(got[0]) == 10 * 6 and got[0] == got[1] == got[2]
