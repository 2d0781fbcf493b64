"""The adjacency of a graph has rows of many vectors: few are read at once, and walks take them in small batches."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from braidwork.llm import neighbours


def test_few_rows_of_the_adjacency_at_once(spark, monkeypatch):
    tables, walks, real = [], [], neighbours.materialize

    def kept(df, name, *args, **kwargs):
        out = real(df, name, *args, **kwargs)
        tables.append((name, out._written_at))
        if name == "walk":
            walks.append(kwargs.get("large_rows", False))
        return out

    monkeypatch.setattr(neighbours, "materialize", kept)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 16)
    x = np.random.default_rng(3).normal(size=(500, 16))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, F.col("vec_id") % 50 == 0)
    assert got.count() == 50
    path = next(p for name, p in tables if name == "adjacency").removeprefix("file://")
    groups = [m.row_group(g).num_rows for f in glob.glob(path + "/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    assert sum(groups) >= 500 and max(groups) <= 16
    assert len(walks) > 1 and all(walks[1:])  # the first are the queries themselves
