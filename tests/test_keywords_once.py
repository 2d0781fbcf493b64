"""Keywords are read and encoded once, however often the clustering reads their vectors."""

import pyarrow as pa
from pyspark.sql import functions as F

from braidwork.operators import similarity


def test_each_keyword_is_encoded_once(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<double>")
    def encode(terms: pa.Array) -> pa.Array:
        asked.add(len(terms))
        return pa.array([[float(len(t.as_py())), 1.0] for t in terms], pa.list_(pa.float64()))

    def cluster(vectors, k):
        for _ in range(4):
            assert vectors.agg(F.sum(F.size("v"))).first()[0] == 14
        return vectors.select("id", (F.get("v", F.lit(0)).cast("int") % k).alias("cluster"))

    monkeypatch.setattr(similarity, "cluster", cluster)
    texts = spark.createDataFrame([(f"{'word' * (n % 7)}",) for n in range(200)], "term string")
    rows = similarity.keyword_clusters(texts, encode, 3).collect()
    assert sum(len(r.terms) for r in rows) == 7
    assert asked.value == 7
