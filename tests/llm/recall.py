"""Recall of op7 against brute force on random vectors of 64 dimensions: ``python -m tests.llm.recall 50000 200000``.

Prints one line of JSON for each size. Not a test, as it takes minutes; the
README holds its figures.
"""

import json
import sys
import time

import numpy as np
from pyspark.sql import functions as F

from braidwork.llm import neighbours
from braidwork.llm.common import materialize
from braidwork.session import session


def main(sizes: list[int]) -> None:
    spark = session("local[8]", spark__sql__shuffle__partitions="32", spark__ui__enabled="false", spark__driver__memory="10g")
    spark.sparkContext.setLogLevel("ERROR")
    for n in sizes:
        x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
        parts = [spark.createDataFrame([(i, x[i].tolist()) for i in range(a, min(a + 20_000, n))], "vec_id long, embedding array<float>") for a in range(0, n, 20_000)]
        vectors = parts[0]
        for p in parts[1:]:
            vectors = vectors.unionByName(p)
        vectors = materialize(vectors, "recall")
        begin = time.time()
        rows = neighbours.nearest(vectors, F.col("vec_id") % 50 == 0).collect()
        took = time.time() - begin
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        found: dict = {}
        for r in rows:
            found.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for a in range(0, n, 50_000):
            queries = np.arange(a, min(a + 50_000, n), 50)
            s = unit[queries] @ unit.T
            s[np.arange(len(queries)), queries] = -2
            best = np.argpartition(-s, 5, axis=1)[:, :5]
            hits += sum(len(found[int(q)] & set(b.tolist())) for q, b in zip(queries, best))
        print(json.dumps({"vectors": n, "recall_at_5": round(hits / (5 * len(found)), 4), "seconds": round(took, 1)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main([int(a) for a in sys.argv[1:]] or [50_000])
