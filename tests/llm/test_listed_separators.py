"""Words by listed separators are those of the ranges, and texts are never searched by ranges."""

import random

from pyspark.sql import functions as F

from braidwork.llm import decontaminate as D


def test_same_words(spark):
    rng = random.Random(2)
    letters = [chr(c) for c in range(128)] + list("\u0080éΣİ中￿\U0001f600")
    texts = ["".join(rng.choices(letters, k=60)) for _ in range(300)] + ["".join(letters), "", " ", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    for plain, listed in ((D.WORD, D.LISTED_WORD), (D.ANY, D.LISTED_ANY)):
        rows = df.select(found(plain).alias("a"), found(listed).alias("b"), F.regexp_count("text", F.lit(plain)).alias("n"), F.regexp_count("text", F.lit(listed)).alias("m")).collect()
        assert all(r.a == r.b and r.n == r.m for r in rows) and sum(r.n for r in rows) > 1000


def test_texts_are_not_searched_by_ranges(spark, monkeypatch):
    plans, real = [], D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().analyzed().toString()) or real(df, name))
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "two three four five six seven eight nine ten eleven")], "item_id string, text string")
    out = D.find_leaks(docs, items)
    plans.append(out._jdf.queryExecution().analyzed().toString())
    assert [(r.doc_id, r.n_words, r.n_hit) for r in out.orderBy("doc_id").collect()] == [(1, 11, 10), (2, 1, 0)]
    assert any("regexp_count" in p for p in plans) and any("regexp_extract_all" in p for p in plans)
    assert not any(p_ in p for p in plans for p_ in (D.WORD, D.ANY))
