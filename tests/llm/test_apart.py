"""Extra columns come out of every operator as they went in, whatever their names."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import braidwork.llm
from braidwork.llm import decontaminate, language, mixing, quality, secrets, similar, substrings, urls
from tests.llm.test_edges import WORDS, docs

#: Every name in quotes that starts with an underscore, and some that operators give to columns inside.
INNER = sorted({n for f in Path(braidwork.llm.__file__).parent.glob("*.py") for n in re.findall(r'"(_[a-z]\w*)"', f.read_text())} | set("won h g w n key item win code codes found print block up dist labels made digest short full fp edge id1 told mer check starts seg sure".split()))

OPERATORS = {
    "quality": lambda s, d: quality.classify(d, quality.fit(d, s.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int"))),
    "secrets": lambda s, d: secrets.redact(secrets.find_secrets(d)),
    "language": lambda s, d: language.detect(d, language.fit(d)),
    "leaks": lambda s, d: decontaminate.find_leaks(d, s.createDataFrame([(1, " ".join(WORDS[:12]))], "item_id long, text string")),
    "mix": lambda s, d: mixing.emit(mixing.mix(d)),
    "repeats": lambda s, d: substrings.remove_repeats(d),
    "urls": lambda s, d: urls.judge(d.withColumn("url", F.lit("http://a.example.org/es/x")), urls.rule_table(s)),
    "similar": lambda s, d: similar.keep_one(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_come_back(spark, name):
    long = " ".join(WORDS)
    d = docs(spark, [(1, long, "en", "s", 3), (2, long + " x", "fr", "t", 4), (4, "a b", "en", None, 5), (5, None, None, "s", 6)])
    d = d.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in INNER])
    got = OPERATORS[name](spark, d).collect()
    assert got
    for r in got:
        assert all(r[c] == f"{c}:{r.doc_id}" for c in INNER), name
        assert r.n_chars == {1: 3, 2: 4, 4: 5, 5: 6}[r.doc_id]


def test_broadcasts_by_bytes(spark):
    from braidwork.llm.common import maybe_broadcast

    hinted = lambda df, **kw: "strategy=broadcast" in maybe_broadcast(df, **kw)._jdf.queryExecution().analyzed().toString()
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert hinted(rows) and not hinted(rows, limit=99)
    assert not hinted(rows, most_bytes=50_000) and hinted(rows.select("id"), most_bytes=10)
    assert not hinted(rows.select(F.array("s").alias("a")), most_bytes=50_000)
