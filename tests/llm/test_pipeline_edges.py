"""Every stage on nulls, repeated rows, empty tables and extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_edges import docs
from tests.oracle import DATA

EXTRA = "score SPANS items n_words n_hit contaminated _id _h _hash size rate copies taken target held_out predicted _said won fp _row group kept".split()
LONG = " ".join(f"w{i}" for i in range(300))
ROWS = [(1, None), (1, None), (2, ""), (3, "   "), (4, "one"), (4, "one"), (None, "one two three four"), (None, None), (5, LONG, "en", "s", 3), (6, LONG, None, None, None), (7, "ÀÉ ñ 中文"), (8, "password = abcdef1234567890", "en", "t", 27)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    last = ["copy"] if name == "source_mix" else []
    none = stage(spark, docs(spark, []), DATA)
    assert none.columns == ["doc_id", "text", "lang", "source", "n_chars", *last] and none.count() == 0
    plain = docs(spark, ROWS)
    extra = plain.select("*", *[F.concat_ws(":", F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in EXTRA])
    out = stage(spark, extra, DATA)
    assert out.columns == [*extra.columns, *last]
    assert [out.schema[c].dataType for c in extra.columns] == [f.dataType for f in extra.schema]
    rows = out.collect()
    for r in rows:
        assert all(r[c] == (f"{c}:{r.doc_id}" if r.doc_id is not None else c) for c in EXTRA)
    own = sorted((tuple(r[c] for c in [*plain.columns, *last]) for r in rows), key=repr)
    assert own == sorted(map(tuple, stage(spark, plain, DATA).collect()), key=repr)  # extra columns change nothing
    if name in ("benchmark_decontamination", "secret_scan"):
        assert len(own) == len(ROWS)
    if name == "simhash_near_dedup":
        kept = [(r[0], r[1]) for r in own]
        assert kept.count((5, LONG)) == 1 and (6, LONG) not in kept and (4, "one") in kept and len(kept) == len(set(kept))
    if name == "secret_scan":
        assert {r[1] for r in own if r[0] == 8} == {"[REDACTED]"}
