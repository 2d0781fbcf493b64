"""Tables whose rows are large arrays are written in row groups of few rows, as a reader holds a whole one at once."""

import glob

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from braidwork.llm import scoring
from braidwork.sources.shared import BATCH, BATCH_BYTES, shared_dir, written


def test_groups_hold_few_blocks(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(scoring, "discard", lambda *tables: kept.extend(tables))
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} that is {i % 5} long") for i in range(600)], "doc_id long, text string").coalesce(1)
    got = scoring.score_documents(docs, block_bytes=200)
    assert got.count() == 600
    assert all(t._written_at.removeprefix("file:").startswith(shared_dir(spark).removeprefix("file:")) for t in kept)
    most = {}
    for t in kept:
        name = t._written_at.rsplit("/", 1)[1].split("-")[0]
        for f in glob.glob(t._written_at.removeprefix("file://") + "/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            most[name] = max([most.get(name, 0), *(meta.row_group(g).num_rows for g in range(meta.num_row_groups))])
    assert most["blocks"] == scoring.GROUP_BLOCKS  # over a hundred blocks, of one range of hashes
    assert set(most) == {"blocks", "asked", "totals"} and max(most.values()) <= scoring.GROUP_BLOCKS


def test_batches_of_large_rows_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["bytes"])

    before = spark.conf.get(BATCH)
    rows = spark.range(0, 40, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(125_000)), lambda x: x + F.col("id")).alias("large"))
    got = [r[0] for r in written(rows.mapInArrow(sizes, "bytes long"), "sizes", 4).collect()]
    assert sum(got) >= 40_000_000 and max(got) <= BATCH_BYTES + 1_100_000  # 40 rows of a megabyte, at most one beyond the bound
    assert spark.conf.get(BATCH) == before
