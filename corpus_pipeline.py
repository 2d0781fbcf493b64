"""The corpus pipeline: five stages over ``documents``, each on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written as Parquet in the shared folder and read again, so a lost
executor costs one stage at most. All but the last return the columns that
``documents`` has.

Every stage takes nulls in any column, repeated rows, empty tables and extra
columns, also ones named like a column it makes (those are its own again when
it returns): null and empty texts are scored by the classifier, are copies of
each other, hold no passage and no secret, and have size 0 in the mix. Of
ties, the smallest id stays; rows that repeat an id and a text stay once.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import decontaminate, mixing, quality, secrets, similar
from braidwork.llm.common import apart, discard, materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, fitted on these documents' labels, scores under its threshold."""
    scored = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 or more of five-word shingles, that with the smallest id."""
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark and counts n_chars anew where it did; all documents stay."""
    found = secrets.find_secrets(docs)
    clean = secrets.redact(found)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it, with the number of the copy."""
    return mixing.emit(mixing.mix(docs)).select(*docs.columns, "copy")


def _with_columns(stage):
    """The stage, which sees the columns of documents only under their names; others keep theirs and their values."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return apart("doc_id", "text", "lang", "source", "n_chars")(lambda d: stage(spark, d, sf_dir))(docs)

    return run_stage


STAGES = [
    ("quality_classifier", _with_columns(quality_filter)),
    ("simhash_near_dedup", _with_columns(near_dedup)),
    ("benchmark_decontamination", _with_columns(decontamination)),
    ("secret_scan", _with_columns(secret_redaction)),
    ("source_mix", _with_columns(source_mix)),
]

#: The classifier is fitted, which SQL cannot express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
