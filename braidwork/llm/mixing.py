"""Mix sources to target weights (built-in functions only).

Words are summed by source, each source gets a target by water-filling, and
every document is taken ``floor(rate)`` times plus one hash-seeded Bernoulli
copy whose probability is the remaining fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, apart, materialize, maybe_broadcast, table, without

WEIGHTS = (5, 2, 1)
OUTPUTS = ("size", "source_size", "target", "rate", "copies", "taken")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code-point order, null last, take the weights in turn. They
    share ``share`` times all words by weight; no target is above ``most``
    times the source's words, and what is cut is shared again by weight. The
    fixed point is ``min(cap, level * weight)``: with the sources in order of
    ``cap / weight``, the level is that of the first source that stays under
    its cap when all before it are at theirs. One row per source goes through
    the three windows, none per document: sources are taken to be few, up to
    some millions, which one task sorts.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("rank", rank).select(
        "source",
        "source_size",
        "rank",
        F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
        (F.lit(float(most)) * F.col("source_size")).alias("cap"),
    )
    by_fill = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc())
    everything = W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    filled = per.withColumn("place", F.row_number().over(by_fill)).withColumn(
        "level", (F.lit(float(share)) * F.sum("source_size").over(everything) - before) / still
    )
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    return filled.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap"))
        .otherwise(F.col("first.level") * F.col("weight"))
        .alias("target"),
    )


def coin(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed, the id and the text (52 bits of MD5); the same on every run and cluster."""
    text = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


@apart("doc_id", "text", "source")
def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken.

    ``docs`` needs doc_id, text and source. Defined results: a null text has
    size 0; null sources form one source, the last; a null doc_id counts as the
    word "null"; the text is part of the coin, so that only rows that repeat
    both id and text toss the same one; a source without
    words has target 0 and rate 0; an empty table gives an empty table; input
    columns named like an output are replaced. All rows and columns are kept.
    """
    sized = without(docs, *OUTPUTS).withColumn("size", word_count(F.col("text")))
    plan = materialize(source_targets(sized.select("source", "size"), weights, share, most), "mix-plan")
    plan = plan.withColumnRenamed("source", "_plan_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor("rate") + F.when(coin(F.col("doc_id"), F.col("text"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (
        sized.join(maybe_broadcast(plan, 100_000), sized["source"].eqNullSafe(plan["_plan_source"]))
        .drop("_plan_source")
        .withColumn("rate", rate)
        .withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


@apart("copies")
def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy, with its number in ``copy`` (from 1); documents with no copies go."""
    kept = without(mixed, "copy").where(F.col("copies") > 0)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM per),
f AS (SELECT *, row_number() OVER o AS place,
  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, rank)),
l AS (SELECT min(place) AS p, arg_min(level, place) AS level FROM f WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN l.p IS NULL OR place < l.p THEN cap ELSE l.level * weight END AS target FROM f CROSS JOIN l),
r AS (SELECT d.doc_id, d.digest, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
