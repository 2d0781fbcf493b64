"""Paths through the segments of a session, and labels for terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions import vectors as V

from .relational import top


def most_similar(current: DataFrame, candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """(doc, i, score): of each doc's candidates (doc, i, v) that are not in ``visited`` (doc, i), the nearest to its current segment (doc, v); ties go to the first."""
    here = current.select("doc", F.col("v").alias("q"))
    open_ = candidates.join(visited, ["doc", "i"], "left_anti").join(here, "doc")
    return top(open_.select("doc", "i", F.round(V.cosine(F.col("q"), F.col("v")), 6).alias("score")), ["doc"], [F.desc("score"), "i"], 1).drop("rank")


def next_step(state: DataFrame, segments: DataFrame, visited: DataFrame) -> DataFrame:
    """(doc, next) for each doc of ``state`` (doc, i, v, negative).

    After negative feedback the path goes to the most similar segment that was
    not visited, or to the most similar of all if every one was; else to the
    next in order, around the end.
    """
    n = segments.groupBy("doc").agg(F.count("*").alias("n"))
    own = state.select("doc", "i")
    fresh = most_similar(state, segments, visited.unionByName(own).distinct()).select("doc", F.col("i").alias("fresh"))
    any_ = most_similar(state, segments, own).select("doc", F.col("i").alias("any"))
    j = state.join(n, "doc").join(fresh, "doc", "left").join(any_, "doc", "left")
    return j.select("doc", F.when(F.col("negative"), F.coalesce("fresh", "any", "i")).otherwise((F.col("i") + 1) % F.col("n")).cast("long").alias("next"))


def ended(path: Column, n: Column, t: Column, total: Column) -> Column:
    """Whether all ``n`` segments were visited, 0.9 of the time is over, or the path is longer than 1.5 n."""
    return (F.size(F.array_distinct(path)) == n) | (t >= 0.9 * total) | (F.size(path) > 1.5 * n)


def influence_norm(v: Column, i: Column, n: Column) -> Column:
    return V.norm(v) * (1 + 0.1 * i / n)


def feature_frame(segments: DataFrame) -> DataFrame:
    """All pairs (doc, i, j) of a doc's segments (doc, i, v, p) with their place in one space, and the distance of their vectors.

    The space is the coordinates (i, j) followed by both projections.
    """
    a = segments.select("doc", "i", "v", F.col("p").alias("pi"))
    b = segments.select("doc", F.col("i").alias("j"), F.col("v").alias("w"), F.col("p").alias("pj"))
    place = F.concat(F.array(F.col("i").cast("double"), F.col("j").cast("double")), "pi", "pj")
    return a.join(b, "doc").select("doc", "i", "j", place.alias("space"), V.euclid(F.col("v"), F.col("w")).alias("distance"))


def grouped_terms(terms: DataFrame, clusters: int | None = None) -> DataFrame:
    """(cluster, size, terms, pos) of rows (cluster, term), the largest first by ``pos``; of ``clusters`` numbered from 0, those without terms too."""
    g = terms.groupBy("cluster").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    if clusters is not None:
        g = terms.sparkSession.range(clusters).select(F.col("id").cast(terms.schema["cluster"].dataType).alias("cluster")).join(g, "cluster", "left")
    g = g.withColumn("terms", F.coalesce("terms", F.array().cast(g.schema["terms"].dataType))).withColumn("size", F.size("terms"))
    return g.withColumn("pos", F.row_number().over(W.orderBy(F.desc("size"), "cluster")))


def scored_lines(prefix: Column, scene: Column, element: Column) -> Column:
    """The link of a card: base, scene and element."""
    return F.concat_ws("/", F.regexp_replace(prefix, "/+$", ""), scene.cast("string"), element.cast("string"))
