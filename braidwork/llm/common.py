"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.sources.shared import discard, shared_dir
from braidwork.sources.shared import written as materialize

__all__ = ["BROADCAST_ROWS", "SPACE_WORD", "apart", "bounded", "discard", "materialize", "maybe_broadcast", "ranked", "sampled", "shared_dir", "table", "without"]

#: Words by ASCII white space only.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Largest number of narrow rows that an operator broadcasts after counting them.
BROADCAST_ROWS = 500_000
#: Bytes that a table with strings may have to be broadcast.
BROADCAST_BYTES = 64 << 20


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, items: str | None = None, most_items: int = 0, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a materialized narrow table of at most ``limit`` rows; else a join by sorting.

    For a table with an array column ``items``, its arrays may hold
    ``most_items`` in total; one with strings may have ``most_bytes`` as JSON.
    Beyond the bounds Spark may not choose: it goes by the size of files, and
    Parquet packs columns of few values into a small part of their size.
    """
    if df.limit(limit + 1).count() > limit:
        return df.hint("merge")
    if items and (df.agg(F.sum(F.size(items))).first()[0] or 0) > most_items:
        return df.hint("merge")
    if re.search("string|binary", df.schema.simpleString()) and (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) > most_bytes:
        return df.hint("merge")
    return F.broadcast(df)


def bounded(df: DataFrame, rows: int, row_bytes: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` of ``rows`` counted rows, hinted to be broadcast if they take ``most_bytes`` at most, else to be sorted, see ``maybe_broadcast``."""
    return F.broadcast(df) if rows * row_bytes <= most_bytes else df.hint("merge")


def sampled(key: Column, rate: float, seed: int) -> Column:
    """Whether a hash of ``key`` falls under ``rate``; fine enough for 10**15 rows."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) < F.lit(int(rate * (1 << 53)))


def ranked(df: DataFrame, order: list, name: str, folder: str) -> DataFrame:
    """``df``, written out, with ``name``: the place of each row, from 1, in an order over all rows.

    Spark sorts by ranges; a row's place is its place in its range and the
    number of rows in all ranges before, so that no task holds them all.
    """
    sorted_ = df.orderBy(*order).select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_at"))
    placed = materialize(sorted_.withColumn("_range", F.shiftright("_at", 33)), folder)
    ranges = placed.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).orderBy("_range").collect()  # one row a partition
    before, starts = 0, []
    for r in ranges:
        starts.append((r["_range"], r["_first"], before))
        before += r["_n"]
    known = placed.sparkSession.createDataFrame(starts, "_range long, _first long, _before long")
    place = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return placed.join(F.broadcast(known), "_range").select("_row.*", place.alias(name))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in any case, so that new columns never clash."""
    gone = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone])


def apart(*needs: str) -> Callable:
    """Decorates an operator on a table of which it reads the columns ``needs`` only: others go through it under names that nothing clashes with.

    They come back under their own names, in their places, unless the operator
    makes a column of that name, which then counts.
    """

    def wrap(operator: Callable) -> Callable:
        @wraps(operator)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            hidden = {c: f"__{n}__" for n, c in enumerate(df.columns) if c.lower() not in needs}
            if not hidden:
                return operator(df, *args, **kwargs)
            out = operator(df.select(*[df[f"`{c}`"].alias(hidden.get(c, c)) for c in df.columns]), *args, **kwargs)
            old = {c: hidden.get(c, c) for c in df.columns}
            new = [c for c in out.columns if c not in old.values()]
            made = {c.lower() for c in new}
            back = [out[f"`{inside}`"].alias(c) for c, inside in old.items() if inside in out.columns and (c not in hidden or c.lower() not in made)]
            return out.select(*back, *[out[f"`{c}`"] for c in new])

        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
