"""Prefix trees of ids, compressed: a node for each prefix at which ids part or end, never one for each letter.

Ids are sorted; the length of the common prefix of neighbours says where they
part. A node is a maximal run of neighbours that share at least so many
letters: it ends, on either side, at the nearest smaller such length. These are
found without a stack, by minima of blocks of 64 positions, of 64 blocks, and
so on: up until a block holds a smaller one, then down to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.sources.shared import discard, written

from .relational import small
from .trees import blocks

_STEP = 6


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """``df``, written out, with ``place``: its number from 1 in the order of these columns. Ranges are sorted and counted; no task holds all rows."""
    sorted_ = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(sorted_.withColumn("_range", F.shiftright("_at", 33)), "ordered")
    starts, before = [], 0
    for r in rows.groupBy("_range").agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("_range").collect():  # one row a partition
        starts.append((r["_range"], r["first"] - before))
        before += r["n"]
    known = rows.sparkSession.createDataFrame(starts, "_range long, _first long")
    return rows.join(F.broadcast(known), "_range").withColumn("place", F.col("_at") - F.col("_first") + 1).drop("_at", "_range", "_first")


def common_prefix(a: Column, b: Column) -> Column:
    """Letters that two different strings have in common from the start."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return (F.array_position(same, False) - 1).cast("int")


def nearest_smaller(values: DataFrame) -> DataFrame:
    """(at, value, left, right): for each of ``values`` (at, value), numbered without gaps, the nearest positions with a smaller value; null without any.

    A position looks into the block of 64 around it, then into the block of 64
    blocks, and so on, until one holds a smaller value; then down into the
    nearest that does. Most find theirs at once and go no further.
    """
    tables, level = [], values.select("at", "value")
    while True:
        grouped = level.groupBy(F.shiftright("at", _STEP).alias("block"))
        arrays = grouped.agg(F.array_sort(F.collect_list(F.struct((F.col("at") % (1 << _STEP)).cast("int").alias("i"), F.col("value").alias("v")))).alias("own"))
        arrays = written(arrays, "minima")
        tables.append(arrays)
        if arrays.limit(2).count() < 2:
            break
        level = arrays.select(F.col("block").alias("at"), F.array_min(F.transform("own", lambda x: x["v"])).alias("value"))

    def pick(allowed) -> Column:
        """The nearest of the array's entries that are smaller and allowed, on the side asked for."""
        found = F.filter("own", lambda x: (x["v"] < F.col("value")) & allowed(x["i"]))
        return F.when(F.size(found) > 0, F.when(F.col("side") < 0, F.element_at(found, -1)["i"]).otherwise(F.get(found, F.lit(0))["i"]))

    asked = values.select("at", "value", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")).withColumn("cur", F.col("at"))
    found = []
    for n, arrays in enumerate(tables):
        beyond = lambda i: F.when(F.col("side") < 0, i < F.col("cur") % (1 << _STEP)).otherwise(i > F.col("cur") % (1 << _STEP))
        met = asked.join(arrays, F.shiftright("cur", _STEP) == F.col("block")).withColumn("hit", pick(beyond))
        met = written(met.select("at", "value", "side", "block", "hit"), "climbed")
        found.append(met.where("hit IS NOT NULL").select("at", "value", "side", ((F.col("block") * (1 << _STEP)) + F.col("hit")).alias("cur")))
        asked = met.where("hit IS NULL").select("at", "value", "side", F.col("block").alias("cur"))
    down = None
    for n in range(len(tables) - 1, -1, -1):
        here = found[n] if down is None else down.unionByName(found[n])
        if n:
            met = here.join(tables[n - 1], F.col("cur") == F.col("block")).withColumn("hit", pick(lambda i: F.lit(True)))
            down = written(met.select("at", "value", "side", ((F.col("block") * (1 << _STEP)) + F.col("hit")).alias("cur")), "descended")
        else:
            down = here
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("cur")))
    ends = written(down.groupBy("at").agg(side(-1).alias("left"), side(1).alias("right")), "smaller")
    discard(*tables)
    return values.select("at", "value").join(ends, "at", "left")


def _folded(rows: DataFrame) -> DataFrame:
    """(level, block, members, first) over ``rows`` (place, members, first): sums and minima of aligned blocks of 1, 16, 256, ... places."""
    level = rows.select(F.col("place").alias("block"), "members", "first")
    out, n = [], 0
    while True:
        level = written(level, "sums")
        out.append(level.withColumn("level", F.lit(n)))
        if level.limit(2).count() < 2:
            return reduce(DataFrame.unionByName, out)
        level = level.groupBy(F.shiftright("block", 4).alias("block")).agg(F.sum("members").alias("members"), F.min("first").alias("first"))
        n += 1


def trie(ids: DataFrame) -> DataFrame:
    """(prefix, above, length, root, members): the nodes of the compressed tree over ``ids`` (id, seq), at most two for each different id.

    ``prefix`` is the node's whole prefix and ``length`` its letters; every
    prefix longer than ``above`` letters up to it leads to the same ids:
    ``members`` counts them, and ``root`` is the first that came (by seq,
    then id). Null and empty ids have no prefix.
    """
    first = F.min(F.struct("seq", "id")).alias("first")
    sorted_ = written(in_order(ids.where(F.length("id") > 0).groupBy("id").agg(F.count("*").alias("members"), first), "id"), "ids")
    n = sorted_.count()
    other = sorted_.select((F.col("place") - 1).alias("p"), F.col("id").alias("next"))
    parts = sorted_.join(other, F.col("place") == F.col("p"), "left").select(F.col("place").alias("at"), F.when(F.col("next").isNull(), F.lit(-1)).otherwise(common_prefix(F.col("id"), F.col("next"))).alias("value"))
    edge = ids.sparkSession.createDataFrame([(0, -1)] if n else [], "at long, value int")  # nothing is shared beyond the ends
    parts = written(parts.unionByName(edge), "parts")
    smaller = written(nearest_smaller(parts), "ends").where("value > 0")
    sides = parts.select(F.col("at").alias("a"), F.col("value").alias("v"))
    inner = smaller.select("left", "right", F.col("value").alias("length")).distinct()
    inner = inner.join(sides.withColumnsRenamed({"a": "left", "v": "lv"}), "left").join(sides.withColumnsRenamed({"a": "right", "v": "rv"}), "right")
    inner = inner.select((F.col("left") + 1).alias("lo"), F.col("right").alias("hi"), F.greatest("lv", "rv", F.lit(0)).alias("above"), "length")
    leaves = sorted_.join(sides.withColumnsRenamed({"a": "place", "v": "rv"}), "place").join(sides.select((F.col("a") + 1).alias("place"), F.col("v").alias("lv")), "place")
    leaves = leaves.select(F.col("place").alias("lo"), F.col("place").alias("hi"), F.greatest("lv", "rv", F.lit(0)).alias("above"), F.length("id").alias("length")).where("length > above")
    nodes = written(inner.unionByName(leaves), "nodes")
    cut = nodes.withColumn("_b", F.explode(blocks(F.col("lo"), F.col("hi")))).select("lo", "hi", "above", "length", F.col("_b.level").alias("level"), F.col("_b.block").alias("block"))
    whole = cut.join(small(_folded(sorted_)), ["level", "block"]).groupBy("lo", "hi", "above", "length").agg(F.sum("members").alias("members"), F.min("first").alias("first"))
    named = whole.join(sorted_.select(F.col("place").alias("lo"), "id"), "lo")
    return named.select(F.substring(F.col("id"), F.lit(1), F.col("length")).alias("prefix"), "above", "length", F.col("first.id").alias("root"), "members")


def prefixes(ids: DataFrame) -> DataFrame:
    """(prefix, root, members): of ids (id, seq), under each prefix the first id that came, and how many have it; made from the compressed tree by writing out its edges."""
    each = trie(ids).withColumn("n", F.explode(F.sequence(F.col("above") + 1, F.col("length"))))
    return each.select(F.substring(F.col("prefix"), F.lit(1), F.col("n")).alias("prefix"), "root", "members")
