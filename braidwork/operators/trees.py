"""Conversation trees as adjacency lists: rows (conv, id, parent, ordinal) and any other columns.

Siblings are ordered by ordinal, then id. A root has a null parent, or one
that is not in its tree. Everything works on all trees at once. A walk round
the trees of a conversation is a linked list with two steps a node, one in and
one out; pointer doubling ranks it, so a chain of n messages takes about
log2(2n) joins and no row grows with its depth. The walk numbers the nodes, and
those under a node have the numbers of an interval: what is under what is a
comparison of numbers, and the closure of all pairs is made only by
``ancestors``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.sources.shared import discard, written

from .relational import small


def _siblings():
    return W.partitionBy("conv", "parent").orderBy("ordinal", "id")


def _linked(nodes: DataFrame) -> DataFrame:
    """(conv, id, up): the parent where it exists, else null."""
    ids = nodes.select(F.col("conv").alias("c"), F.col("id").alias("p"))
    return nodes.join(ids, (F.col("conv") == F.col("c")) & (F.col("parent") == F.col("p")), "left").select("conv", "id", F.col("p").alias("up"), "ordinal")


def _looped(nodes: DataFrame) -> ValueError:
    conv, id_ = nodes.select("conv", "id").first()
    return ValueError(f"parent links form a cycle, at or above node {id_!r} of tree {conv!r}")


def _walk(nodes: DataFrame) -> DataFrame:
    """The steps of the walk: (conv, id, out, back, back_out, n, d, root), each with the step before it.

    ``n`` and ``d`` are what a step adds to the number of nodes entered and to
    the depth; a step into a root says which root.
    """
    linked = written(_linked(nodes), "links")
    before = F.lag("id").over(W.partitionBy("conv", "up").orderBy("ordinal", "id"))
    last = linked.where("up IS NOT NULL").groupBy(F.col("conv").alias("c"), F.col("up").alias("i")).agg(F.max_by("id", F.struct("ordinal", "id")).alias("last"))
    known = linked.withColumn("before", before).join(last, (F.col("conv") == F.col("c")) & (F.col("id") == F.col("i")), "left")
    enter = F.struct(F.lit(False).alias("out"), F.coalesce("before", "up").alias("back"), F.col("before").isNotNull().alias("back_out"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("d"), F.when(F.col("up").isNull(), F.col("id")).alias("root"))
    leave = F.struct(F.lit(True).alias("out"), F.coalesce("last", "id").alias("back"), F.col("last").isNotNull().alias("back_out"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"), F.lit(None).cast(linked.schema["id"].dataType).alias("root"))
    steps = written(known.select("conv", "id", F.explode(F.array(enter, leave)).alias("s")).select("conv", "id", "s.*"), "walk")
    discard(linked)
    return steps


def placed(nodes: DataFrame) -> DataFrame:
    """(conv, id, root, depth, enter, last): ``enter`` numbers the nodes of a conversation from 0 as a pre-order walk meets them, ``last`` is the largest number under the node, its own included.

    Each round joins every open step with the step it points back to, takes
    over its sums and points where that one did; it closes the steps up to
    twice as far from the start. A step is pointed to by one step at most, so
    no key of these joins is skewed, and closed steps are not written again. A
    cycle of parent links is an error: it is found by a round that leaves as
    many open as the one before.
    """
    steps = _walk(nodes)
    tables, closed, left = [steps], None, None
    while n := steps.where("back IS NOT NULL").count():
        if n == left:
            raise _looped(steps.where("back IS NOT NULL"))
        left = n
        seen = steps if closed is None else steps.unionByName(closed)
        far = seen.select(*[F.col(c).alias(f"_{c}") for c in steps.columns])
        same = (F.col("conv") == F.col("_conv")) & (F.col("back") == F.col("_id")) & (F.col("back_out") == F.col("_out"))
        joined = steps.where("back IS NOT NULL").join(far, same)
        more = joined.select("conv", "id", "out", F.col("_back").alias("back"), F.col("_back_out").alias("back_out"), (F.col("n") + F.col("_n")).alias("n"), (F.col("d") + F.col("_d")).alias("d"), F.coalesce("root", "_root").alias("root"))
        ended = steps.where("back IS NULL")
        closed = ended if closed is None else closed.unionByName(ended)
        steps = written(more, "walk")
        tables.append(steps)
    every = steps if closed is None else steps.unionByName(closed)
    enters = F.col("out") == F.lit(False)
    own = lambda c: F.max(F.when(enters, F.col(c)))
    out = every.groupBy("conv", "id").agg(own("root").alias("root"), (own("d") - 1).alias("depth"), (own("n") - 1).alias("enter"), (F.max(F.when(~enters, F.col("n"))) - 1).alias("last"))
    out = written(out, "placed")
    discard(*tables)
    return out


#: Intervals are made of aligned blocks of 1, 16, 256, ... numbers.
_BITS, _LEVELS = 4, 12


def blocks(lo: Column, hi: Column) -> Column:
    """Array of (level, block): the fewest aligned blocks that make up the numbers from ``lo`` to ``hi``, at most 30 a level."""
    up = lambda x, l: F.shiftright(x + ((1 << _BITS * l) - 1), _BITS * l)  # noqa: E731, E741
    down = lambda x, l: F.shiftright(x + 1, _BITS * l)  # noqa: E731, E741
    some = lambda l, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(l).alias("level"), x.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))  # noqa: E731, E741
    parts = []
    for level in range(_LEVELS):
        a, b = up(lo, level), down(hi, level)
        above = up(lo, level + 1) < down(hi, level + 1)
        parts.append(some(level, a, F.when(above, up(lo, level + 1) * (1 << _BITS)).otherwise(b)))
        parts.append(some(level, F.when(above, down(hi, level + 1) * (1 << _BITS)).otherwise(b), b))
    return F.flatten(F.array(*parts))


def within(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of ``points`` (conv, at, ...) joined with those of ``spans`` (conv, lo, hi, ...) whose interval holds ``at``.

    A span becomes a few aligned blocks and a point one row for each size of
    block that spans have, so the join is by equal keys, and its rows are
    the result's.
    """
    cut = written(spans.withColumn("_b", F.explode(blocks(F.col("lo"), F.col("hi")))).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b", "lo", "hi"), "spans")
    used = [r[0] for r in cut.select("_level").distinct().collect()]  # twelve at most
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("at", _BITS * n).alias("block")) for n in used]).cast("array<struct<level:int,block:bigint>>")
    each = points.withColumn("_b", F.explode(levels)).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    return each.join(cut, ["conv", "_level", "_block"]).drop("_level", "_block")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(conv, id, ancestor, distance): the transitive closure, distances from 1. A cycle of parent links is an error."""
    far = _linked(nodes).where("up IS NOT NULL").select("conv", "id", "up")
    closure, size = written(far.select("conv", "id", F.col("up").alias("ancestor"), F.lit(1).cast("long").alias("distance")), "closure"), 1
    far, left = written(far, "far"), None
    while n := far.count():
        if n == left:
            raise _looped(far)
        left = n
        t = closure.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("ancestor").alias("a"), F.col("distance").alias("d"))
        more = far.join(t, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("i")))
        longer = written(closure.unionByName(more.select("conv", "id", F.col("a").alias("ancestor"), (F.col("d") + size).alias("distance"))), "closure")
        f2 = far.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("up").alias("u"))
        farther = written(far.join(f2, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("i"))).select("conv", "id", F.col("u").alias("up")), "far")
        discard(closure, far)
        closure, far = longer, farther
        size *= 2
    return closure


def heights(nodes: DataFrame) -> DataFrame:
    """(conv, height): nodes on the longest way down; a single node has height 1."""
    return placed(nodes).groupBy("conv").agg((F.max("depth") + 1).alias("height"))


def last_message(nodes: DataFrame) -> DataFrame:
    """(conv, id): the leaf reached by always taking the last child, which ends the pre-order walk."""
    return placed(nodes).groupBy("conv").agg(F.max_by("id", "enter").alias("id"))


def children(nodes: DataFrame) -> DataFrame:
    """(conv, parent, children): ids in sibling order."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "id")))
    return nodes.where("parent IS NOT NULL").groupBy("conv", "parent").agg(F.transform(ordered, lambda x: x["id"]).alias("children"))


def coordinates(nodes: DataFrame) -> DataFrame:
    """(conv, id, x, y, z): depth, index among siblings, number of siblings."""
    count = F.count("*").over(W.partitionBy("conv", "parent"))
    own = nodes.select("conv", "id", (F.row_number().over(_siblings()) - 1).alias("y"), count.alias("z"))
    return own.join(placed(nodes).select("conv", "id", F.col("depth").alias("x")), ["conv", "id"])


def ranked(nodes: DataFrame) -> DataFrame:
    """Ordinals made 0, 1, 2 ... within siblings."""
    return nodes.withColumn("ordinal", (F.row_number().over(_siblings()) - 1).cast("long"))


def _of(nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trees that ``convs`` (conv, ...) names."""
    return nodes.join(convs.select("conv").distinct(), "conv", "left_semi")


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of the subtrees under ``roots`` (conv, top), those included, with their top. Only the trees of ``roots`` are walked."""
    p = placed(_of(nodes, roots))
    spans = p.select("conv", F.col("id").alias("top"), F.col("enter").alias("lo"), F.col("last").alias("hi")).join(roots.select("conv", "top").distinct(), ["conv", "top"])
    under = within(p.select("conv", "id", F.col("enter").alias("at")), spans).select("conv", "id", "top")
    return nodes.join(under, ["conv", "id"])


def delete(nodes: DataFrame, gone: DataFrame, cascade: bool = False) -> DataFrame:
    """Without the nodes ``gone`` (conv, id), roots excepted; what was under them stays as orphans, or goes too with ``cascade``."""
    victims = gone.join(nodes.where("parent IS NOT NULL").select("conv", "id"), ["conv", "id"], "left_semi")
    if cascade:
        victims = subtree(nodes, victims.withColumnRenamed("id", "top")).select("conv", "id").distinct()
    return nodes.join(victims, ["conv", "id"], "left_anti")


def makes_cycle(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (conv, id, new_parent) that would hang a node under itself: the number of the new parent is in the node's interval."""
    p = placed(_of(nodes, moves))
    own = p.select("conv", "id", F.col("enter").alias("_lo"), F.col("last").alias("_hi"))
    to = p.select("conv", F.col("id").alias("new_parent"), F.col("enter").alias("_at"))
    known = moves.join(own, ["conv", "id"], "left").join(to, ["conv", "new_parent"], "left")
    return known.where("id = new_parent OR _at BETWEEN _lo AND _hi").select(*moves.columns)


def move(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Hang nodes under new parents as ``moves`` (conv, id, new_parent, index) say; moves that make a cycle are left out.

    The node comes before the sibling that has the index, and ordinals are made anew.
    """
    fine = moves.join(makes_cycle(nodes, moves.select("conv", "id", "new_parent")), ["conv", "id", "new_parent"], "left_anti")
    j = ranked(nodes).join(fine, ["conv", "id"], "left")
    moved = F.col("new_parent").isNotNull()
    order = F.when(moved, F.col("index") * 2 - 1).otherwise(F.col("ordinal") * 2)
    out = j.withColumns({"parent": F.when(moved, F.col("new_parent")).otherwise(F.col("parent")), "ordinal": order}).drop("new_parent", "index")
    return ranked(out.select(*nodes.columns))


def add(nodes: DataFrame, fresh: DataFrame, where: str = "child") -> DataFrame:
    """Insert ``fresh`` rows (columns of nodes, with ``parent`` the anchor).

    "child" puts a node first among the anchor's children; "before" and
    "after" put it next to the anchor, under the anchor's parent. Rows whose
    anchor does not exist are left out.
    """
    spots = ranked(nodes).select("conv", F.col("id").alias("anchor"), F.col("parent").alias("above"), F.col("ordinal").alias("at"))
    j = fresh.withColumnRenamed("parent", "anchor").join(spots, ["conv", "anchor"])
    if where == "child":
        new = j.withColumns({"parent": F.col("anchor"), "ordinal": F.lit(-1).cast("long")})
    else:
        new = j.withColumns({"parent": F.col("above"), "ordinal": F.col("at") * 2 + (1 if where == "after" else -1)})
    old = ranked(nodes).withColumn("ordinal", F.col("ordinal") * 2)
    return ranked(old.unionByName(new.select(*nodes.columns)))


def merge(nodes: DataFrame, other: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hang trees of ``other`` into trees of ``nodes`` as ``pairs`` (conv, other_conv) say: their root becomes the last child of the root.

    Ids that clash take the version of ``other``.
    """
    roots = nodes.where("parent IS NULL").groupBy("conv").agg(F.min("id").alias("root"))
    came = other.withColumnRenamed("conv", "other_conv").join(pairs, "other_conv").drop("other_conv").join(roots, "conv", "left")
    top = F.col("parent").isNull()
    came = came.withColumns({"ordinal": F.when(top, F.lit(2**31)).otherwise(F.col("ordinal")).cast("long"), "parent": F.coalesce("parent", "root")}).select(*nodes.columns)
    return ranked(nodes.join(came.select("conv", "id"), ["conv", "id"], "left_anti").unionByName(came))


def split(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """New trees from ``cuts`` (conv, id, new_conv): the node, its later siblings as its last children, and all that is under them. Returns the moved rows."""
    own = ranked(nodes)
    at = own.join(cuts, ["conv", "id"]).select("conv", F.col("id").alias("cut"), F.col("parent").alias("p"), F.col("ordinal").alias("o"), "new_conv")
    tops = own.join(at, "conv").where("id = cut OR (parent = p AND ordinal > o)").select("conv", F.col("id").alias("top"), "cut", "new_conv")
    moved = subtree(own, tops.select("conv", "top")).join(tops, ["conv", "top"])
    parent = F.when(F.col("id") == F.col("cut"), None).when(F.col("id") == F.col("top"), F.col("cut")).otherwise(F.col("parent"))
    late = F.when((F.col("id") == F.col("top")) & (F.col("id") != F.col("cut")), F.col("ordinal") + 2**31).otherwise(F.col("ordinal"))
    return ranked(moved.withColumns({"parent": parent, "conv": F.col("new_conv"), "ordinal": late}).select(*nodes.columns))


def rewind(nodes: DataFrame, n: int) -> DataFrame:
    """Remove the last message ``n`` times; a root stays, and what comes before it.

    The last message ends the pre-order walk, so one walk tells them all.
    """
    p = placed(nodes).join(nodes.select("conv", "id", F.col("parent").isNull().alias("top")), ["conv", "id"])
    ends = p.groupBy("conv").agg(F.max("enter").alias("end"), F.max(F.when(F.col("top"), F.col("enter"))).alias("stop"))
    gone = p.join(ends, "conv").where((F.col("enter") > F.col("end") - n) & (F.col("enter") > F.coalesce("stop", F.lit(-1))))
    return nodes.join(gone.select("conv", "id"), ["conv", "id"], "left_anti")


def attach(nodes: DataFrame, other: DataFrame, spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hang whole trees of ``other`` into trees of ``nodes``: (all nodes, refused spots with the reason).

    ``spots`` (other_conv, conv, parent, place, offset): as "child" the root
    comes at ``offset`` among the parent's children (null: last); "before" and
    "after" put it next to the parent, moved on by the offset. A null parent
    makes it the root of a tree that has no nodes. Refused are unknown places
    and parents, a second root, a parent without a parent for "before" and
    "after", offsets beyond the parent's children, ids that the tree has or
    gets from a smaller ``other_conv`` (so no cycle can come about).
    """
    trees_ = nodes.groupBy("conv").agg(F.lit(True).alias("has"))
    kids = nodes.where("parent IS NOT NULL").groupBy("conv", F.col("parent").alias("anchor")).agg(F.count("*").alias("kids"))
    at = ranked(nodes).select("conv", F.col("id").alias("anchor"), F.col("parent").alias("above"), F.col("ordinal").alias("at"))
    s = spots.withColumnRenamed("parent", "anchor").join(trees_, "conv", "left").join(at, ["conv", "anchor"], "left").join(kids, ["conv", "anchor"], "left")
    ids = other.select(F.col("conv").alias("other_conv"), "id").join(spots.select("other_conv", "conv"), "other_conv")
    ids = ids.withColumn("first", F.min("other_conv").over(W.partitionBy("conv", "id")))
    clash = ids.join(nodes.select("conv", "id", F.lit(True).alias("known")), ["conv", "id"], "left").where("known OR first <> other_conv").select("conv", "other_conv").distinct()
    s = s.join(clash.withColumn("clash", F.lit(True)), ["conv", "other_conv"], "left")
    off = F.col("offset")
    reason = (
        F.when(~F.col("place").isin("child", "before", "after") | F.col("place").isNull(), "unknown place")
        .when(F.col("anchor").isNull() & F.col("has"), "the tree has a root")
        .when(F.col("anchor").isNotNull() & F.col("at").isNull(), "no such parent")
        .when(F.col("anchor").isNotNull() & (F.col("place") != "child") & F.col("above").isNull(), "the parent is a root")
        .when((off < 0) | (off > F.coalesce("kids", F.lit(0))), "bad offset")
        .when(F.col("clash"), "an id exists")
    )
    s = written(s.withColumn("reason", reason), "spots")
    fine = s.where("reason IS NULL").select("other_conv", F.col("conv").alias("into"), "anchor", "above", "at", "place", "offset")
    came = other.withColumnRenamed("conv", "other_conv").join(fine, "other_conv")
    top = F.col("parent").isNull()
    first = F.when(F.col("place") == "child", F.coalesce(off * 2 - 1, F.lit(2**31))).otherwise(F.col("at") * 2 + F.when(F.col("place") == "after", 1).otherwise(-1) + 2 * F.coalesce(off, F.lit(0)))
    under = F.when(F.col("place") == "child", F.col("anchor")).otherwise(F.col("above"))
    new = {"ordinal": F.when(top, F.when(F.col("anchor").isNull(), 0).otherwise(first)).otherwise(F.col("ordinal")).cast("long"), "parent": F.when(top, under).otherwise(F.col("parent")), "conv": F.col("into")}
    old = ranked(nodes).withColumn("ordinal", F.col("ordinal") * 2)
    return ranked(old.unionByName(came.withColumns(new).select(*nodes.columns))), s.where("reason IS NOT NULL").select("other_conv", "conv", "reason")


def add_to_all(nodes: DataFrame, convs: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every message (pos, id, parent, and other columns of nodes) added first under its parent in every tree of ``convs`` (conv): (all nodes, refused (conv, pos, id, reason)).

    Later messages come before earlier ones of one parent. Refused are parents
    that the tree lacks, ids that it has, and a null parent where it has nodes
    already. The messages, one call's list, meet the trees by a broadcast.
    """
    fresh = convs.select("conv").distinct().join(small(messages.withColumnRenamed("parent", "anchor")), how="cross")
    has = nodes.select("conv", F.lit(True).alias("has")).distinct()
    known = nodes.select("conv", "id", F.lit(True).alias("known"))
    anchors = nodes.select("conv", F.col("id").alias("anchor"), F.lit(True).alias("found"))
    j = fresh.join(has, "conv", "left").join(known, ["conv", "id"], "left").join(anchors, ["conv", "anchor"], "left")
    reason = F.when(F.col("known"), "the id exists").when(F.col("anchor").isNull() & F.col("has"), "the tree has a root").when(F.col("anchor").isNotNull() & F.col("found").isNull(), "no such parent")
    j = j.withColumn("reason", reason)
    new = j.where("reason IS NULL").withColumns({"parent": F.col("anchor"), "ordinal": (-1 - F.col("pos")).cast("long")})
    return ranked(ranked(nodes).unionByName(new.select(*nodes.columns))), j.where("reason IS NOT NULL").select("conv", "pos", "id", "reason")


def with_children(chain: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Lists of children (parent, pos, child): ``added`` (parent, pos, child) go to the end in the order of pos, then of each pair in ``removed`` (parent, child) the first goes, if it is there."""
    last = chain.groupBy("parent").agg((F.max("pos") + 1).alias("next"))
    more = added.join(last, "parent", "left").select("parent", (F.col("pos") + F.coalesce("next", F.lit(0))).alias("pos"), "child")
    rows = chain.select("parent", "pos", "child").unionByName(more)
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("parent", "child").orderBy("pos")))
    gone = removed.groupBy("parent", "child").agg(F.count("*").alias("times"))
    kept = rows.join(gone, ["parent", "child"], "left").where(F.col("nth") > F.coalesce("times", F.lit(0)))
    return kept.select("parent", (F.row_number().over(W.partitionBy("parent").orderBy("pos")) - 1).cast("long").alias("pos"), "child")


def chain_nodes(chains: DataFrame, known: int = 0) -> DataFrame:
    """(conv, id, text) of chains (conv, seq, text): numbers from ``known`` + 1 in order, without null and empty texts."""
    rows = chains.where(F.length("text") > 0)
    return rows.select("conv", (F.row_number().over(W.partitionBy("conv").orderBy("seq")) + known).alias("id"), "text")


def created(trees_: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A registry of trees (conv, ...) with ``fresh`` ones, and those refused because their conv exists or comes twice."""
    twice = fresh.groupBy("conv").count().where("count > 1").select("conv")
    taken = trees_.select("conv").unionByName(twice).distinct()
    return trees_.unionByName(fresh.join(taken, "conv", "left_anti")), fresh.join(taken, "conv", "left_semi")


def exist(trees_: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (conv) with ``exists``."""
    return wanted.join(trees_.select("conv", F.lit(True).alias("_is")).distinct(), "conv", "left").select(*wanted.columns, F.coalesce("_is", F.lit(False)).alias("exists"))


def merged(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each pair (conv, other_conv), both trees of ``nodes``, the second is hung into the first and gone as a tree of its own."""
    came = nodes.join(pairs.select(F.col("other_conv").alias("conv")), "conv", "left_semi")
    return merge(nodes.join(came.select("conv").distinct(), "conv", "left_anti"), came, pairs)


def indented(nodes: DataFrame, text: str = "text") -> DataFrame:
    """(conv, enter, line): nodes as lines of a walk, two spaces for each level."""
    p = placed(nodes)
    return p.join(nodes.select("conv", "id", text), ["conv", "id"]).select("conv", "enter", F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.col("id").cast("string"), F.lit(": "), F.col(text)).alias("line"))


def inactive(trees: DataFrame, now, hours: float) -> DataFrame:
    """Trees (conv, last: timestamp) without interaction for more than ``hours``."""
    return trees.where(F.lit(now) - F.col("last") > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600)))


def walk_keys(nodes: DataFrame, keys: list[str], key: str = "text") -> DataFrame:
    """(conv, id): where the path of ``keys`` from a root ends; one join per key."""
    at = nodes.where(F.col("parent").isNull() & (F.col(key) == keys[0])).select("conv", "id")
    for k in keys[1:]:
        at = nodes.where(F.col(key) == k).select("conv", F.col("id").alias("next"), F.col("parent").alias("id")).join(at, ["conv", "id"]).select("conv", F.col("next").alias("id"))
    return at
