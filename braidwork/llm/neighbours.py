"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Vectors that are equal are one node. The first lists come from blocks of
vectors that are next to each other in the order of random cuts. In each round
of NN-descent every node gathers its neighbours and those that have it as a
neighbour, by a join, and each of them learns of the others it met: neighbours
of neighbours. Rounds end when few entries of the lists change. A query walks
the graph from its own node: it joins the best nodes that it has not expanded
with their neighbours, keeps the best ``width`` it knows, and ends when all of
those are expanded. Scores within are the cosine less one, half the squared
distance of unit vectors, so that floats tell near copies apart. What may be
among the nearest, given their rounding, is scored anew on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, discard, materialize, table

DEGREE = 24
TREES = 4
#: Rounds end when a smaller share of the entries is new, or after so many.
SETTLED = 0.15
ROUNDS = 8
WIDTH = 256
STEP = 128
BLOCK = 256
OFFERS = 8
#: Rows of the adjacency, of up to 64 vectors each, that are read or written at once.
GROUP_ROWS = 1024
#: Random cuts that order the vectors of a tree.
CUTS = 48
#: Bytes of a table that is broadcast, by a count of its rows; what a row takes besides its vectors, by one key and by two.
BROADCAST_BYTES, ROW_BYTES, PAIR_BYTES = 32 << 20, 96, 224


def _pack(x: np.ndarray) -> list[bytes]:
    """Unit vectors as the bytes of float32 components, each off by at most 2**-25 of a unit."""
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return [r.tobytes() for r in unit]


def _unpack(packed: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.float32).reshape(-1, dims)


def _rows(dims: int, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "other", "score"])


def _meet(dims: int, most: int, by_group: bool):
    """Compares the members (group, id, packed, worst) of each block of up to BLOCK rows with each other.

    Each offers the others its ``most`` best that beat their worst neighbour.
    Blocks end where a group ends, if ``by_group``; larger groups are cut.
    """

    def meet(batches):
        def flush(parts):
            ids, x, worst = (np.concatenate([p[k] for p in parts]) for k in range(3))
            x = x.astype(np.float64)  # near vectors differ in the last digits of their products
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            s = x @ x.T - 1
            s[ids[:, None] == ids[None, :]] = -4
            k = min(most, len(ids) - 1)
            if k < 1:
                return None
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(s, top, 1)
            good = best > worst[:, None]
            row, col = np.nonzero(good)
            return ids[row], ids[top[row, col]], best[row, col].astype(np.float32)

        held, size, out, last = [], 0, [], None
        for batch in batches:
            groups, ids, worst = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            if not len(ids):
                continue
            x = _unpack(batch.column(2), dims)
            cuts = np.append(0, np.flatnonzero(np.diff(groups)) + 1) if by_group else np.arange(0, len(ids), BLOCK)
            for a, b in zip(cuts, np.append(cuts[1:], len(ids))):
                fresh = by_group and groups[a] != last
                last = groups[a]
                if fresh and size:
                    out.append(flush(held))
                    held, size = [], 0
                while a < b:
                    end = min(b, a + BLOCK - size)
                    held.append((ids[a:end], x[a:end], worst[a:end]))
                    size += end - a
                    a = end
                    if size == BLOCK:
                        out.append(flush(held))
                        held, size = [], 0
            out = [o for o in out if o is not None]
            if out:
                yield _rows(dims, *(np.concatenate([o[k] for o in out]) for k in range(3)))
                out = []
        if size and (last := flush(held)) is not None:
            yield _rows(dims, *last)

    return meet


_OUT = "id long, other long, score float"


def _best(rows: DataFrame, key: str, keep: int) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.desc("score"), "other")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= keep).drop("_k")


def build_graph(nodes: DataFrame, dims: int, degree: int = DEGREE, trees: int = TREES, rounds: int = ROUNDS, settled: float = SETTLED, seed: int = 5) -> DataFrame:
    """(id, other, score): up to ``degree`` near neighbours of each of ``nodes`` (id, packed)."""
    n = nodes.count()
    cuts = np.random.default_rng(seed).normal(size=(trees, CUTS, dims)).astype(np.float32)

    def sides(batches):
        for b in batches:
            x = _unpack(b.column(1), dims)
            for t in range(trees):
                # The first cuts weigh most: rows that follow each other are on the same side of many.
                code = ((x @ cuts[t].T > 0) @ (1 << np.arange(CUTS)[::-1])).astype(np.int64) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code + (t << CUTS)), b.column(0), b.column(1), pa.array(np.full(len(x), -4, np.float32))], ["leaf", "id", "packed", "worst"])

    leaves = nodes.select("id", "packed").mapInArrow(sides, "leaf long, id long, packed binary, worst float")
    leaves = leaves.repartitionByRange(trees * n // (40 * BLOCK) + 1, "leaf").sortWithinPartitions("leaf", "id")
    graph = leaves.mapInArrow(_meet(dims, degree, False), _OUT).groupBy("id", "other").agg(F.max("score").alias("score"))
    graph = materialize(_best(graph, "id", degree), "graph")
    for turn in range(rounds):
        worst = graph.groupBy("id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
        known = nodes.select("id", "packed").join(worst, "id", "left")
        known = known.select(F.col("id").alias("v"), "packed", F.when(F.col("n") == degree, F.col("worst")).otherwise(F.lit(-4.0)).cast("float").alias("worst"))
        ends = both_ways(graph)
        # A hub's neighbours meet in parts, other ones in each round; no part is larger than a few blocks.
        parts = ends.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1")
        met = ends.join(known, "v").join(parts, "u", "left")
        part = F.pmod(F.xxhash64("v", F.lit(turn)), F.coalesce("parts", F.lit(1)))
        met = met.select(F.xxhash64("u", part).alias("meeting"), F.col("v").alias("id"), "packed", "worst")
        offers = met.repartition("meeting").sortWithinPartitions("meeting", F.xxhash64("id", F.lit(turn))).mapInArrow(_meet(dims, OFFERS, True), _OUT)
        merged = graph.withColumn("old", F.lit(True)).unionByName(offers.withColumn("old", F.lit(False)))
        merged = merged.groupBy("id", "other").agg(F.max("score").alias("score"), F.bool_or("old").alias("old"))
        fresh = materialize(_best(merged, "id", degree), "graph")
        discard(graph)
        changed = fresh.agg(F.avg((~F.col("old")).cast("double"))).first()[0] or 0.0
        graph = fresh.drop("old")
        graph._written_at = fresh._written_at
        if changed < settled:
            break
    return graph


def both_ways(graph: DataFrame) -> DataFrame:
    """(u, v): the links of a graph and their reverse, each once."""
    there = graph.select(F.col("id").alias("u"), F.col("other").alias("v"))
    return there.unionByName(there.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, dims: int, width: int = WIDTH, step: int = STEP, most_hops: int = 64) -> DataFrame:
    """(id, other, score): the best ``width`` nodes that a greedy walk from each of ``queries`` (id, packed) meets; scores are of packed vectors.

    Each hop expands up to ``step`` of the best ``width`` nodes of a query, so
    walks end well before ``most_hops``; one that does not is an error.
    """
    ends = both_ways(graph)
    near = ends.join(nodes.select(F.col("id").alias("v"), "packed"), "v")
    # One row for about 64 neighbours, so that a hub is many rows and no large one.
    hubs = ends.groupBy("u").agg(F.ceil(F.count("*") / 64).alias("parts"))
    near = near.join(hubs, "u").groupBy("u", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"))
    near = materialize(near.agg(F.collect_list("v").alias("ids"), F.collect_list("packed").alias("packs")), "adjacency", GROUP_ROWS)

    def far(own, packs, sizes):
        """Scores of some rows of a batch, whose unpacked vectors are not held all at once."""
        apart = np.repeat(_unpack(own, dims), sizes, axis=0) - _unpack(packs.flatten(), dims)
        return np.einsum("ij,ij->i", apart, apart) * np.float32(-0.5)

    def walk(batches):
        for b in batches:
            if not len(b):
                continue
            ids, packs = b.column(2), b.column(3)
            sizes = np.diff(ids.offsets.to_numpy())
            score = np.concatenate([far(b.column(1).slice(at, 128), packs.slice(at, 128), sizes[at : at + 128]) for at in range(0, len(b), 128)])
            good = score >= np.repeat(b.column(4).to_numpy(), sizes)  # others would not stay among the best
            q, v, score = np.repeat(b.column(0).to_numpy(), sizes)[good], ids.flatten().to_numpy()[good], score[good]
            order = np.lexsort((v, q))  # a neighbour may come several times
            q, v, score = q[order], v[order], score[order]
            once = np.append(True, (np.diff(q) != 0) | (np.diff(v) != 0)) & (q != v)
            q, v, score = q[once], v[once], score[once]
            order = np.lexsort((v, -score, q))
            q, v, score = q[order], v[order], score[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < width
            yield _rows(dims, q[keep], v[keep], score[keep].astype(np.float32))

    # Vectors of queries are sent to each task, where they are few; else they go with the front.
    asked = queries.count() * (4 * dims + ROW_BYTES)
    apart = asked <= BROADCAST_BYTES
    row_bytes = ROW_BYTES + (0 if apart else 4 * dims)
    start = queries.select("id", F.col("id").alias("other"), F.lit(2.0).cast("float").alias("score"), F.lit(False).alias("done"))
    state = materialize(start, "walk")
    for hop in range(most_hops + 1):
        by_score = W.partitionBy("id").orderBy(F.desc("score"), "other")
        # The worst of a query that has ``width`` nodes bounds what its walk looks for.
        each = W.partitionBy("id")
        least = F.when(F.count("*").over(each) >= width, F.min("score").over(each)).otherwise(F.lit(-4.0)).cast("float")
        front = state.withColumn("least", least).where("NOT done").withColumn("_k", F.row_number().over(by_score)).where(F.col("_k") <= step).select("id", F.col("other").alias("u"), "least")
        front = materialize(front if apart else front.join(queries.hint("merge"), "id").select("id", "packed", "u", "least"), "front")
        size = front.count()
        if not size:
            break
        if hop == most_hops:
            raise RuntimeError(f"walks did not end in {most_hops} hops")
        met = near.join(bounded(front, size, row_bytes, BROADCAST_BYTES), "u")
        met = met.join(F.broadcast(queries), "id") if apart else met
        found = met.select("id", "packed", "ids", "packs", "least").mapInArrow(walk, _OUT)
        done = front.select("id", F.col("u").alias("other"), F.lit(True).alias("now"))
        known = state.join(bounded(done, size, PAIR_BYTES, BROADCAST_BYTES), ["id", "other"], "left").select("id", "other", "score", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        merged = known.unionByName(found.withColumn("done", F.lit(False))).groupBy("id", "other").agg(F.max("score").alias("score"), F.bool_or("done").alias("done"))
        fresh = materialize(_best(merged, "id", width), "walk", large_rows=True)
        discard(state, front)
        state = fresh
    return state.select("id", "other", "score")


def scaled(v: Column) -> Column:
    """A vector times the power of two that makes its largest component about 1: cosines stay the same, squares neither vanish nor overflow."""
    up = F.least(-F.floor(F.log2(F.array_max(F.transform(v, lambda x: F.abs(x))))), F.lit(1000))
    return F.get(F.transform(F.array(F.pow(F.lit(2.0), up)), lambda s: F.transform(v, lambda x: x * s)), F.lit(0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, degree: int = DEGREE, rounds: int = ROUNDS, width: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found to each query row of ``vectors`` (vec_id, embedding), by cosine in double precision.

    ``width`` is by default WIDTH, or the square root of the number of nodes
    if that is more. Defined results: vectors that are null, zero, hold null
    or non-finite components, or differ in size from most, and rows with null
    ids, take no part; repeated ids count once; equal vectors (up to a power
    of two) are one node and all can be results, of which the k + 1 smallest
    ids of a node are enough; ties go to the smaller vec_id; fewer candidates
    than ``k`` are all returned; an empty table gives no rows. Walks see
    unit vectors in float32 and score differences, so that they order near
    copies too; what is as near as their rounding is scored anew.
    """
    v = F.col("v")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = usable.where(F.col("vec_id").isNotNull() & fine)
    sizes = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    dims = sizes[0][0]
    usable = usable.where(F.size("v") == dims).dropDuplicates(["vec_id"]).withColumn("v", scaled(v))
    few = usable.withColumn("_k", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("_k") <= k + 1)
    reps = materialize(few.groupBy("v").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")

    def pack(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dims)
            packed = _pack(x) if len(x) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["id", "packed"])

    nodes = materialize(reps.select("id", "v").mapInArrow(pack, "id long, packed binary"), "nodes")
    n = nodes.count()
    asked = usable.where("asks").select("vec_id", "v").join(reps.select("v", "id"), "v").select(F.col("vec_id").alias("query_id"), "id")
    asked = materialize(asked, "queries")
    graph = build_graph(nodes, dims, degree, rounds=rounds)
    queries = materialize(nodes.join(asked.select("id").distinct(), "id").select("id", "packed"), "query-nodes")
    found = search(graph, nodes, queries, dims, width or max(WIDTH, int(n**0.5)))
    # Distances of packed vectors are off by ``off`` at most, that of the last of the nearest and that of another: what is farther is not scored anew.
    by_score = W.partitionBy("id").orderBy(F.desc("score"), "other")
    off = 1.01 * dims**0.5 * 2.0**-24
    fifth = F.min(F.when(F.col("_k") <= k + 1, F.col("score"))).over(W.partitionBy("id")).cast("double")
    least = -F.pow(F.sqrt(F.greatest(-2 * fifth, F.lit(0.0))) * (1 + dims * 2.0**-23) + 2 * off, F.lit(2)) / 2
    found = found.withColumn("_k", F.row_number().over(by_score)).withColumn("least", least).where("score >= least").select("id", "other")
    pairs = asked.join(found.unionByName(queries.select("id", F.col("id").alias("other"))).distinct(), "id")
    exact = pairs.join(reps.select("id", F.col("v").alias("a")), "id").join(reps.select(F.col("id").alias("other"), F.col("v").alias("b"), "ids"), "other")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = total(F.zip_with("a", "b", lambda x, y: x * y))
    norm = lambda c: F.sqrt(total(F.transform(c, lambda x: x * x)))
    scored = exact.select("query_id", "ids", (dot / (norm("a") * norm("b"))).alias("score"))
    scored = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 50 == 0)
