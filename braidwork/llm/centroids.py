"""Centroid clustering (Lloyd's rounds) of integer vectors, filtered through kd-trees.

Every task builds kd-trees over blocks of its own vectors, once: a node holds
how many vectors it has, their exact integer sums and the box around them. In a
round all trees meet all centroids. From the root down, a centroid is pruned
from a node if another candidate is strictly nearer everywhere in the node's
box. A node with one candidate left is assigned whole, by its count and sums;
leaves with several are resolved exactly. Each task adds up counts and sums, so
at most ``k`` rows leave it.

Distances are whole numbers throughout, so ties and results do not depend on
how vectors are dealt out.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table, without

DIMENSIONS = 64
K = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Vectors of a tree, and of a leaf that is cut no further.
BLOCK = 8192
LEAF = 32
#: Largest integer component: squared distances of up to 64 such components fit in 63 bits.
LARGEST = 1 << 25
#: Up to this size doubles are exact too, and faster to multiply.
_EXACT = 1 << 21


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, floored, as longs."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """Whether a vector has exactly so many components, none null, not finite, or over the largest that exact sums of squares allow."""
    fine = lambda x: F.coalesce(F.abs(x.cast("double")) * scale <= LARGEST - 1, F.lit(False)) & ~F.isnan(x)
    return F.coalesce(F.size(vector) == dimensions, F.lit(False)) & F.coalesce(F.forall(vector, fine), F.lit(False))


def kd_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): nodes are rows (start, end, left), children at ``left`` and ``left + 1``, 0 for leaves; a node's vectors are ``x[order[start:end]]``.

    Nodes are cut at the median of their widest side; equal vectors are never cut.
    """
    order, nodes, at = np.arange(len(x)), [[0, len(x), 0]], 0
    while at < len(nodes):
        start, end, _ = nodes[at]
        own = x[order[start:end]]
        side = own.max(0) - own.min(0)
        j = int(side.argmax())
        if end - start > LEAF and side[j]:
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, j], middle)]
            nodes[at][2] = len(nodes)
            nodes += [[start, start + middle, 0], [start + middle, end, 0]]
        at += 1
    return order, np.array(nodes, np.int64)


def _trees(batches):
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
            order, nodes = kd_tree(x)
            x = x[order]
            prefix = np.vstack([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, 0)])
            low = np.array([x[s:e].min(0) for s, e, _ in nodes])
            high = np.array([x[s:e].max(0) for s, e, _ in nodes])
            rows = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0).take(pa.array(order)))
            binary = [pa.array([a.astype(np.int64).tobytes()], pa.binary()) for a in (x, nodes, prefix[nodes[:, 1]] - prefix[nodes[:, 0]], low, high)]
            yield pa.RecordBatch.from_arrays([rows, *binary], ["rows", "x", "nodes", "sums", "low", "high"])


def trees(vectors: DataFrame, vector: str, carry: list[str], dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """One row for each kd-tree over up to ``BLOCK`` usable vectors of a task, with the columns ``carry`` of its vectors in ``rows``."""
    kept = vectors.where(usable(vectors[f"`{vector}`"], dimensions, scale))
    given = kept.select(F.struct(*[kept[f"`{c}`"] for c in carry]).alias("row"), scaled(kept[f"`{vector}`"], scale).alias("x"))
    kind = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(_trees, f"rows array<{kind}>, x binary, nodes binary, sums binary, low binary, high binary")


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers, exactly; by doubles where they are small enough."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def filtered(nodes: np.ndarray, low: np.ndarray, high: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(whole nodes, their centroids, open leaves): leaves come with the candidates left.

    Goes down the tree level by level. The centroid nearest to the middle of
    a box tests all others: another is pruned if even in the corner that
    favours it most it is strictly farther.
    """
    whole, owner, leaves = [], [], []
    norm = (c * c).sum(1)
    at, alive = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    while len(at):
        lo, hi = low[at], high[at]
        far = norm - _dots(lo + hi, c)
        best = np.where(alive, far, np.iinfo(np.int64).max).argmin(1)
        for i, z in enumerate(best):
            u = c[alive[i]] - c[z]
            # the least of d(other) - d(best) over the box is at the corner that lies furthest along u
            least = norm[alive[i]] - norm[z] - 2 * (np.maximum(u, 0) @ hi[i] + np.minimum(u, 0) @ lo[i])
            alive[i, np.flatnonzero(alive[i])[least > 0]] = False
        single = alive.sum(1) == 1
        whole.append(at[single])
        owner.append(best[single])
        left = nodes[at, 2]
        leaves += [(int(at[i]), np.flatnonzero(alive[i])) for i in np.flatnonzero(~single & (left == 0))]
        inner = np.flatnonzero(~single & (left > 0))
        at = np.concatenate([left[inner], left[inner] + 1])
        alive = np.concatenate([alive[inner], alive[inner]])
    return np.concatenate(whole), np.concatenate(owner), leaves


def _leaf_owners(x: np.ndarray, c: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The nearest candidate of each vector; ties go to the smaller number."""
    some = c[candidates]
    return candidates[((some * some).sum(1) - 2 * _dots(x, some)).argmin(1)]


def _read(row: dict, width: int) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[n], np.int64).reshape(-1, 3 if n == "nodes" else width) for n in ("x", "nodes", "sums", "low", "high"))


def round_sums(grown: DataFrame, c: np.ndarray) -> DataFrame:
    """(cluster, n, s0, s1, ...): count and exact sums of the vectors nearest to each centroid."""
    k, width = c.shape

    def part(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            for row in b.to_pylist():
                x, nodes, sums, low, high = _read(row, width)
                whole, owner, leaves = filtered(nodes, low, high, c)
                np.add.at(n, owner, nodes[whole, 1] - nodes[whole, 0])
                np.add.at(total, owner, sums[whole])
                for at, candidates in leaves:
                    own = x[nodes[at, 0] : nodes[at, 1]]
                    to = _leaf_owners(own, c, candidates)
                    np.add.at(n, to, 1)
                    np.add.at(total, to, own)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), *[pa.array(total[held, j]) for j in range(width)]], ["cluster", "n", *[f"s{j}" for j in range(width)]])

    schema = "cluster int, n long, " + ", ".join(f"s{j} long" for j in range(width))
    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    tasks = grown.select("x", "nodes", "sums", "low", "high").mapInArrow(part, schema)
    return tasks.groupBy("cluster").agg(F.sum("n").alias("n"), *[exact(f"s{j}") for j in range(width)])


def assigned(grown: DataFrame, c: np.ndarray) -> DataFrame:
    """The rows of all trees with ``cluster`` and ``distance``, the squared distance to its centroid."""
    width = c.shape[1]
    kind = grown.schema["rows"].dataType.simpleString()

    def label(batches):
        for b in batches:
            rows = b.column(0)
            for i, row in enumerate(b.select(["x", "nodes", "sums", "low", "high"]).to_pylist()):
                x, nodes, _, low, high = _read(row, width)
                to = np.zeros(len(x), np.int32)
                whole, owner, leaves = filtered(nodes, low, high, c)
                for (start, end, _), z in zip(nodes[whole], owner):
                    to[start:end] = z
                for at, candidates in leaves:
                    start, end, _ = nodes[at]
                    to[start:end] = _leaf_owners(x[start:end], c, candidates)
                off = x - c[to]
                yield pa.RecordBatch.from_arrays([rows.slice(i, 1), pa.array([to], pa.list_(pa.int32())), pa.array([(off * off).sum(1)], pa.list_(pa.int64()))], ["rows", "clusters", "distances"])

    per_tree = grown.mapInArrow(label, f"rows {kind}, clusters array<int>, distances array<bigint>")
    each = per_tree.select(F.explode(F.arrays_zip("rows", "clusters", "distances")).alias("_v"))
    return each.select("_v.rows.*", F.col("_v.clusters").alias("cluster"), F.col("_v.distances").alias("distance"))


def first_centroids(vectors: DataFrame, vector: str, k: int = K, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> np.ndarray:
    """The ``k`` usable vectors with the least SHA-256 of ``seed:vec_id``, in that order; all, if there are fewer. Ties go to the smaller vector."""
    kept = vectors.where(usable(F.col(vector), dimensions, scale))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    found = kept.select(digest.alias("digest"), scaled(F.col(vector), scale).alias("x")).orderBy("digest", "x").limit(k).collect()
    return np.array([r.x for r in found], np.int64).reshape(len(found), dimensions)


def cluster(vectors: DataFrame, vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: its columns but for the vector, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    ``vectors`` needs vec_id and the array ``vector``. Every round assigns all
    vectors to the nearest centroid and replaces each centroid that has any by
    the floored mean; then all are assigned once more. Only ``k`` centroids
    and ``k`` rows of sums reach the driver.

    Defined results: vectors that are null, of another length, or hold a null
    or a component that is not finite are left out, and so are those with a
    component of 131,072 or more in size at a scale of 256, as squares of such
    do not fit a long; copies are clustered each; a null vec_id is hashed as
    the word "null"; with fewer than ``k`` vectors there are as many
    centroids; an empty table gives an empty table; input columns named like
    an output are replaced.
    """
    carry = without(vectors, vector, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").columns
    grown = materialize(trees(vectors, vector, carry, dimensions, scale), "kd-trees")
    c = first_centroids(vectors, vector, k, seed, dimensions, scale)
    for _ in range(rounds if len(c) else 0):
        c = c.copy()
        for r in round_sums(grown, c).collect():
            c[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dimensions)]
    labelled = materialize(assigned(grown, c), "labelled")
    discard(grown)
    digests = [(i, sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in enumerate(c.tolist())]
    names = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = labelled.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(names, "cluster").collect()  # at most k rows
    known = [(r["cluster"], r["cluster_inertia"], sum(q["cluster_inertia"] for q in per), r["centroid_sha256"]) for r in per]
    known = vectors.sparkSession.createDataFrame(known, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    whole = labelled.select(F.struct("*").alias("_row")).join(F.broadcast(known), F.col("_row.cluster") == F.col("_cluster"))
    return whole.select("_row.*", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cluster(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    """The same in DuckDB: one pair of common table expressions a round, every distance computed."""
    steps = [
        f"""v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), x) - 1 AS z, x AS c FROM v QUALIFY z < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT i, vec_id, x, z, c, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM v CROSS JOIN c{r}
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY distance, z) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT z, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
  SELECT z, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT z, unnest(range({DIMENSIONS})) AS j, unnest(x) AS y FROM d{r}) GROUP BY z, j) GROUP BY z),
c{r + 1} AS MATERIALIZED (SELECT z, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (z))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(z AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY z) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM d{rounds}"""


OP12_SQL = _sql()
