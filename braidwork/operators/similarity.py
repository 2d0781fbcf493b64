"""Search, classification and clustering over vectors (id, v: array<double>)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions import vectors as V
from braidwork.sources.shared import written

from .relational import small, top

#: Rows of a group of all_neighbours, about; rows and columns of a tile.
GROUP_ROWS = 16_384
TILE = 1024

#: How rows x of queries and y of a corpus compare, and whether more is nearer.
MEASURES = {
    "cosine": (lambda x, y: unit(x) @ unit(y).T, True),
    "dot": (lambda x, y: x @ y.T, True),
    "euclid": (lambda x, y: np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)), False),
}


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded as SQL rounds doubles: halves away from zero, where numpy's go to the even digit."""
    y = np.abs(x) * 10.0**digits
    low = np.floor(y)
    with np.errstate(invalid="ignore"):
        return np.copysign((low + (y - low >= 0.5)) / 10.0**digits, x)


def parts_of(n: int) -> int:
    """Groups to deal ``n`` vectors into, of about GROUP_ROWS at most."""
    return max(8, -(-n // GROUP_ROWS))


def usable(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null or empty and holds no null and only finite numbers."""
    fine = F.forall(column, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return rows.where((F.size(column) > 0) & F.coalesce(fine, F.lit(False)))


def _matrix(column) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)


def _blocks(queries: DataFrame, corpus: DataFrame, fold, schema: str, parts: int | None = None) -> DataFrame:
    """``fold`` (ids and rows of queries, ids and rows of the corpus) of every pair of a block of queries (query_id, q) and one of the corpus (id, v).

    Both are dealt by a hash of their id into blocks whose rows are bounded,
    by counts; no block holds a whole side. Vectors meet those of their own
    length; what is not ``usable`` takes no part.
    """
    queries, corpus = usable(queries, "q"), usable(corpus, "v")
    parts = parts or parts_of(corpus.count())
    sides = -(-queries.count() // GROUP_ROWS) or 1
    # Both sides' keys have one type: cogroups are dealt by a hash, which tells an int from a long.
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Fresh names on both sides, as they may come from the same rows.
    a = queries.select(F.col("query_id").alias("i"), F.col("q").alias("x"), F.size("q").alias("n"), deal("query_id", sides).alias("a"), each(parts).alias("b"))
    b = corpus.select(F.col("id").alias("j"), F.col("v").alias("y"), F.size("v").alias("n"), each(sides).alias("a"), deal("id", parts).alias("b"))
    out = pa.schema([(f.name, {"long": pa.int64(), "double": pa.float64()}[f.dataType.simpleString().replace("bigint", "long")]) for f in T.StructType.fromDDL(schema)])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        return pa.table(fold(left.column("i").to_numpy(), _matrix(left.column("x")), right.column("j").to_numpy(), _matrix(right.column("y"))), schema=out)

    return a.groupBy("n", "a", "b").cogroup(b.groupBy("n", "a", "b")).applyInArrow(met, schema)


def nearest_of(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, k: int, measure: str = "cosine", skip_self: bool = True, digits: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores): for each row of ``x`` (ids ``i``) the nearest ``k`` of ``y`` (ids ``j``), ties by id; missing ones score -inf, or inf where less is nearer.

    Tiles of ``y`` are multiplied one by one. A row's ``k``-th best so far, or
    the tile's own, says which scores may be among the best; the others are
    neither rounded nor sorted. Cosines are first made in single precision,
    within a bound of its error, and those that may be among the best in double.
    """
    compare, more = MEASURES[measure]
    sign = 1 if more else -1
    order = np.argsort(j, kind="stable")
    y, j = y[order], j[order]
    ids, best = np.zeros((len(i), k), np.int64), np.full((len(i), k), -np.inf)
    slack = 10.0**-digits  # twice what rounding moves a score by
    rough = measure == "cosine"
    if rough:
        x, y = unit(x), unit(y)
        x4, y4 = x.astype(np.float32), y.astype(np.float32)
        slack += 4 * (x.shape[1] + 8) * float(np.finfo(np.float32).eps)
    for r in range(0, len(i), TILE):
        rows = slice(r, r + TILE)
        for c in range(0, len(j), TILE):
            s = x4[rows] @ y4[c : c + TILE].T if rough else sign * compare(x[rows], y[c : c + TILE])
            limit = best[rows, -1]
            if s.shape[1] > k + 1 and np.isneginf(limit).any():  # one more, as the row itself may be among them
                limit = np.maximum(limit, np.partition(s, -k - 1, axis=1)[:, -k - 1])
            at, col = np.divmod(np.flatnonzero(~(s < (limit - slack).astype(s.dtype)[:, None])), s.shape[1])
            if skip_self:
                other = i[r + at] != j[c + col]
                at, col = at[other], col[other]
            if not len(at):
                continue
            exact = np.einsum("ij,ij->i", x[r + at], y[c + col]) if rough else sign * s[at, col]
            # With the best so far, each row's own in order of score and id.
            touched = np.unique(at)
            own = np.concatenate([np.repeat(touched, k), at])
            known = np.concatenate([ids[r + touched].ravel(), j[c + col]])
            score = np.concatenate([best[r + touched].ravel(), sign * rounded(exact, digits)])
            first = np.lexsort((known, -score, own))
            sizes = np.bincount(own, minlength=len(s))[touched]
            take = first[(np.cumsum(sizes) - sizes)[:, None] + np.arange(k)]
            ids[r + touched], best[r + touched] = known[take], score[take]
    return ids, sign * best


#: Pivots at most, and the sample that they are chosen from for each of them and at most.
MOST_PIVOTS, SAMPLE_EACH, MOST_SAMPLED = 4096, 64, 16_384
#: Scores are rounded to 6 digits: a bound this much beyond the worst of the best may still tie with it.
SLACK = 1e-6


class Pivots:
    """Centres that vectors are dealt to, the nearest one each; with the radius of each block they bound how near a query can be to anything in it."""

    def __init__(self, centres: np.ndarray, measure: str):
        self.measure = measure
        self.c = unit(centres) if measure == "cosine" else centres

    def distance(self, x: np.ndarray) -> np.ndarray:
        """Angles for cosine, else Euclidean distances: both obey the triangle inequality."""
        if self.measure == "cosine":
            return np.arccos(np.clip(unit(x) @ self.c.T, -1, 1))
        return MEASURES["euclid"][0](x, self.c)

    def best_score(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The best score that a vector of each block can have; no block with a better one may be left out."""
        if self.measure == "dot":  # x.y = x.c + x.(y - c)
            bound = x @ self.c.T + np.linalg.norm(x, axis=1, keepdims=True) * radius
            return bound + SLACK * (1 + np.abs(bound))
        least = np.maximum(self.distance(x) - radius - SLACK, 0)
        return np.cos(np.minimum(least, np.pi)) + SLACK if self.measure == "cosine" else least - SLACK * (1 + least)


def pivots(corpus: DataFrame, parts: int, measure: str) -> Pivots:
    """``parts`` centres far apart: each is the vector of a bounded sample, drawn by a hash of the id, that is farthest from those before."""
    parts = min(parts, MOST_PIVOTS)
    drawn = corpus.select("v").orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE_EACH * parts, MOST_SAMPLED)).collect()
    x = np.array([r["v"] for r in drawn], float)
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(parts, len(x)):
        far = np.minimum(far, Pivots(x[chosen[-1:]], measure).distance(x)[:, 0])
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return Pivots(x[chosen], measure)


def _homes(rows: DataFrame, key: str, column: str, at: Pivots) -> DataFrame:
    """``rows`` (key, column) with ``block``, the nearest pivot, and the distance to it."""

    def deal(batches):
        for b in batches:
            if b.num_rows:
                far = at.distance(_matrix(pa.chunked_array([b.column(1)])))
                block = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block, pa.int32()), pa.array(far[np.arange(len(far)), block])], [key, column, "block", "far"])

    return rows.select(F.col(key).cast("long").alias(key), column).mapInArrow(deal, f"{key} long, {column} array<double>, block int, far double")


def _dealt(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``sub``, which splits blocks of more than GROUP_ROWS rows, and (block, n, radius, subs) of all blocks: at most as many rows as pivots."""
    sizes = written(rows.groupBy("block").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("subs", F.ceil(F.col("n") / GROUP_ROWS).cast("int")), "blocks")
    return rows.join(F.broadcast(sizes.select("block", "subs")), "block").withColumn("sub", F.pmod(F.xxhash64(key), F.col("subs")).cast("int")).drop("subs", "far"), sizes


def _met(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int, measure: str, skip_self: bool) -> DataFrame:
    """(query_id, id, score): of each group of ``keys`` the best of its corpus rows for each of its queries."""
    out = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        i, j = left.column("i").to_numpy(), right.column("j").to_numpy()
        ids, scores = nearest_of(_matrix(left.column("x")), i, _matrix(right.column("y")), j, k, measure, skip_self)
        row, col = np.nonzero(np.isfinite(scores))
        return pa.table([i[row], ids[row, col], scores[row, col]], schema=out)

    # Fresh names on both sides, as they may come from the same rows.
    named = lambda side: [F.col(c).alias(f"{side}{n}") for n, c in enumerate(keys)]
    by = lambda side: [f"{side}{n}" for n in range(len(keys))]
    a = queries.select(F.col("query_id").alias("i"), F.col("q").alias("x"), *named("a"))
    b = corpus.select(F.col("id").alias("j"), F.col("v").alias("y"), *named("b"))
    return a.groupBy(*by("a")).cogroup(b.groupBy(*by("b"))).applyInArrow(best, "query_id long, id long, score double")


def _visits(asked: DataFrame, first: DataFrame, at: Pivots, sizes: DataFrame, k: int) -> DataFrame:
    """(query_id, q, block, sub, target): the other blocks where a query (query_id, q) may find something as near as its ``k``-th of ``first``; queries with fewer than ``k`` yet go everywhere."""
    more = MEASURES[at.measure][1]
    known = {r["block"]: r["radius"] for r in sizes.collect()}  # as many as pivots at most
    blocks = np.array(sorted(known), np.int32)
    radius = np.array([known[b] for b in blocks])
    some = Pivots.__new__(Pivots)
    some.measure, some.c = at.measure, at.c[blocks]

    @F.arrow_udf("array<int>")
    def open_blocks(q: pa.Array, home: pa.Array, worst: pa.Array) -> pa.Array:
        bound, limit = some.best_score(_matrix(pa.chunked_array([q])), radius), worst.to_numpy(zero_copy_only=False)[:, None]
        alive = np.isnan(limit) | ((bound >= limit) if more else (bound <= limit))
        return pa.array([blocks[row] for row in alive], pa.list_(pa.int32()))

    worst = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") if more else F.max("score")).alias("worst"))
    limited = asked.join(worst, "query_id", "left")
    return limited.select("query_id", "q", "block", "sub", F.explode(open_blocks("q", "block", F.col("worst").cast("double"))).alias("target"))


def pruned_search(queries: DataFrame, corpus: DataFrame, k: int, measure: str, skip_self: bool, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score) with the exact ``k`` best of each query among others, visits (query_id, target)) of vectors of one length.

    The corpus is dealt to its nearest pivots. A query first searches the
    block of its own pivot; its ``k``-th best there and the blocks' radii tell
    by the triangle inequality which other blocks can hold anything as near,
    and only those it visits. Queries that share a pivot go together, and a
    block's rows are sent only where some query of such a group visits it. On
    vectors without clusters no block can be left out, and every group meets
    every block as it must.
    """
    n = corpus.count()
    if not n:
        none = queries.sparkSession.createDataFrame([], "query_id long, id long, score double, target int")
        return none.drop("target"), none.select("query_id", "target")
    at = pivots(corpus, parts or parts_of(n), measure)
    rows, sizes = _dealt(written(_homes(corpus, "id", "v", at), "corpus"), "id")
    asked, _ = _dealt(written(_homes(queries, "query_id", "q", at), "queries"), "query_id")
    asked = asked.withColumnRenamed("sub", "side")
    # One part of the query's own block is enough for a first limit.
    near = rows.where("sub = 0")
    sides = asked.select("block", "side").distinct()
    first = written(_met(asked, near.join(small(sides), "block"), ["block", "side"], k, measure, skip_self), "near")
    visits = written(_visits(asked.withColumnRenamed("side", "sub"), first, at, sizes, k), "visits")
    parts_ = sizes.select(F.col("block").alias("target"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("tsub"))
    goes = visits.join(F.broadcast(parts_), "target").where("NOT (target = block AND tsub = 0)")
    pairs = written(goes.select("block", "sub", "target", "tsub").distinct(), "block-pairs")
    keys = ["block", "sub", "target", "tsub"]
    sent = rows.withColumnsRenamed({"block": "target", "sub": "tsub"}).join(small(pairs), ["target", "tsub"])
    return first.unionByName(_met(goes, sent, keys, k, measure, skip_self)), visits.select("query_id", "target")


def search(queries: DataFrame, corpus: DataFrame, k: int = 5, measure: str = "cosine", least: float | None = None, skip_self: bool = True, parts: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the exact ``k`` nearest per query (query_id, q), ties by id, and of those only scores of ``least`` or more.

    Queries visit the blocks of the corpus that can hold their nearest, see
    ``pruned_search``. Vectors meet those of their own length; null or empty
    ones, and those with a null or a component that is not finite, take no part.
    """
    queries, corpus = usable(queries, "q"), usable(corpus, "v")
    lengths = sorted(r[0] for r in queries.select(F.size("q")).distinct().collect())  # one, in a table of embeddings
    found = [pruned_search(queries.where(F.size("q") == n), corpus.where(F.size("v") == n), k, measure, skip_self, parts)[0] for n in lengths]
    if not found:
        found = [queries.sparkSession.createDataFrame([], "query_id long, id long, score double")]
    best_ = top(reduce(DataFrame.unionByName, found), ["query_id"], [F.desc("score") if MEASURES[measure][1] else F.asc("score"), "id"], k)
    return best_ if least is None else best_.where(F.col("score") >= least)


def score_stats(queries: DataFrame, corpus: DataFrame, measure: str = "cosine", digits: int = 6) -> DataFrame:
    """(query_id, n, mean, least, most) of the rounded scores of each query against all of the corpus."""

    def fold(i, x, j, y):
        found = []
        for r in range(0, len(i), TILE):
            parts = [rounded(MEASURES[measure][0](x[r : r + TILE], y[c : c + TILE]), digits) for c in range(0, len(j), TILE)]
            found.append((sum(p.sum(1) for p in parts), np.min([p.min(1) for p in parts], axis=0), np.max([p.max(1) for p in parts], axis=0)))
        return [i, np.full(len(i), len(j), np.int64), *(np.concatenate([f[c] for f in found]) for c in range(3))]

    rows = _blocks(queries, corpus, fold, "query_id long, n long, total double, least double, most double")
    n = F.sum("n")
    return rows.groupBy("query_id").agg(n.alias("n"), (F.sum("total") / n).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))


def all_neighbours(vectors: DataFrame, k: int, parts: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """(id, other, score, rank): the exact ``k`` nearest by cosine of every vector, or of those whose id is in ``of``."""
    asked = vectors if of is None else vectors.join(of.select("id").distinct(), "id", "left_semi")
    found = search(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), vectors, k, parts=parts)
    return found.withColumnRenamed("id", "other").withColumnRenamed("query_id", "id").select("id", "other", "score", "rank")


def enhanced(queries: DataFrame, corpus: DataFrame, n: int = 10, k: int = 5, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Search with keywords: (the ``n`` best hits with scores of ``least`` or more, and (query_id, id, other, score, rank): of each of the ``n`` hits the ``k`` most similar among them, itself included)."""
    hits = search(queries, corpus, n)
    both = hits.select("query_id", "id").join(corpus.select("id", "v"), "id")
    other = both.select("query_id", F.col("id").alias("other"), F.col("v").alias("w"))
    pairs = both.join(other, "query_id")  # n * n for a query
    scored = pairs.select("query_id", "id", "other", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("score"))
    return hits.where(F.col("score") >= least), top(scored, ["query_id", "id"], [F.desc("score"), "other"], k)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, c): mean per dimension."""
    means = vectors.select(label, F.posexplode("v").alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("x"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))


def classify(vectors: DataFrame, labels: DataFrame, k: int = 1, least: float | None = None) -> DataFrame:
    """(id, label, score): the nearest labels (label, c) of each vector. Few labels, counted, are broadcast; many meet the vectors in blocks."""
    if labels.limit(1001).count() > 1000:
        found = search(vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q")), labels.select(F.col("label").cast("long").alias("id"), F.col("c").alias("v")), k, skip_self=False)
        best = found.select(F.col("query_id").alias("id"), F.col("id").alias("label"), "score", "rank")
    else:
        scored = vectors.select("id", "v").join(F.broadcast(labels), how="cross").select("id", "label", F.round(V.cosine(F.col("v"), F.col("c")), 6).alias("score"))
        best = top(scored, ["id"], [F.desc("score"), "label"], k)
    return best if least is None else best.where(F.col("score") >= least)


def with_cache(wanted: DataFrame, cache: DataFrame, encode) -> DataFrame:
    """(key, v): cached vectors, and ``encode`` of the keys that are not cached."""
    missing = wanted.select("key").distinct().join(cache, "key", "left_anti")
    return wanted.select("key").distinct().join(cache, "key").unionByName(encode(missing))


def encoded_pairs(pairs: DataFrame, encode) -> DataFrame:
    """``pairs`` (..., prompt, response) with both vectors and their ``similarity``: each distinct text is encoded once (``encode``: key to key and v) and joined back to both sides."""
    unique = pairs.select(F.explode(F.array("prompt", "response")).alias("key")).distinct()
    v = written(encode(unique).select("key", "v"), "encoded")
    side = lambda s: v.select(F.col("key").alias(s), F.col("v").alias(f"{s}_v"))
    both = pairs.join(side("prompt"), "prompt", "left").join(side("response"), "response", "left")
    return both.withColumn("similarity", F.round(V.cosine(F.col("prompt_v"), F.col("response_v")), 6))


def update_vectors(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """``messages`` (id, ..., v) with the new vectors (id, v) of their ids; a vector whose id no message has is an error."""
    new = vectors.select(F.col("id").alias("_id"), F.col("v").alias("_v"))
    both = messages.withColumn("_known", F.lit(True)).join(new, F.col("id") == F.col("_id"), "full")
    text = F.concat(F.lit("no message with the id "), F.col("_id").cast("string"))
    fine = F.when(F.col("_known"), F.coalesce("_v", "v")).otherwise(F.raise_error(text).cast(messages.schema["v"].dataType))
    return both.withColumn("v", fine).select(*messages.columns)


def encoded_columns(df: DataFrame, names: list[str], encode) -> DataFrame:
    """``df`` with "<name> embedding" for each text column: ``encode`` of a column, null for null."""
    return df.withColumns({f"{n} embedding": F.when(F.col(n).isNotNull(), encode(F.col(n))) for n in names})


def bag_of_words(text, dims: int = 64):
    """A deterministic encoder: counts of words by the first bits of their MD5, scaled to length 1 (zero without words)."""
    # Each step is bound to a lambda's variable, so that it is computed once per text.
    slots = F.transform(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""), lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dims))
    count = lambda s: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(s, lambda x: x == d)).cast("double"))
    counts = F.transform(F.array(slots), count)
    lengths = F.transform(counts, lambda c: F.named_struct(F.lit("c"), c, F.lit("n"), V.norm(c)))
    return F.get(F.transform(lengths, lambda x: F.transform(x["c"], lambda c: F.when(x["n"] == 0, F.lit(0.0)).otherwise(c / x["n"]))), F.lit(0))


def summarize(docs: DataFrame, n: int = 3, dims: int = 64) -> DataFrame:
    """(id, summary): the ``n`` sentences nearest to the whole text, in ascending order of similarity, joined by ". "."""
    rows = docs.select("id", bag_of_words(F.col("text"), dims).alias("whole"), F.posexplode(F.split("text", r"\. ")).alias("pos", "sentence"))
    scored = rows.where(F.trim("sentence") != "").select("id", "pos", "sentence", F.round(V.cosine(bag_of_words(F.col("sentence"), dims), F.col("whole")), 6).alias("score"))
    best = top(scored, ["id"], [F.desc("score"), "pos"], n)
    ordered = F.array_sort(F.collect_list(F.struct("score", (-F.col("pos")).alias("back"), "sentence")))
    return best.groupBy("id").agg(F.array_join(F.transform(ordered, lambda s: s["sentence"]), ". ").alias("summary"))


def keyword_clusters(texts: DataFrame, encode, k: int = 5) -> DataFrame:
    """(cluster, size, terms, pos): the distinct keywords (term), encoded, clustered and grouped; clusters without terms stay."""
    from .paths import grouped_terms

    # Clustering reads the vectors again and again: texts are read, and each keyword encoded, once.
    terms = written(texts.select("term").distinct().withColumn("id", F.xxhash64("term")), "terms")
    found = cluster(written(terms.select("id", encode(F.col("term")).alias("v")), "term-vectors"), k)
    return grouped_terms(terms.join(found, "id"), k)


def coordinates(vectors: DataFrame, components: int = 3, neighbours: int = 10) -> DataFrame:
    """(id, x0, x1, ...): ``vectors`` (id, v) in a few dimensions that keep neighbours together, see ``manifold``."""
    from .manifold import eigenmap, neighbour_graph

    return eigenmap(neighbour_graph(vectors, neighbours), components, rounds=40, settled=1e-3)[0]


def cluster(vectors: DataFrame, k: int = 5, components: int = 3, seed: int = 42) -> DataFrame:
    """(id, cluster): ``coordinates``, then k-means. Vectors that are not ``usable`` take no part."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    placed = coordinates(vectors, components)
    reduced = VectorAssembler(inputCols=[f"x{n}" for n in range(components)], outputCol="p").transform(placed)
    model = KMeans(k=k, seed=seed, featuresCol="p", predictionCol="cluster", tol=1e-9, maxIter=50).fit(reduced)
    return model.transform(reduced).select("id", "cluster")


def influence(segments: DataFrame, weights=(1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """``segments`` (doc, i, current, length, similarity, distance) with ``influence``: nearness in order, length, recency and similarity, over distance."""
    w = W.partitionBy("doc")
    n = F.count("*").over(w)
    longest = F.greatest(F.max("length").over(w), F.lit(1))
    near = weights[0] / (F.abs(F.col("current") - F.col("i")) + 1) + weights[1] * F.col("length") / longest
    return segments.withColumn("influence", (near + weights[2] * (F.col("i") + 1) / n + weights[3] * F.col("similarity")) / (F.col("distance") + 1))


def rate_of_change(states: DataFrame) -> DataFrame:
    """(doc, rate, step): mean distance between states (doc, i, v) that follow each other, and the time step it gives, in [0.05, 0.2]."""
    before = F.lag("v").over(W.partitionBy("doc").orderBy("i"))
    moved = states.withColumn("b", before).where("b IS NOT NULL").select("doc", V.euclid(F.col("v"), F.col("b")).alias("d"))
    r = moved.groupBy("doc").agg(F.avg("d").alias("rate"))
    return r.withColumn("step", F.greatest(F.lit(0.05), F.least(F.lit(0.2), 1 / (1 + F.col("rate")))))


def decayed(visits: DataFrame, decay: float) -> DataFrame:
    """(doc, i, memory): each step sets a cell to its weight, then all cells decay; of the last visit (doc, step, i, weight) of a cell that is weight * decay ** (steps - step + 1)."""
    steps = F.max("step").over(W.partitionBy("doc"))
    last = top(visits.withColumn("n", steps), ["doc", "i"], [F.desc("step")], 1)
    return last.select("doc", "i", (F.col("weight") * F.pow(F.lit(decay), F.col("n") - F.col("step") + 1)).alias("memory"))
