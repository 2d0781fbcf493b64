"""Queries over embeddings. The query set of a search is every vector whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions import vectors as V
from braidwork.operators import similarity as S
from braidwork.sources.tables import table


def _vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"), "label")


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def semantic_topk(spark, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return S.search(_queries(v), v)


def similarity_threshold(spark, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return S.search(_queries(v), v, k=20, least=0.25)


def dot_topk(spark, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return S.search(_queries(v), v, k=3, measure="dot", skip_self=False)


def euclid_topk(spark, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return S.search(_queries(v), v, measure="euclid")


def similarity_matrix_stats(spark, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return S.score_stats(_queries(v), v).withColumn("mean", F.round("mean", 5))


def search_lists(spark, sf_dir: str) -> DataFrame:
    """One row per query: its hits of at least the threshold, best first."""
    hits = similarity_threshold(spark, sf_dir)
    return hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("hits"))


def keyword_neighbors(spark, sf_dir: str) -> DataFrame:
    return S.all_neighbours(_vectors(spark, sf_dir), 3)


def most_relevant_neighbors(spark, sf_dir: str) -> DataFrame:
    """Two hops: the best hit of each query, then the neighbours of that hit."""
    v = _vectors(spark, sf_dir)
    best = S.search(_queries(v), v, k=1).select("query_id", F.col("id").alias("best"))
    near = S.all_neighbours(v, 3, of=best.select(F.col("best").alias("id"))).withColumnRenamed("id", "best")
    return best.join(near, "best").select("query_id", "best", "other", "score", "rank")


def classify_nearest_label(spark, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return S.classify(v, S.centroids(v)).drop("rank")


def embedding_cache_miss(spark, sf_dir: str) -> DataFrame:
    """Documents with the vector of their id; those without one get their length as a vector."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    cache = _vectors(spark, sf_dir).select(F.col("id").alias("key"), "v")
    found = S.with_cache(docs, cache, lambda missing: docs.join(missing, "key").select("key", F.array(F.length("text").cast("double")).alias("v")))
    return found.select("key", F.size("v").alias("n"), F.round(F.get("v", F.lit(0)), 6).alias("head"))


def unified_space(spark, sf_dir: str) -> DataFrame:
    """Coordinates, first and last components side by side, and their length."""
    v = _vectors(spark, sf_dir)
    both = F.concat(F.array(F.lit(0.0), F.col("id").cast("double"), F.col("label").cast("double")), F.slice("v", 1, 3), F.slice("v", -3, 3))
    return v.select("id", F.size(both).alias("n"), F.round(V.norm(both), 4).alias("length"))


def cluster_documents(spark, sf_dir: str) -> DataFrame:
    return S.cluster(_vectors(spark, sf_dir).select("id", "v"))


def summarize_extractive(spark, sf_dir: str) -> DataFrame:
    return S.summarize(table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"))


def state_rate(spark, sf_dir: str) -> DataFrame:
    """The vectors of a label, in order of their ids, as states of one session."""
    v = _vectors(spark, sf_dir).select(F.col("label").alias("doc"), F.col("id").alias("i"), "v")
    return S.rate_of_change(v).select("doc", F.round("rate", 5).alias("rate"), F.round("step", 5).alias("step"))


def memory_decay(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("step"), F.col("event_type").alias("i"), F.col("value").alias("weight"))
    w = e.withColumn("step", F.expr("row_number() over (partition by doc order by step)"))
    return S.decayed(w, 0.9123).select("doc", "i", F.round("memory", 6).alias("memory"))


def segment_influence(spark, sf_dir: str) -> DataFrame:
    """Turns of a conversation as segments, seen from the last one; nearness of lengths stands for similarity."""
    c = table(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("i"), F.expr("max(turn) over (partition by conv_id)").alias("current"), F.length("text").alias("length"), (1 / (1 + F.col("turn"))).alias("similarity"), F.col("turn").cast("double").alias("distance"))
    return S.influence(s).select("doc", "i", F.round("influence", 6).alias("influence"))


_Q = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT id AS query_id, v AS q FROM v WHERE id % 20 = 0)"
_HITS = _Q + ", s AS (SELECT query_id, id, round(list_cosine_similarity(q, v), 6) AS score FROM q CROSS JOIN v)"


def _top(k: int, order: str, where: str = "query_id <> id") -> str:
    return f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS rank FROM s WHERE {where} QUALIFY rank <= {k}"


_NEAR = "n AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) AS rank FROM v a JOIN v b ON a.id <> b.id QUALIFY rank <= 3)"

QUERIES = {f.__name__: f for f in (
    semantic_topk, similarity_threshold, dot_topk, euclid_topk, similarity_matrix_stats, search_lists, keyword_neighbors, most_relevant_neighbors,
    classify_nearest_label, embedding_cache_miss, unified_space, cluster_documents, summarize_extractive, state_rate, memory_decay, segment_influence,
)}
SQL = {
    "semantic_topk": f"WITH {_HITS} {_top(5, 'score DESC')}",
    "similarity_threshold": f"WITH {_HITS}, t AS ({_top(20, 'score DESC')}) SELECT * FROM t WHERE score >= 0.25",
    "dot_topk": f"WITH {_Q}, s AS (SELECT query_id, id, round(list_inner_product(q, v), 6) AS score FROM q CROSS JOIN v) {_top(3, 'score DESC', 'true')}",
    "euclid_topk": f"WITH {_Q}, s AS (SELECT query_id, id, round(list_distance(q, v), 6) AS score FROM q CROSS JOIN v) {_top(5, 'score')}",
    "similarity_matrix_stats": f"WITH {_HITS} SELECT query_id, count(*) AS n, round(avg(score), 5) AS mean, min(score) AS least, max(score) AS most FROM s GROUP BY query_id",
    "search_lists": f"WITH {_HITS}, t AS ({_top(20, 'score DESC')}) SELECT query_id, list(id ORDER BY rank) AS hits FROM t WHERE score >= 0.25 GROUP BY query_id",
    "keyword_neighbors": f"WITH {_Q}, {_NEAR} SELECT * FROM n",
    "most_relevant_neighbors": f"WITH {_HITS}, {_NEAR}, t AS ({_top(1, 'score DESC')}) SELECT t.query_id, t.id AS best, n.other, n.score, n.rank FROM t JOIN n ON n.id = t.id",
    "classify_nearest_label": f"""WITH {_Q}, m AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS d FROM v) GROUP BY label, d),
c AS (SELECT label, list(x ORDER BY d) AS c FROM m GROUP BY label)
SELECT id, c.label, round(list_cosine_similarity(v.v, c.c), 6) AS score FROM v CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(v.v, c.c), 6) DESC, c.label) = 1""",
    "embedding_cache_miss": "SELECT doc_id AS key, CAST(coalesce(len(embedding), 1) AS INT) AS n, round(coalesce(embedding[1]::DOUBLE, length(text)::DOUBLE), 6) AS head FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "unified_space": "SELECT vec_id AS id, 9 AS n, round(sqrt(list_sum([x * x FOR x IN [vec_id::DOUBLE, label::DOUBLE] || embedding[1:3]::DOUBLE[] || embedding[-3:]::DOUBLE[]])), 4) AS length FROM embeddings",
    "state_rate": f"""WITH {_Q}, d AS (SELECT label AS doc, list_distance(v, lag(v) OVER (PARTITION BY label ORDER BY id)) AS d FROM v),
r AS (SELECT doc, avg(d) AS rate FROM d WHERE d IS NOT NULL GROUP BY doc) SELECT doc, round(rate, 5) AS rate, round(greatest(0.05, least(0.2, 1 / (1 + rate))), 5) AS step FROM r""",
    "memory_decay": """WITH e AS (SELECT user_id AS doc, event_type AS i, value AS weight, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
n AS (SELECT *, max(step) OVER (PARTITION BY doc) AS n FROM e)
SELECT doc, i, round(weight * pow(0.9123::DOUBLE, n - step + 1), 6) AS memory FROM n QUALIFY row_number() OVER (PARTITION BY doc, i ORDER BY step DESC) = 1""",
    "segment_influence": """WITH s AS (SELECT conv_id AS doc, turn AS i, max(turn) OVER w AS cur, length(text) AS len, count(*) OVER w AS n, max(length(text)) OVER w AS longest FROM conversations WINDOW w AS (PARTITION BY conv_id))
SELECT doc, i, round((1.0::DOUBLE / (abs(cur - i) + 1) + len::DOUBLE / greatest(longest, 1) + (i + 1)::DOUBLE / n + 1.0::DOUBLE / (1 + i)) / (i + 1), 6) AS influence FROM s""",
    "summarize_extractive": r"""WITH d AS (SELECT conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'assistant'),
s AS (SELECT id, text, unnest(string_split(text, '. ')) AS sentence, unnest(range(len(string_split(text, '. ')))) AS pos FROM d),
w AS (SELECT *, [('0x' || substr(md5(x), 1, 4))::INT % 64 FOR x IN regexp_split_to_array(lower(text), '[^a-z0-9]+') IF x <> ''] AS a, [('0x' || substr(md5(x), 1, 4))::INT % 64 FOR x IN regexp_split_to_array(lower(sentence), '[^a-z0-9]+') IF x <> ''] AS b FROM s WHERE trim(sentence) <> ''),
c AS (SELECT id, sentence, pos, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(list_cosine_similarity([len([y FOR y IN a IF y = d])::DOUBLE FOR d IN range(64)], [len([y FOR y IN b IF y = d])::DOUBLE FOR d IN range(64)]), 6) END AS score FROM w),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) <= 3)
SELECT id, string_agg(sentence, '. ' ORDER BY score, pos DESC) AS summary FROM t GROUP BY id""",
}
