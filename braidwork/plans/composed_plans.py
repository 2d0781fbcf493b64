"""Queries that put operators together: validation, owner checks, cached encodings, trees that are joined, paths, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import text as X
from braidwork.functions import vectors as V
from braidwork.operators import history as H
from braidwork.operators import merkle as M
from braidwork.operators import paths as P
from braidwork.operators import relational as R
from braidwork.operators import similarity as S
from braidwork.operators import trees as T
from braidwork.sources import files
from braidwork.sources.shared import shared_dir
from braidwork.sources.tables import table

from .similarity_plans import _queries, _vectors
from .tree_plans import _leaves, _nodes, _slim


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


def _parents(spark, d):
    parts, suppliers = table(spark, d, "part").where("p_size < 25"), table(spark, d, "supplier").where("s_acctbal > 0")
    return (parts, {"l_partkey": "p_partkey"}), (suppliers, {"l_suppkey": "s_suppkey"})


def fk_two_parents(spark, d):
    """Lines whose part and whose supplier, each in a table of its own, exist."""
    return R.accepted(_lines(spark, d), *_parents(spark, d)).select("l_orderkey", "l_linenumber")


def fk_two_parents_rejected(spark, d):
    return R.rejected(_lines(spark, d), *_parents(spark, d)).select("l_orderkey", "l_linenumber")


def bridge_pair(spark, d):
    """Lines not returned whose part and supplier also stand together on a returned one."""
    lines = _lines(spark, d)
    return R.accepted(lines.where("l_returnflag = 'A'"), (lines.where("l_returnflag = 'R'"), {"l_partkey": "l_partkey", "l_suppkey": "l_suppkey"})).select("l_orderkey", "l_linenumber")


def vector_update(spark, d):
    v = _vectors(spark, d)
    new = v.where("id % 7 = 0").select("id", F.transform("v", lambda x: -x).alias("v"))
    return S.update_vectors(v, new).select("id", "label", F.round(F.get("v", F.lit(0)), 6).alias("head"))


def numbered_docs(spark, d):
    return R.numbered(table(spark, d, "documents").select("doc_id", "n_chars"))


def _objects(spark, d):
    n = F.col("event_id")
    value = F.when(n % 5 == 0, '{"k": "x"}').when(n % 7 == 0, '{"k": 1, "z": 2}').when(n % 11 == 0, '{"k": null}').when(n % 13 == 0, "{").otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", value.alias("value"))


def validated_rows(spark, d):
    return R.typed(_objects(spark, d), {"k": "BIGINT"}, ("k",))[0].select("event_id")


def validated_rejects(spark, d):
    return R.typed(_objects(spark, d), {"k": "BIGINT"})[1].select("event_id")


def _redeemed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    asked = table(spark, d, "events").select((F.col("event_id") % 2000).alias("o_orderkey"), F.col("user_id").alias("o_custkey"))
    own = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey")
    return R.owned_update(o, asked.unionByName(own), "o_orderkey", "o_custkey", {"o_orderstatus": F.lit("X")})


def redeemed_rewards(spark, d):
    return _redeemed(spark, d)[0]


def refused_rewards(spark, d):
    return _redeemed(spark, d)[1]


def first_answer(spark, d):
    """The first turn of the assistant in each conversation."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return R.first_match(c, F.col("role") == "assistant", ["conv_id"], ["turn"])


def admin_or_self(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.where((F.col("event_type") == "signup") | (F.col("user_id") == 7)).select("event_id")


def metadata_edit(spark, d):
    m = F.from_json("props", "map<string,int>")
    e = table(spark, d, "events").select("event_id", X.put(m, "seen", F.lit(1)).alias("put"), X.removed(X.put(m, "seen", F.lit(1)), "k").alias("gone"))
    return e.select("event_id", F.to_json("put").alias("put"), F.to_json("gone").alias("gone"))


def zipped_records(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return c.select("conv_id", F.map_values(X.records(F.col("roles"), F.col("turns"))).alias("m")).select("conv_id", F.array_sort("m").alias("last_turns"))


def spoken_history(spark, d):
    n = H.spoken(_nodes(spark, d))
    both = H.texts(n).withColumnRenamed("texts", "all").join(H.history(n), "conv", "left")
    return both.select("conv", F.size("all").alias("n"), F.md5(F.array_join("all", "|")).alias("all"), F.md5(F.array_join("texts", "|")).alias("replies"))


def history_edges_cut(spark, d):
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), "turn")
    return H.without_last(H.without_first(m, 1), 2)


def predefined_chain(spark, d):
    c = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("conv"), F.col("text").alias("prompt"))
    return H.predefined(c, "You are helpful.", "Begin:\n", "Then go on", "Create a...").select("conv", "pos", "role", F.md5("text").alias("digest"))


def technique_choice(spark, d):
    """Of the roles of a conversation, in order, the first that was not used last."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("pos"), F.col("role").alias("option"))
    return H.chosen(c, c.groupBy("run").agg(F.max_by("option", "pos").alias("option")))


def enhanced_hits(spark, d):
    v = _vectors(spark, d)
    return S.enhanced(_queries(v), v, least=0.2)[0]


def enhanced_keywords(spark, d):
    v = _vectors(spark, d)
    return S.enhanced(_queries(v), v, k=3)[1]


def term_groups(spark, d):
    p = table(spark, d, "part").select((F.col("p_size") % 7).alias("cluster"), F.col("p_name").alias("term"))
    return P.grouped_terms(p, 8).select("cluster", "size", "pos", F.md5(F.array_join("terms", "|")).alias("digest"))


def keyword_clusters(spark, d):
    """Clusters of part names, seeded."""
    terms = table(spark, d, "part").select(F.col("p_name").alias("term"))
    return S.keyword_clusters(terms, S.bag_of_words, 3).select("cluster", "size", "pos", "terms")


def _shape(text):
    return F.array(F.length(text).cast("double"), F.regexp_count(text, F.lit("e")).cast("double"), F.lit(1.0))


def prompt_response_similarity(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    pairs = c.select("conv_id", "turn", F.col("text").alias("prompt")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")), ["conv_id", "turn"])
    return S.encoded_pairs(pairs, lambda t: t.withColumn("v", _shape(F.col("key")))).select("conv_id", "turn", "similarity")


def encoded_columns(spark, d):
    p = S.encoded_columns(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], _shape)
    return p.select("p_partkey", F.get("p_name embedding", F.lit(0)).alias("name_length"), F.get("p_type embedding", F.lit(1)).alias("type_es"))


def _attached(spark, d):
    """Odd trees, with ids of their own but for every third, go into the tree before them, at places that differ."""
    n = _slim(spark, d)
    conv = F.col("conv")
    odd = n.where("conv % 2 = 1").select("conv", *[(F.col(c) + F.when(conv % 3 == 0, 0).otherwise(1000)).alias(c) for c in ("id", "parent")], "ordinal")
    spots = odd.select(conv.alias("other_conv")).distinct().select(
        "other_conv",
        (F.col("other_conv") - 1).alias("conv"),
        F.when(F.col("other_conv") % 5 == 0, 77).otherwise(F.when(F.col("other_conv") % 4 == 1, 1).otherwise(0)).cast("long").alias("parent"),
        F.when(F.col("other_conv") % 4 == 1, "after").when(F.col("other_conv") % 7 == 0, "before").otherwise("child").alias("place"),
        F.when(F.col("other_conv") % 8 == 3, 0).when(F.col("other_conv") % 11 == 0, 9).cast("long").alias("offset"),
    )
    return T.attach(n.where("conv % 2 = 0"), odd, spots)


def tree_attach(spark, d):
    return _attached(spark, d)[0]


def tree_attach_refused(spark, d):
    return _attached(spark, d)[1]


def _bulk(spark, d):
    n = _slim(spark, d)
    m = spark.createDataFrame([(0, 900, 0, 0), (1, 901, 0, 0), (2, 902, 5, 0), (3, 1, 0, 0), (4, 904, None, 0)], "pos long, id long, parent long, ordinal long")
    return T.add_to_all(n, n.where("conv % 2 = 0").select("conv"), m)


def tree_bulk_add(spark, d):
    return _bulk(spark, d)[0]


def tree_bulk_refused(spark, d):
    return _bulk(spark, d)[1]


def child_lists(spark, d):
    """Turns as children of their conversation: two more at the end, and the second turn gone."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("parent"), F.col("turn").alias("pos"), F.col("turn").alias("child"))
    added = c.select("parent").distinct().select("parent", F.posexplode(F.array(F.lit(1), F.lit(50)).cast("array<long>")).alias("pos", "child"))
    return T.with_children(c, added, c.where("child = 1").select("parent", "child"))


def chain_nodes(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("text"))
    return T.chain_nodes(c).select("conv", "id", F.md5("text").alias("digest"))


def registry_created(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("conv")).distinct()
    known, asked = c.where("conv % 3 = 0"), c.where("conv % 2 = 0")
    made, refused = T.created(known, asked)
    return T.exist(made, c).join(refused.withColumn("refused", F.lit(True)), "conv", "left").select("conv", "exists", F.coalesce("refused", F.lit(False)).alias("refused"))


def tree_merged_pair(spark, d):
    n = _slim(spark, d)
    shifted = n.select("conv", *[(F.col(c) + F.when(F.col("conv") % 2 == 1, 1000).otherwise(0)).alias(c) for c in ("id", "parent")], "ordinal")
    pairs = n.select("conv").distinct().where("conv % 2 = 1").select((F.col("conv") - 1).alias("conv"), F.col("conv").alias("other_conv"))
    return T.merged(shifted, pairs)


def tree_json_round_trip(spark, d):
    """Trees written as JSON, one document a line, and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/trees-{files.unique()}"
    files.append_lines(files.trees_to_json(_nodes(spark, d)), path, "json")
    n = files.tree_nodes(files.json_trees(spark, path, 1, lines=True))
    return n.select(F.col("conv").cast("long").alias("conv"), F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), "role", F.md5("text").alias("digest"))


def collection_entries(spark, d):
    """Parts as files: brand/type/number.txt, those of size over 40 without tickets."""
    p = table(spark, d, "part")
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(".txt"))
    folder = F.concat_ws("/", "p_brand", "p_type")
    f = p.select(F.concat_ws("/", folder, name).alias("path"), F.encode("p_name", "UTF-8").alias("content"))
    t = p.where("p_size <= 40").select(folder.alias("folder"), name.alias("name"), F.col("p_size").cast("long").alias("tickets"))
    dots = p.select(F.col("p_brand").alias("folder"), F.lit(".").alias("name"), F.lit(7).cast("long").alias("tickets")).distinct().where("folder LIKE '%2'")
    return M.artefacts(M.collections(f, t.unionByName(dots))[0])


def merkle_levels(spark, d):
    return M.levels(_leaves(spark, d)).groupBy("tree", "level").agg(F.count("*").alias("nodes"))


def card_links(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return s.select("s_suppkey", P.scored_lines(F.lit("https://cards.example/realm/"), F.col("s_nationkey"), F.col("s_suppkey")).alias("link"), F.format_string("%s-%s", F.col("s_nationkey"), F.col("s_suppkey")).alias("design"))


def technique_descriptor(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return c.select("conv_id", X.descriptor(F.col("roles")).alias("descriptor"))


def story_special(spark, d):
    c = table(spark, d, "conversations")
    title = F.concat(F.lit("**Part "), F.col("turn").cast("string"), F.lit(": tale: "), F.col("role"), F.lit("\n\n\n"))
    s = F.when(F.col("turn") % 3 == 0, title).when(F.col("turn") % 3 == 1, F.concat("role", F.lit("\n\n\n"))).otherwise(F.col("role"))
    return H.story(c.select(F.col("conv_id").alias("run"), F.col("turn").alias("n"), s.alias("segment"))).select("run", F.md5("story").alias("digest"))


def discounted_tokens(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", X.token_count(F.col("text")).alias("n"))
    return c.select("conv_id", "turn", X.discounted_tokens(F.col("n"), F.lit(0.25), 0.5).alias("tokens"))


def retry_backoff(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.backoff(F.col("turn"), 3.0, 60.0).alias("wait"))


def event_seconds(spark, d):
    e = X.stamped(table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t")), F.col("t"), "iso")
    return e.select("event_id", F.round(X.seconds(F.col("t")), 3).alias("seconds"), F.substring("iso", 1, 19).alias("iso"))


def influence_norms(spark, d):
    v = _vectors(spark, d)
    return v.select("id", F.round(P.influence_norm(F.col("v"), F.col("id"), F.lit(100)), 6).alias("norm"))


def _sessions(spark, d):
    """Ten vectors in the order of their ids are a session."""
    v = _vectors(spark, d)
    return v.select(F.floor(F.col("id") / 10).alias("doc"), (F.col("id") % 10).alias("i"), "v")


def feature_pairs(spark, d):
    s = _sessions(spark, d).withColumn("p", F.slice("v", 1, 2))
    f = P.feature_frame(s)
    return f.select("doc", "i", "j", F.size("space").alias("n"), F.round(V.norm(F.col("space")), 5).alias("length"), F.round("distance", 5).alias("distance"))


def path_next(spark, d):
    """From segment 3 of every session, after 4 and 5; every second session had negative feedback."""
    s = _sessions(spark, d)
    state = s.where("i = 3").select("doc", "i", "v", (F.col("doc") % 2 == 0).alias("negative"))
    return P.next_step(state, s, s.where("i IN (4, 5)").select("doc", "i"))


def path_ended(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("path"), F.max("turn").alias("t"))
    return c.select("conv_id", P.ended(F.col("path"), F.lit(3), F.col("t"), F.lit(6)).alias("ended"))


def flat_struct(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.struct("role", F.length("text").alias("length")).alias("author")).alias("message"))
    return files.flat_columns(c)


def scene_elements(spark, d):
    """Lines whose part and supplier stand together on a returned line (the bridge), with their owner and scores as columns."""
    lines = _lines(spark, d)
    pairs = R.accepted(lines.where("l_returnflag = 'A'"), (lines.where("l_returnflag = 'R'"), {"l_partkey": "l_partkey", "l_suppkey": "l_suppkey"}))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"))
    same = (F.col("l_partkey") % 4 == F.col("l_suppkey") % 4).alias("compatible")
    from braidwork.operators.recommend import connection

    rows = pairs.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "owner", same, (F.col("l_partkey") % 50).alias("score"))
    return rows.withColumn("connection", connection(F.col("compatible"), F.col("score")))


QUERIES = {f.__name__: f for f in (
    fk_two_parents, fk_two_parents_rejected, bridge_pair, vector_update, numbered_docs, validated_rows, validated_rejects, redeemed_rewards, refused_rewards, first_answer,
    admin_or_self, metadata_edit, zipped_records, spoken_history, history_edges_cut, predefined_chain, technique_choice, enhanced_hits, enhanced_keywords, term_groups,
    keyword_clusters, prompt_response_similarity, encoded_columns, tree_attach, tree_attach_refused, tree_bulk_add, tree_bulk_refused, child_lists, chain_nodes, registry_created,
    tree_merged_pair, tree_json_round_trip, collection_entries, merkle_levels, card_links, technique_descriptor, story_special, discounted_tokens, retry_backoff, event_seconds,
    influence_norms, feature_pairs, path_next, path_ended, flat_struct, scene_elements,
)}

_PAIR = "SELECT l_orderkey, l_linenumber FROM lineitem"
_GOOD = "l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"
_BRIDGE = "l_returnflag = 'A' AND EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = lineitem.l_partkey AND r.l_suppkey = lineitem.l_suppkey)"
_ASKED = "a AS (SELECT event_id % 2000 AS k, user_id AS u FROM events UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0)"
_N = "n AS (SELECT conv_id AS conv, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, turn AS ordinal, role, text FROM conversations)"
_RANK = "(row_number() OVER (PARTITION BY conv, parent ORDER BY ordinal, id) - 1)"
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_HIT = f"{_V}, h AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.v, v.v), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, v.v), 6) DESC, v.id) AS rank FROM v q JOIN v ON q.id <> v.id WHERE q.id % 20 = 0 QUALIFY rank <= 10)"
_SESS = "s AS (SELECT vec_id // 10 AS doc, vec_id % 10 AS i, embedding::DOUBLE[] AS v FROM embeddings)"
_ATT = f"""{_N}, odd AS (SELECT conv, id + k AS id, parent + k AS parent, ordinal FROM (SELECT *, CASE WHEN conv % 3 = 0 THEN 0 ELSE 1000 END AS k FROM n) WHERE conv % 2 = 1),
sp AS (SELECT DISTINCT conv AS oc, conv - 1 AS conv, CASE WHEN conv % 5 = 0 THEN 77 WHEN conv % 4 = 1 THEN 1 ELSE 0 END AS parent, CASE WHEN conv % 4 = 1 THEN 'after' WHEN conv % 7 = 0 THEN 'before' ELSE 'child' END AS place, CASE WHEN conv % 8 = 3 THEN 0 WHEN conv % 11 = 0 THEN 9 END AS off FROM odd),
r AS (SELECT sp.*, p.parent AS above, (p.id + 1) % 2 AS place_at, CASE WHEN p.id IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.conv = sp.conv) THEN 'no such parent' END WHEN place <> 'child' AND p.parent IS NULL THEN 'the parent is a root'
  WHEN off < 0 OR off > (SELECT count(*) FROM n c WHERE c.conv = sp.conv AND c.parent = sp.parent) THEN 'bad offset' WHEN EXISTS (SELECT 1 FROM odd JOIN n ON n.id = odd.id WHERE odd.conv = sp.oc AND n.conv = sp.conv) THEN 'an id exists' END AS reason
  FROM sp LEFT JOIN n p ON p.conv = sp.conv AND p.id = sp.parent)"""
_BULK = f"""{_N}, m AS (SELECT * FROM (VALUES (0, 900, 0), (1, 901, 0), (2, 902, 5), (3, 1, 0), (4, 904, NULL)) t(pos, id, parent)),
j AS (SELECT c.conv, m.*, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.conv = c.conv AND n.id = m.id) THEN 'the id exists' WHEN m.parent IS NULL THEN 'the tree has a root' WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.conv = c.conv AND n.id = m.parent) THEN 'no such parent' END AS reason
  FROM (SELECT DISTINCT conv FROM n WHERE conv % 2 = 0) c CROSS JOIN m)"""
_OBJ = """o AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{"k": "x"}' WHEN event_id % 7 = 0 THEN '{"k": 1, "z": 2}' WHEN event_id % 11 = 0 THEN '{"k": null}' WHEN event_id % 13 = 0 THEN '{' ELSE props END AS value FROM events)"""

SQL = {
    "fk_two_parents": f"{_PAIR} WHERE {_GOOD}",
    "fk_two_parents_rejected": f"{_PAIR} WHERE NOT ({_GOOD})",
    "bridge_pair": f"{_PAIR} WHERE {_BRIDGE}",
    "vector_update": "SELECT vec_id AS id, label, round(CASE WHEN vec_id % 7 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS head FROM embeddings",
    "numbered_docs": "SELECT doc_id AS id, n_chars FROM documents",
    "validated_rows": f"WITH {_OBJ} SELECT event_id FROM o WHERE json_valid(value) AND json_keys(TRY_CAST(value AS JSON)) = ['k'] AND json_type(TRY_CAST(value AS JSON), '$.k') IN ('UBIGINT', 'BIGINT')",
    "validated_rejects": f"WITH {_OBJ} SELECT event_id FROM o WHERE NOT coalesce(json_valid(value) AND json_keys(TRY_CAST(value AS JSON)) = ['k'] AND json_type(TRY_CAST(value AS JSON), '$.k') IN ('UBIGINT', 'BIGINT', 'NULL'), false)",
    "redeemed_rewards": f"WITH {_ASKED} SELECT o_orderkey, o_custkey, CASE WHEN EXISTS (SELECT 1 FROM a WHERE k = o_orderkey AND u = o_custkey) THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "refused_rewards": f"WITH {_ASKED} SELECT k AS o_orderkey, u AS o_custkey, CASE WHEN o_orderkey IS NULL THEN 'not found' ELSE 'not the owner' END AS reason FROM a LEFT JOIN orders ON o_orderkey = k WHERE o_orderkey IS NULL OR o_custkey <> u",
    "first_answer": "SELECT conv_id, min(turn) AS turn, 'assistant' AS role FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "admin_or_self": "SELECT event_id FROM events WHERE event_type = 'signup' OR user_id = 7",
    "metadata_edit": """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"seen":1}' AS put, '{"seen":1}' AS gone FROM events""",
    "zipped_records": "SELECT conv_id, list(t ORDER BY t) AS last_turns FROM (SELECT conv_id, role, max(turn) AS t FROM conversations GROUP BY conv_id, role) GROUP BY conv_id",
    "spoken_history": f"""WITH {_N} SELECT conv, CAST(count(*) FILTER (WHERE length(text) > 0) AS INT) AS n, md5(string_agg(text, '|' ORDER BY ordinal) FILTER (WHERE length(text) > 0)) AS "all", md5(string_agg(text, '|' ORDER BY ordinal) FILTER (WHERE parent IS NOT NULL)) AS replies FROM n WHERE role <> 'system' GROUP BY conv""",
    "history_edges_cut": "SELECT conv_id AS conv, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 2",
    "predefined_chain": """SELECT conv_id AS conv, CAST(pos AS INT) AS pos, ['system', 'user', 'user', 'assistant'][pos + 1] AS role, md5(['You are helpful.', 'Begin:' || chr(10), text || chr(10) || 'Then go on', 'Create a...'][pos + 1]) AS digest
FROM conversations CROSS JOIN range(4) t(pos) WHERE turn = 0""",
    "technique_choice": """WITH l AS (SELECT conv_id, arg_max(role, turn) AS used FROM conversations GROUP BY conv_id)
SELECT conv_id AS run, arg_min(role, turn) AS option FROM conversations JOIN l USING (conv_id) WHERE role <> used GROUP BY conv_id""",
    "enhanced_hits": f"WITH {_HIT} SELECT * FROM h WHERE score >= 0.2",
    "enhanced_keywords": f"WITH {_HIT} SELECT a.query_id, a.id, b.id AS other, round(list_cosine_similarity(x.v, y.v), 6) AS score, row_number() OVER (PARTITION BY a.query_id, a.id ORDER BY round(list_cosine_similarity(x.v, y.v), 6) DESC, b.id) AS rank FROM h a JOIN h b ON a.query_id = b.query_id JOIN v x ON x.id = a.id JOIN v y ON y.id = b.id QUALIFY row_number() OVER (PARTITION BY a.query_id, a.id ORDER BY round(list_cosine_similarity(x.v, y.v), 6) DESC, b.id) <= 3",
    "term_groups": """WITH g AS (SELECT c::INT AS cluster, coalesce(list_sort(list(DISTINCT p_name) FILTER (WHERE p_name IS NOT NULL)), []) AS terms FROM range(8) t(c) LEFT JOIN part ON p_size % 7 = c GROUP BY c)
SELECT cluster, CAST(len(terms) AS INT) AS size, row_number() OVER (ORDER BY len(terms) DESC, cluster) AS pos, md5(array_to_string(terms, '|')) AS digest FROM g""",
    "prompt_response_similarity": """WITH s AS (SELECT conv_id, turn, [length(text)::DOUBLE, (length(text) - length(replace(text, 'e', '')))::DOUBLE, 1.0::DOUBLE] AS v FROM conversations)
SELECT a.conv_id, a.turn, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM s a JOIN s b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    "encoded_columns": "SELECT p_partkey, length(p_name)::DOUBLE AS name_length, (length(p_type) - length(replace(p_type, 'e', '')))::DOUBLE AS type_es FROM part",
    "tree_attach": f"""WITH {_ATT}, x AS (SELECT conv, id, parent, 2 * {_RANK} AS ordinal FROM n WHERE conv % 2 = 0
 UNION ALL SELECT r.conv, o.id, CASE WHEN o.parent IS NOT NULL THEN o.parent WHEN place = 'child' THEN r.parent ELSE above END, CASE WHEN o.parent IS NOT NULL THEN o.ordinal WHEN place = 'child' THEN coalesce(off * 2 - 1, 2147483648) ELSE place_at * 2 + CASE WHEN place = 'after' THEN 1 ELSE -1 END + 2 * coalesce(off, 0) END FROM r JOIN odd o ON o.conv = r.oc WHERE reason IS NULL)
SELECT conv, id, parent, {_RANK} AS ordinal FROM x""",
    "tree_attach_refused": f"WITH {_ATT} SELECT oc AS other_conv, conv, reason FROM r WHERE reason IS NOT NULL",
    "tree_bulk_add": f"WITH {_BULK}, x AS (SELECT conv, id, parent, {_RANK} AS ordinal FROM n UNION ALL SELECT conv, id, parent, -1 - pos FROM j WHERE reason IS NULL) SELECT conv, id, parent, {_RANK} AS ordinal FROM x",
    "tree_bulk_refused": f"WITH {_BULK} SELECT conv, pos, id, reason FROM j WHERE reason IS NOT NULL",
    "child_lists": """WITH r AS (SELECT conv_id AS parent, turn AS pos, turn AS child FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 1 FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, max(turn) + 2, 50 FROM conversations GROUP BY conv_id)
SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY pos) - 1 AS pos, child FROM r WHERE NOT (child = 1 AND pos = 1 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = parent AND turn = 1))""",
    "chain_nodes": "SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, md5(text) AS digest FROM conversations WHERE role = 'user' AND length(text) > 0",
    "registry_created": "SELECT DISTINCT conv_id AS conv, conv_id % 3 = 0 OR conv_id % 2 = 0 AS exists, conv_id % 6 = 0 AS refused FROM conversations",
    "tree_merged_pair": f"""WITH {_N}, x AS (SELECT conv, id, parent, ordinal FROM n WHERE conv % 2 = 0 UNION ALL SELECT conv - 1, id + 1000, coalesce(parent + 1000, (SELECT min(id) FROM n r WHERE r.conv = n.conv - 1 AND r.parent IS NULL)), CASE WHEN parent IS NULL THEN 2147483648 ELSE ordinal END FROM n WHERE conv % 2 = 1)
SELECT conv, id, parent, {_RANK} AS ordinal FROM x""",
    "tree_json_round_trip": f"WITH {_N} SELECT conv, id, parent, role, md5(text) AS digest FROM n",
    "merkle_levels": """WITH RECURSIVE l AS (SELECT p_brand AS tree, 0 AS level, count(*) AS nodes FROM part GROUP BY p_brand UNION ALL SELECT tree, level + 1, (nodes + 1) // 2 FROM l WHERE nodes > 1)
SELECT tree, CAST(level AS INT) AS level, nodes FROM l""",
    "card_links": "SELECT s_suppkey, 'https://cards.example/realm/' || s_nationkey || '/' || s_suppkey AS link, s_nationkey || '-' || s_suppkey AS design FROM supplier",
    "technique_descriptor": "SELECT conv_id, string_agg(role, chr(10) || ' ' ORDER BY turn) AS descriptor FROM conversations GROUP BY conv_id",
    "story_special": "SELECT conv_id AS run, md5(string_agg(role || CASE WHEN turn % 3 < 2 THEN chr(10) || chr(10) ELSE chr(10) END, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "discounted_tokens": rf"SELECT conv_id, turn, CAST(trunc(len(regexp_extract_all(text, '{X.TOKEN}')) * 0.875::DOUBLE) AS INT) AS tokens FROM conversations",
    "retry_backoff": "SELECT conv_id, turn, least(3 * pow(2, turn), 60)::DOUBLE AS wait FROM conversations",
    "event_seconds": "SELECT event_id, round(epoch_us(ts) / 1000000.0::DOUBLE, 3) AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events",
    "influence_norms": f"WITH {_V} SELECT id, round(sqrt(list_sum([x * x FOR x IN v])) * (1 + 0.1::DOUBLE * id / 100), 6) AS norm FROM v",
    "feature_pairs": f"""WITH {_SESS} SELECT a.doc, a.i, b.i AS j, 6 AS n, round(sqrt(a.i * a.i + b.i * b.i + a.v[1] * a.v[1] + a.v[2] * a.v[2] + b.v[1] * b.v[1] + b.v[2] * b.v[2]), 5) AS length, round(list_distance(a.v, b.v), 5) AS distance FROM s a JOIN s b USING (doc)""",
    "path_next": f"""WITH {_SESS}, c AS (SELECT a.doc, b.i, row_number() OVER (PARTITION BY a.doc ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.i) AS r FROM s a JOIN s b USING (doc) WHERE a.i = 3 AND b.i NOT IN (3, 4, 5))
SELECT s.doc, CASE WHEN s.doc % 2 = 0 THEN c.i ELSE 4 % (SELECT count(*) FROM s n WHERE n.doc = s.doc) END AS next FROM s JOIN c ON c.doc = s.doc AND c.r = 1 WHERE s.i = 3""",
    "path_ended": "SELECT conv_id, count(DISTINCT role) = 3 OR max(turn) >= 0.9 * 6 OR count(*) > 4.5 AS ended FROM conversations GROUP BY conv_id",
    "flat_struct": "SELECT conv_id, turn AS message_turn, role AS message_author_role, CAST(length(text) AS INT) AS message_author_length FROM conversations",
    "scene_elements": f"""SELECT l_orderkey, l_linenumber, o_custkey AS owner, l_partkey % 4 = l_suppkey % 4 AS compatible, l_partkey % 50 AS score, CAST(trunc(CASE WHEN l_partkey % 4 = l_suppkey % 4 THEN 50 ELSE 0 END + 0.5::DOUBLE * (l_partkey % 50)) AS BIGINT) AS connection
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {_BRIDGE}""",
}
