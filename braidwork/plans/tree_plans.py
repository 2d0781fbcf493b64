"""Queries over trees: the turns of a conversation hang under turn (n - 1) / 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import history as H
from braidwork.operators import merkle as M
from braidwork.operators import trees as T
from braidwork.operators import tries
from braidwork.sources.tables import table


def _nodes(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("conv"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).cast("long").alias("parent"), F.col("turn").alias("ordinal"), "role", "text")


def _slim(spark, d):
    return _nodes(spark, d).select("conv", "id", "parent", "ordinal")


def tree_depth(spark, d):
    return T.placed(_slim(spark, d)).select("conv", "id", "root", "depth")


def tree_preorder(spark, d):
    p = T.placed(_slim(spark, d))
    return p.select("conv", "id", "depth", (F.col("enter") + 1).alias("pos"))


def tree_height(spark, d):
    return T.heights(_slim(spark, d))


def last_message(spark, d):
    return T.last_message(_slim(spark, d))


def ancestors(spark, d):
    return T.ancestors(_slim(spark, d))


def tree_children(spark, d):
    return T.children(_slim(spark, d))


def tree_coordinates(spark, d):
    return T.coordinates(_slim(spark, d))


def tree_delete(spark, d):
    n = _slim(spark, d)
    return T.delete(n, n.where("id = 1").select("conv", "id"))


def tree_delete_cascade(spark, d):
    n = _slim(spark, d)
    return T.delete(n, n.where("id = 1").select("conv", "id"), cascade=True)


def tree_move(spark, d):
    """Node 2 goes under node 3, as its first child; where there is no node 3 nothing moves."""
    n = _slim(spark, d)
    pairs = n.where("id = 2").select("conv", "id").join(n.where("id = 3").select("conv", F.col("id").alias("new_parent")), "conv")
    return T.move(n, pairs.select("conv", "id", "new_parent", F.lit(0).cast("long").alias("index")))


def tree_cycles(spark, d):
    """Every move of node 0 or 1 under another node, if it makes a cycle."""
    n = _slim(spark, d).select("conv", "id")
    return T.makes_cycle(_slim(spark, d), n.where("id < 2").join(n.withColumnRenamed("id", "new_parent"), "conv"))


def tree_split(spark, d):
    n = _slim(spark, d)
    return T.split(n, n.where("id = 1").select("conv", "id", (F.col("conv") + 1000000).alias("new_conv")))


def tree_merge(spark, d):
    """Trees with odd numbers go into the tree before them; ids are made distinct first."""
    n = _slim(spark, d)
    even = n.where("conv % 2 = 0")
    odd = n.where("conv % 2 = 1").select("conv", (F.col("id") + 1000).alias("id"), (F.col("parent") + 1000).alias("parent"), "ordinal")
    pairs = odd.select(F.col("conv").alias("other_conv"), (F.col("conv") - 1).alias("conv")).distinct()
    return T.merge(even, odd, pairs)


def tree_insert(spark, d):
    """A new node 999 before node 1 of each tree."""
    n = _slim(spark, d)
    fresh = n.where("id = 1").select("conv", F.lit(999).cast("long").alias("id"), F.col("id").alias("parent"), F.lit(0).cast("long").alias("ordinal"))
    return T.add(n, fresh, "before")


def tree_rewind(spark, d):
    return T.rewind(_slim(spark, d), 2)


def tree_indented(spark, d):
    n = _nodes(spark, d).select("conv", "id", "parent", "ordinal", F.col("role").alias("text"))
    return T.indented(n).select("conv", "line")


def inactive_conversations(spark, d):
    import datetime

    e = table(spark, d, "events").groupBy(F.col("user_id").alias("conv")).agg(F.max("ts").cast("timestamp").alias("last"))
    return T.inactive(e, datetime.datetime(2024, 2, 1), 24.0).select("conv")


def prefix_trie_fanout(spark, d):
    return tries.prefixes(table(spark, d, "customer").select(F.col("c_name").alias("id"), F.col("c_custkey").alias("seq")))


def prefix_trie_nodes(spark, d):
    """The compressed tree: prefixes at which names part or end."""
    return tries.trie(table(spark, d, "customer").select(F.col("c_name").alias("id"), F.col("c_custkey").alias("seq"))).select("prefix", "length", "root", "members")


def partial_sequence(spark, d):
    return T.walk_keys(_nodes(spark, d), ["user", "assistant", "user"], "role")


def _messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text", F.size(F.split("text", " ")).cast("long").alias("tokens"))


def history_truncate_greedy(spark, d):
    return H.greedy(_messages(spark, d), 120)


def history_truncate_prefix(spark, d):
    return H.prefix(_messages(spark, d), 120).select("conv", "turn", "used")


def history_last_n(spark, d):
    return H.last_n(_messages(spark, d), 2, with_newest=False).select("conv", "turn")


def chat_buffer_string(spark, d):
    return H.buffer(_messages(spark, d)).select("conv", F.md5("buffer").alias("digest"))


def reply_chain_order(spark, d):
    c = table(spark, d, "conversations")
    u, a = c.where("role = 'user'"), c.where("role = 'assistant'")
    pairs = u.select(F.col("conv_id").alias("conv"), F.col("turn").alias("n"), F.col("text").alias("prompt")).join(a.select(F.col("conv_id").alias("conv"), (F.col("turn") - 1).alias("n"), F.col("text").alias("response")), ["conv", "n"])
    return H.reply_chain(pairs, "You are helpful.").select("conv", "pos", "role", F.md5("text").alias("digest"))


def stream_segments(spark, d):
    """Words of conversations as tokens, with what follows each, cut at full stops."""
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("run"), F.posexplode(F.regexp_extract_all("text", F.lit("[^ .]*[ .]?"), F.lit(0))).alias("seq", "token"))
    return H.segments(c, ".").select("run", "n", F.md5("segment").alias("digest"))


def _leaves(spark, d):
    p = table(spark, d, "part")
    own = M.short_hash(F.concat_ws("|", "p_partkey", "p_name").cast("binary"))
    return p.select(F.col("p_brand").alias("tree"), (F.row_number().over(T.W.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("pos"), M.short_hash(M.descriptor(own, F.length("p_name"), F.col("p_size"))).alias("hash"))


def merkle_root(spark, d):
    return M.roots(M.levels(_leaves(spark, d))).select("tree", F.lower(F.hex("root")).alias("root"))


def merkle_verify(spark, d):
    """Every leaf with its proof, verified."""
    nodes = M.levels(_leaves(spark, d))
    leaves = nodes.where("level = 0").select("tree", "pos", "hash")
    j = M.proofs(nodes, leaves).join(M.roots(nodes), "tree").join(leaves.hint("merge"), ["tree", "pos"])
    return j.select("tree", "pos", F.size("proof").alias("steps"), M.verify(F.col("hash"), F.col("pos"), F.col("proof"), F.col("root")).alias("valid"))


def merkle_updated(spark, d):
    """Every seventh part changes: how many nodes are written of how many, and whether the root is that of a rebuilt tree."""
    old = _leaves(spark, d)
    new = old.withColumn("hash", F.when(F.col("pos") % 7 == 0, M.short_hash(F.col("hash"))).otherwise(F.col("hash")))
    stored = M.levels(old)
    fresh = M.updated(stored, new.where("pos % 7 = 0"))
    counts = fresh.groupBy("tree").agg(F.count("*").alias("written"))
    sizes = stored.groupBy("tree").agg(F.count("*").alias("stored"))
    rebuilt = M.roots(M.levels(new)).withColumnRenamed("root", "rebuilt")
    both = M.roots(M.patched(stored, fresh)).join(rebuilt, "tree").join(counts, "tree").join(sizes, "tree")
    return both.select("tree", "written", "stored", (F.col("root") == F.col("rebuilt")).alias("same"))


QUERIES = {f.__name__: f for f in (
    tree_depth, tree_preorder, tree_height, last_message, ancestors, tree_children, tree_coordinates, tree_delete, tree_delete_cascade, tree_move, tree_cycles, tree_split,
    tree_merge, tree_insert, tree_rewind, tree_indented, inactive_conversations, prefix_trie_fanout, prefix_trie_nodes, partial_sequence, history_truncate_greedy, history_truncate_prefix,
    history_last_n, chat_buffer_string, reply_chain_order, stream_segments, merkle_root, merkle_verify, merkle_updated,
)}

_N = "n AS (SELECT conv_id AS conv, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, turn AS ordinal, role, text FROM conversations)"
_UP = "ok AS (SELECT n.conv, n.id, p.id AS up, n.ordinal FROM n LEFT JOIN n p ON p.conv = n.conv AND p.id = n.parent)"
_WALK = f"RECURSIVE {_N}, {_UP}, w AS (SELECT conv, id, id AS root, 0::BIGINT AS depth, lpad(ordinal::VARCHAR, 10, '0') AS path FROM ok WHERE up IS NULL UNION ALL SELECT ok.conv, ok.id, w.root, w.depth + 1, w.path || ';' || lpad(ok.ordinal::VARCHAR, 10, '0') FROM ok JOIN w ON ok.conv = w.conv AND ok.up = w.id)"
_CLOSE = f"RECURSIVE {_N}, {_UP}, c AS (SELECT conv, id, up AS ancestor, 1::BIGINT AS distance FROM ok WHERE up IS NOT NULL UNION ALL SELECT c.conv, c.id, ok.up, c.distance + 1 FROM c JOIN ok ON ok.conv = c.conv AND ok.id = c.ancestor WHERE ok.up IS NOT NULL)"
_RANK = "(row_number() OVER (PARTITION BY conv, parent ORDER BY ordinal, id) - 1)"
_M = "m AS (SELECT conv_id AS conv, turn, role, text, len(string_split(text, ' ')) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)"
SQL = {
    "merkle_updated": """WITH p AS (SELECT p_brand AS tree, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part), n AS (SELECT tree, max(pos) + 1 AS n FROM p GROUP BY tree),
t AS (SELECT tree, CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END AS top FROM n), l AS (SELECT tree, unnest(range(0, top + 1)) AS level FROM t),
x AS (SELECT p.tree, l.level, p.pos >> l.level AS pos, bool_or(p.pos % 7 = 0) AS dirty FROM p JOIN l USING (tree) GROUP BY ALL)
SELECT tree, count(*) FILTER (dirty) AS written, count(*) AS stored, true AS same FROM x GROUP BY tree""",
    "tree_depth": f"WITH {_WALK} SELECT conv, id, root, depth FROM w",
    "tree_preorder": f"WITH {_WALK} SELECT conv, id, depth, row_number() OVER (PARTITION BY conv ORDER BY path) AS pos FROM w",
    "tree_height": f"WITH {_WALK} SELECT conv, max(depth) + 1 AS height FROM w GROUP BY conv",
    "last_message": f"WITH {_WALK} SELECT conv, arg_max(id, path) AS id FROM w GROUP BY conv",
    "ancestors": f"WITH {_CLOSE} SELECT conv, id, ancestor, distance FROM c",
    "tree_children": f"WITH {_N} SELECT conv, parent, list(id ORDER BY ordinal, id) AS children FROM n WHERE parent IS NOT NULL GROUP BY conv, parent",
    "tree_coordinates": f"WITH {_WALK} SELECT n.conv, n.id, w.depth AS x, row_number() OVER (PARTITION BY n.conv, n.parent ORDER BY n.ordinal, n.id) - 1 AS y, count(*) OVER (PARTITION BY n.conv, n.parent) AS z FROM n JOIN w USING (conv, id)",
    "tree_delete": f"WITH {_N} SELECT conv, id, parent, ordinal FROM n WHERE NOT (id = 1 AND parent IS NOT NULL)",
    "tree_delete_cascade": f"WITH {_CLOSE} SELECT conv, id, parent, ordinal FROM n WHERE id <> 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.conv = n.conv AND c.id = n.id AND c.ancestor = 1)",
    "tree_move": f"""WITH {_N}, m AS (SELECT conv, id, CASE WHEN mv THEN 3 ELSE parent END AS parent, CASE WHEN mv THEN -1 ELSE ordinal END AS ordinal
 FROM (SELECT *, id = 2 AND conv IN (SELECT conv FROM n WHERE id = 3) AS mv FROM n)) SELECT conv, id, parent, {_RANK} AS ordinal FROM m""",
    "tree_cycles": f"WITH {_CLOSE} SELECT conv, id, id AS new_parent FROM n WHERE id < 2 UNION ALL SELECT conv, ancestor AS id, id AS new_parent FROM c WHERE ancestor < 2",
    "tree_split": f"""WITH {_CLOSE}, t AS (SELECT conv, id AS top FROM n WHERE (id = 1 OR id = 2) AND conv IN (SELECT conv FROM n WHERE id = 1)),
s AS (SELECT n.*, t.top FROM n JOIN t ON t.conv = n.conv AND n.id = t.top UNION ALL SELECT n.*, t.top FROM n JOIN c ON c.conv = n.conv AND c.id = n.id JOIN t ON t.conv = n.conv AND t.top = c.ancestor),
m AS (SELECT conv + 1000000 AS conv, id, CASE WHEN id = 1 THEN NULL WHEN id = top THEN 1 ELSE parent END AS parent, id = top AND id <> 1 AS late FROM s),
o AS (SELECT conv, id, parent, CASE WHEN late THEN id + 2147483648 ELSE id END AS ordinal FROM m) SELECT conv, id, parent, {_RANK} AS ordinal FROM o""",
    "tree_merge": f"""WITH {_N}, a AS (SELECT conv, id, parent, ordinal FROM n WHERE conv % 2 = 0), b AS (SELECT conv - 1 AS conv, id + 1000 AS id, parent + 1000 AS parent, ordinal FROM n WHERE conv % 2 = 1),
m AS (SELECT * FROM a UNION ALL SELECT b.conv, b.id, coalesce(b.parent, r.id) AS parent, CASE WHEN b.parent IS NULL THEN 2147483648 ELSE ordinal END AS ordinal FROM b LEFT JOIN (SELECT conv, min(id) AS id FROM a WHERE parent IS NULL GROUP BY conv) r ON r.conv = b.conv)
SELECT conv, id, parent, {_RANK} AS ordinal FROM m""",
    "tree_insert": f"""WITH {_N}, m AS (SELECT conv, id, parent, ordinal * 2 AS ordinal FROM n UNION ALL SELECT conv, 999, parent, 1 FROM n WHERE id = 1) SELECT conv, id, parent, {_RANK} AS ordinal FROM m""",
    "tree_rewind": f"""WITH {_WALK}, k AS (SELECT conv, id, path, row_number() OVER (PARTITION BY conv ORDER BY path DESC) AS r FROM w)
SELECT n.conv, n.id, n.parent, n.ordinal FROM n JOIN k USING (conv, id) WHERE k.r > 2 OR n.parent IS NULL""",
    "tree_indented": f"WITH {_WALK} SELECT w.conv, repeat('  ', w.depth::INT) || w.id || ': ' || n.role AS line FROM w JOIN n USING (conv, id)",
    "inactive_conversations": "SELECT user_id AS conv FROM events GROUP BY user_id HAVING TIMESTAMP '2024-02-01' - max(ts) > INTERVAL 24 HOUR",
    "prefix_trie_fanout": "WITH p AS (SELECT c_name AS id, c_custkey AS seq, substr(c_name, 1, unnest(range(1, length(c_name) + 1))) AS prefix FROM customer) SELECT prefix, arg_min(id, seq) AS root, count(*) AS members FROM p GROUP BY prefix",
    "prefix_trie_nodes": """WITH p AS (SELECT c_name AS id, c_custkey AS seq, unnest(range(1, length(c_name) + 1)) AS n FROM customer),
g AS (SELECT substr(id, 1, n) AS prefix, arg_min(id, seq) AS root, count(*) AS members, count(DISTINCT substr(id, n + 1, 1)) AS ways, bool_or(length(id) = n) AS ended FROM p GROUP BY 1)
SELECT prefix, CAST(length(prefix) AS INT) AS length, root, members FROM g WHERE ways > 1 OR ended""",
    "partial_sequence": f"WITH {_N} SELECT c.conv, c.id FROM n a JOIN n b ON b.conv = a.conv AND b.parent = a.id JOIN n c ON c.conv = b.conv AND c.parent = b.id WHERE a.parent IS NULL AND a.role = 'user' AND b.role = 'assistant' AND c.role = 'user'",
    "history_truncate_greedy": f"""WITH RECURSIVE {_M}, k AS (SELECT conv, turn, CASE WHEN role = 'assistant' THEN 2 ELSE 1 END * tokens AS cost, row_number() OVER (PARTITION BY conv ORDER BY turn DESC) AS r FROM m WHERE length(text) > 0),
g AS (SELECT conv, turn, r, CASE WHEN cost <= 120 THEN cost ELSE 0 END AS used, cost <= 120 AS kept FROM k WHERE r = 1
 UNION ALL SELECT k.conv, k.turn, k.r, CASE WHEN g.used + k.cost <= 120 THEN g.used + k.cost ELSE g.used END, g.used + k.cost <= 120 FROM g JOIN k ON k.conv = g.conv AND k.r = g.r + 1)
SELECT conv, turn FROM g WHERE kept""",
    "history_truncate_prefix": f"WITH {_M} SELECT conv, turn, CAST(sum(tokens) OVER (PARTITION BY conv ORDER BY turn DESC) AS BIGINT) AS used FROM m QUALIFY used <= 120",
    "history_last_n": f"WITH {_M} SELECT conv, turn FROM m WHERE r BETWEEN 2 AND 3",
    "chat_buffer_string": "SELECT conv_id AS conv, md5(string_agg(CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' ELSE 'System' END || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "reply_chain_order": """WITH p AS (SELECT u.conv_id AS conv, u.turn AS n, u.text AS prompt, a.text AS response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
r AS (SELECT DISTINCT conv, -1 AS n, 0 AS k, 'system' AS role, 'You are helpful.' AS text FROM p UNION ALL SELECT conv, n, 0, 'assistant', response FROM p UNION ALL SELECT conv, n, 1, 'user', prompt FROM p)
SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY n, k) - 1 AS pos, role, md5(text) AS digest FROM r""",
    "stream_segments": r"""WITH s AS (SELECT conv_id || '-' || turn AS run, string_split(text, '.') AS p FROM conversations),
x AS (SELECT run, len(p) AS m, unnest(p) AS seg, unnest(range(len(p))) AS n FROM s)
SELECT run, CAST(n AS INT) AS n, md5(regexp_replace(seg, '^\s+|\s+$', '', 'g')) AS digest FROM x WHERE n < m - 1 OR regexp_matches(seg, '\S')""",
}
