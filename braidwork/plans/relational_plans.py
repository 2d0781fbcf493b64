"""Queries over plain tables: filters, semi and anti joins, updates, rankings, batches."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions import colours as C
from braidwork.functions import text as X
from braidwork.operators import relational as R
from braidwork.sources import files
from braidwork.sources.tables import table

NOW = datetime.datetime(2024, 6, 1)


def paginate(spark, d):
    return R.page(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 20, 10)


def point_lookup(spark, d):
    return table(spark, d, "customer").where("c_custkey = 42")


def conjunctive_filter(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_totalprice")


def in_semi(spark, d):
    asia = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return table(spark, d, "customer").join(asia, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_nationkey")


def _prefix(strategy, phrase, **kw):
    def query(spark, d):
        return table(spark, d, "part").where(R.matches(F.col("p_name"), phrase, strategy, **kw)).select("p_partkey", "p_name")

    return query


def filter_corpus(spark, d):
    return table(spark, d, "part").where(R.not_the_query(F.col("p_type"), " PROMO ")).select("p_partkey", "p_type")


def fk_accepted(spark, d):
    return R.accepted(table(spark, d, "orders"), (table(spark, d, "customer"), {"o_custkey": "c_custkey"})).select("o_orderkey", "o_custkey")


def fk_rejected(spark, d):
    return R.rejected(table(spark, d, "customer").select("c_custkey", "c_name"), (table(spark, d, "orders").where("o_totalprice > 200000"), {"c_custkey": "o_custkey"}))


def _halves(spark, d):
    """Two versions of the orders that share those with status F; the second has other prices."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.where("o_orderstatus <> 'O'"), o.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.col("o_totalprice") + 1)


def diff_mode(spark, d):
    return R.difference(*_halves(spark, d), "o_orderkey")


def update_mode(spark, d):
    return R.update_keeping_old(*_halves(spark, d), "o_orderkey")


def upsert_tree(spark, d):
    return R.merge_keeping_new(*_halves(spark, d), "o_orderkey")


def key_intersect(spark, d):
    a, b = _halves(spark, d)
    return a.select("o_orderkey").intersect(b.select("o_orderkey"))


def key_except(spark, d):
    a, b = _halves(spark, d)
    return a.select("o_orderkey").subtract(b.select("o_orderkey"))


def union_all(spark, d):
    a, b = _halves(spark, d)
    return a.unionByName(b)


def _patch(spark, d):
    c = table(spark, d, "customer")
    return c, c.where(F.col("c_acctbal") < 0).select("c_custkey", F.when(F.col("c_nationkey") < 12, F.lit("")).when(F.col("c_nationkey") < 20, F.lit("NEW")).alias("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, F.lit(0.0)).alias("c_acctbal"))


def partial_update_notnull(spark, d):
    return R.patch(*_patch(spark, d), "c_custkey").select("c_custkey", "c_acctbal", "c_mktsegment")


def partial_update_truthy(spark, d):
    return R.patch(*_patch(spark, d), "c_custkey", "truthy").select("c_custkey", "c_acctbal", "c_mktsegment")


def full_overwrite(spark, d):
    return R.patch(*_patch(spark, d), "c_custkey", "overwrite").select("c_custkey", "c_acctbal", "c_mktsegment")


def delete_by_id(spark, d):
    return R.rejected(table(spark, d, "supplier").select("s_suppkey", "s_name"), (table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09"), {"s_suppkey": "l_suppkey"}))


def card_types(spark, d):
    return table(spark, d, "events").select("event_type").distinct()


def first_seen_texts(spark, d):
    return R.first_seen(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", F.md5("text").alias("digest"))


def mode_per_customer(spark, d):
    return R.mode_of(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


def natural_sort(spark, d):
    p = table(spark, d, "part").select("p_brand").distinct()
    return p.select("p_brand", F.row_number().over(R.W.orderBy(R.natural_key(F.col("p_brand")), "p_brand")).alias("pos"))


def seeded_shuffle(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return c.select("conv_id", "turn", F.row_number().over(R.W.partitionBy("conv_id").orderBy(R.seeded_order("conv_id", "turn", seed="7"), "turn")).alias("pos"))


def priority_lanes(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("priority"))
    return e.select("event_id", "user_id", R.lanes(F.col("priority") % 10).alias("lane"), F.row_number().over(R.W.partitionBy("user_id").orderBy(R.lanes(F.col("priority") % 10), "event_id")).alias("pos"))


def latest_event(spark, d):
    return R.top(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 1)


def file_batches(spark, d):
    return R.batches(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], 10, ["o_custkey"])


def callback_chain(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    steps = [(2, "filter", lambda df: F.length("text") > 5), (1, "map", lambda df: df.withColumn("text", F.upper("text"))), (3, "map", lambda df: df.withColumn("word_count", F.size(X.words(F.col("text")))))]
    return R.chain(c, steps).drop("text")


def message_validity(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    period = F.when(F.col("k") > 0, F.make_dt_interval(F.col("k")))
    return e.select("event_id", R.is_valid(F.col("ts"), period, F.lit(NOW)).alias("valid"))


def null_rating_filter(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("rating"))
    return r.where(F.coalesce("rating", F.lit(0.0)) != 0)


def prompt_caption(spark, d):
    """Null-propagating concatenation of the first two turns of each conversation."""
    c = table(spark, d, "conversations")
    turns = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("prompt"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("caption"))
    return turns.select("conv_id", F.md5(F.concat("prompt", F.lit("\n\n"), "caption")).alias("digest"))


def pad_zip_explode(spark, d):
    c = table(spark, d, "conversations")
    lists = c.groupBy("conv_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", F.md5("text").alias("m"))))), lambda x: x["m"]).alias(r) for r in ("user", "assistant", "system")])
    return R.zipped(lists, "user", "assistant", "system")


def batch_requests_jsonl(spark, d):
    """One JSON request per conversation; the system message only where there is one, user and assistant only where both are."""
    c = table(spark, d, "conversations")
    first = lambda r: F.min_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn"))).alias(f"{r}_message")
    rows = c.groupBy(F.col("conv_id").alias("n")).agg(first("system"), first("user"), first("assistant"))
    return files.requests(rows, "model").select(F.col("n").alias("conv_id"), F.md5("value").alias("digest"))


def latest_prompt_num(spark, d):
    """The largest of the first numbers in the names of pages; 0 if none has one."""
    return table(spark, d, "pages").agg(F.coalesce(F.max(files.first_number(F.col("url"))), F.lit(0)).alias("last"))


def color_harmony(spark, d):
    """Colours from keys: of each supplier's nation against the supplier."""
    s = table(spark, d, "supplier")
    a = [(F.col("s_suppkey") * m % 256) / 255.0 for m in (37, 91, 151)]
    b = [(F.col("s_nationkey").cast("long") * m % 256) / 255.0 for m in (53, 17, 201)]
    return s.select("s_suppkey", F.round(C.delta_e(tuple(a), tuple(b)), 4).alias("delta_e"), F.round(C.harmony(tuple(a), tuple(b)), 4).alias("harmony"))


def compat_matrix(spark, d):
    """Segments and priorities that a rule table makes compatible: the rules are few, so the pairs are an equi-join."""
    rules = spark.createDataFrame([("BUILDING", "1-URGENT"), ("BUILDING", "2-HIGH"), ("MACHINERY", "5-LOW"), ("AUTOMOBILE", "3-MEDIUM")], "seg string, pri string")
    scenes = table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg")).distinct()
    elements = table(spark, d, "orders").select(F.col("o_orderpriority").alias("pri")).distinct()
    pairs = scenes.join(R.small(elements), how="cross")  # two lists of distinct types
    return pairs.join(rules.withColumn("hit", F.lit(1)), ["seg", "pri"], "left").select("seg", "pri", F.coalesce("hit", F.lit(0)).alias("compatible"))


def ownership_chain(spark, d):
    """Which customer each line of an order belongs to: foreign keys over three tables."""
    l, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "c_custkey", "c_nationkey")


def cartesian_segments(spark, d):
    """All pairs of a conversation's turns, those with themselves too, in row-major order."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return c.join(c.withColumnRenamed("turn", "other"), "conv_id").select("conv_id", "turn", "other", F.row_number().over(R.W.partitionBy("conv_id").orderBy("turn", "other")).alias("pos"))


QUERIES = {f.__name__: f for f in (
    paginate, point_lookup, conjunctive_filter, in_semi, filter_corpus, fk_accepted, fk_rejected, diff_mode, update_mode, upsert_tree, key_intersect, key_except,
    union_all, partial_update_notnull, partial_update_truthy, full_overwrite, delete_by_id, card_types, first_seen_texts, mode_per_customer, natural_sort,
    seeded_shuffle, priority_lanes, latest_event, file_batches, callback_chain, message_validity, null_rating_filter, prompt_caption, pad_zip_explode,
    batch_requests_jsonl, latest_prompt_num, color_harmony, compat_matrix, ownership_chain, cartesian_segments,
)} | {
    "prefix_filter_start": _prefix("start", "COLD"),
    "prefix_filter_exact": _prefix("exact", "Cold Widget"),
    "prefix_filter_contains": _prefix("contains", "widget", more=True),
    "prefix_filter_end": _prefix("end", "GET"),
    "prefix_filter_regex": _prefix("regex", "^[a-m].* [w-z]", cased=True),
}

_A = "a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderstatus <> 'P')"
_P = "p AS (SELECT c_custkey AS k, CASE WHEN c_nationkey < 12 THEN '' WHEN c_nationkey < 20 THEN 'NEW' END AS seg, CASE WHEN c_nationkey % 2 = 0 THEN 0.0::DOUBLE END AS bal FROM customer WHERE c_acctbal < 0)"


def _lab(p: str, r: str, g: str, b: str) -> str:
    lin = [f"(CASE WHEN {c} > 0.04045::DOUBLE THEN pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) ELSE {c} / 12.92::DOUBLE END)" for c in (r, g, b)]
    f = []
    for row, w in zip(C.MATRIX, C.WHITE):
        t = "(" + " + ".join(f"{m}::DOUBLE * {x}" for m, x in zip(row, lin)) + f") / {w}::DOUBLE"
        f.append(f"(CASE WHEN {t} > 0.008856::DOUBLE THEN cbrt({t}) ELSE 7.787::DOUBLE * ({t}) + 16.0::DOUBLE / 116 END)")
    return f"116 * {f[1]} - 16 AS {p}l, 500 * ({f[0]} - {f[1]}) AS {p}a, 200 * ({f[1]} - {f[2]}) AS {p}b"


def _hue(r: str, g: str, b: str) -> str:
    hi, lo = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    x = f"(CASE WHEN {hi} = {r} THEN ({g} - {b}) / ({hi} - {lo}) WHEN {hi} = {g} THEN 2 + ({b} - {r}) / ({hi} - {lo}) ELSE 4 + ({r} - {g}) / ({hi} - {lo}) END / 6)"
    return f"CASE WHEN {hi} = {lo} THEN 0.0::DOUBLE ELSE {x} - floor({x}) END"


SQL = {
    "paginate": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20",
    "point_lookup": "SELECT * FROM customer WHERE c_custkey = 42",
    "conjunctive_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000",
    "in_semi": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')",
    "filter_corpus": "SELECT p_partkey, p_type FROM part WHERE lower(trim(p_type)) <> 'promo'",
    "fk_accepted": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "fk_rejected": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "diff_mode": f"WITH {_A} SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)",
    "update_mode": f"WITH {_A} SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)",
    "upsert_tree": f"WITH {_A} SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)",
    "key_intersect": f"WITH {_A} SELECT o_orderkey FROM a INTERSECT SELECT o_orderkey FROM b",
    "key_except": f"WITH {_A} SELECT o_orderkey FROM a EXCEPT SELECT o_orderkey FROM b",
    "union_all": f"WITH {_A} SELECT * FROM a UNION ALL SELECT * FROM b",
    "partial_update_notnull": f"WITH {_P} SELECT c_custkey, coalesce(bal, c_acctbal) AS c_acctbal, coalesce(seg, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN p ON k = c_custkey",
    "partial_update_truthy": f"WITH {_P} SELECT c_custkey, coalesce(nullif(bal, 0), c_acctbal) AS c_acctbal, coalesce(nullif(seg, ''), c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN p ON k = c_custkey",
    "full_overwrite": f"WITH {_P} SELECT c_custkey, CASE WHEN k IS NOT NULL THEN bal ELSE c_acctbal END AS c_acctbal, CASE WHEN k IS NOT NULL THEN seg ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN p ON k = c_custkey",
    "delete_by_id": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.09)",
    "card_types": "SELECT DISTINCT event_type FROM events",
    "first_seen_texts": "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text",
    "mode_per_customer": "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) = 1",
    "natural_sort": "SELECT p_brand, row_number() OVER (ORDER BY list_aggregate([CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END FOR x IN regexp_extract_all(lower(p_brand), '\\d+|\\D+')], 'string_agg', ''), p_brand) AS pos FROM (SELECT DISTINCT p_brand FROM part)",
    "seeded_shuffle": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5('7|' || conv_id || '|' || turn), turn) AS pos FROM conversations",
    "priority_lanes": "WITH e AS (SELECT event_id, user_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 >= 5 THEN 0 ELSE 1 END AS lane FROM events) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lane, event_id) AS pos FROM e",
    "latest_event": "SELECT user_id, event_id, event_type, ts, 1 AS rank FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "file_batches": "SELECT o_custkey, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 10) AS BIGINT) AS batch FROM orders",
    "callback_chain": r"SELECT conv_id, turn, len(regexp_extract_all(upper(text), '\S+')) AS word_count FROM conversations WHERE length(text) > 5",
    "message_validity": "SELECT event_id, CASE WHEN k > 0 THEN TIMESTAMP '2024-06-01' <= ts + to_days(k) ELSE true END AS valid FROM (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)",
    "null_rating_filter": "SELECT l_orderkey, l_linenumber, l_discount AS rating FROM lineitem WHERE coalesce(l_discount, 0) <> 0",
    "prompt_caption": "SELECT conv_id, md5(max(CASE WHEN turn = 0 THEN text END) || chr(10) || chr(10) || max(CASE WHEN turn = 1 THEN text END)) AS digest FROM conversations GROUP BY conv_id",
    "pad_zip_explode": """WITH r AS (SELECT conv_id, role, md5(text) AS m, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id, CAST(pos AS INT) AS pos, max(CASE WHEN role = 'user' THEN m END) AS user, max(CASE WHEN role = 'assistant' THEN m END) AS assistant, max(CASE WHEN role = 'system' THEN m END) AS system FROM r GROUP BY conv_id, pos""",
    "batch_requests_jsonl": """WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS s, arg_min(text, turn) FILTER (WHERE role = 'user') AS u, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, list_concat(CASE WHEN s IS NOT NULL THEN [{'role': 'system', 'content': s}] ELSE [] END, CASE WHEN u IS NOT NULL AND a IS NOT NULL THEN [{'role': 'user', 'content': u}, {'role': 'assistant', 'content': a}] ELSE [] END) AS m FROM f)
SELECT conv_id, md5(CAST(to_json({'custom_id': 'request-' || conv_id, 'method': 'POST', 'url': '/v1/chat/completions', 'body': {'model': 'model', 'messages': m, 'max_tokens': 512}}) AS VARCHAR)) AS digest FROM m""",
    "latest_prompt_num": r"SELECT coalesce(max(TRY_CAST(nullif(regexp_extract(string_split(url, '/')[-1], '(\d+)', 1), '') AS BIGINT)), 0) AS last FROM pages",
    "color_harmony": f"""WITH c AS (SELECT s_suppkey, {', '.join(f"(s_suppkey * {m} % 256)::DOUBLE / 255 AS a{k}, (s_nationkey::BIGINT * {n} % 256)::DOUBLE / 255 AS b{k}" for k, (m, n) in enumerate(((37, 53), (91, 17), (151, 201))))} FROM supplier),
l AS (SELECT *, {_lab('p', 'a0', 'a1', 'a2')}, {_lab('q', 'b0', 'b1', 'b2')}, {_hue('a0', 'a1', 'a2')} AS h1, {_hue('b0', 'b1', 'b2')} AS h2 FROM c),
e AS (SELECT *, sqrt(pow(pl - ql, 2) + pow(pa - qa, 2) + pow(pb - qb, 2)) AS de FROM l)
SELECT s_suppkey, round(de, 4) AS delta_e, round(0.4::DOUBLE * greatest(0, 1 - abs(h1 - h2)) + 0.4::DOUBLE * (100 - de) + 0.2::DOUBLE * abs((0.3::DOUBLE * a0 + 0.59::DOUBLE * a1 + 0.11::DOUBLE * a2) - (0.3::DOUBLE * b0 + 0.59::DOUBLE * b1 + 0.11::DOUBLE * b2)), 4) AS harmony FROM e""",
    "compat_matrix": """SELECT seg, pri, CASE WHEN (seg, pri) IN (('BUILDING', '1-URGENT'), ('BUILDING', '2-HIGH'), ('MACHINERY', '5-LOW'), ('AUTOMOBILE', '3-MEDIUM')) THEN 1 ELSE 0 END AS compatible
FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) CROSS JOIN (SELECT DISTINCT o_orderpriority AS pri FROM orders)""",
    "ownership_chain": "SELECT l_orderkey, l_linenumber, c_custkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    "cartesian_segments": "SELECT a.conv_id, a.turn, b.turn AS other, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn, b.turn) AS pos FROM conversations a JOIN conversations b USING (conv_id)",
    "prefix_filter_start": "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'cold')",
    "prefix_filter_exact": "SELECT p_partkey, p_name FROM part WHERE lower(p_name) = 'cold widget'",
    "prefix_filter_contains": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') AND length(trim(p_name)) > 6 AND trim(p_name) <> 'widget'",
    "prefix_filter_end": "SELECT p_partkey, p_name FROM part WHERE ends_with(lower(p_name), 'get')",
    "prefix_filter_regex": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].* [w-z]')",
}
