"""Recommendations. Users are customers (items: parts they ordered) or event users (types: the key of an event's properties)."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import recommend as R
from braidwork.operators import relational as Q
from braidwork.sources.shared import written
from braidwork.sources.tables import table


def _ratings(spark, d):
    """The largest quantity of finished lines is the rating; of parts on open lines only it is null."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.max(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("rating"))


def _users(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user"))


def _owned(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("int").alias("type"), F.col("event_id").alias("card"), "ts", "event_type")


def user_rating_cosine(spark, d):
    return R.user_cosine(_ratings(spark, d)).withColumn("similarity", F.round("similarity", 6))


def recommend_items(spark, d):
    return R.recommend_items(_ratings(spark, d), _users(spark, d))


def user_type_jaccard(spark, d):
    return R.similar_by_types(_owned(spark, d))


def recommend_cards(spark, d):
    o = _owned(spark, d)
    return R.new_types(o, o.select("type", "card"))


def recommend_cards_similar(spark, d):
    # Read several times: types are taken out of the properties once.
    o = written(_owned(spark, d).select("user", "type", "card"), "owned")
    return R.with_similar_cards(o, o.select("type", "card"))


def popular_cards(spark, d):
    return R.of_mode_type(_owned(spark, d).select("user", "type", "card"))


def recent_cards(spark, d):
    """Each user's cards, newest first."""
    o = _owned(spark, d)
    return o.select("user", "card", F.row_number().over(Q.W.partitionBy("user").orderBy(F.desc("ts"), F.desc("card"))).alias("pos"))


def mode_type_scenes(spark, d):
    """The first three lines of each part's most frequent return flag."""
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("user"), F.col("l_returnflag").alias("type"), "l_orderkey", "l_linenumber")
    return Q.top(R.of_mode_type(l, ["user"]), ["user"], ["l_orderkey", "l_linenumber"], 3)


def engagement_score(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"))
    sessions = table(spark, d, "orders").select(F.col("o_custkey").alias("user"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000).alias("duration"))
    emotions = table(spark, d, "events").select(F.col("user_id").alias("user"))
    return R.engagement(users, sessions, emotions)


def connection_score(spark, d):
    """Engagement halved, and 50 more for customers of two segments."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("ok"))
    return engagement_score(spark, d).join(c, "user").select("user", R.connection(F.col("ok"), F.col("score")).alias("score"))


def _goals(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("user"), F.when(F.col("event_type") == "purchase", "achieved").otherwise("open").alias("status"), F.get_json_object("props", "$.k").cast("int").alias("type"))


def achievements_thresholds(spark, d):
    return R.achievements(_goals(spark, d))


def award_if_absent(spark, d):
    held = table(spark, d, "events").select(F.col("user_id").alias("user")).distinct().where("user % 2 = 0").select("user", F.lit("First Goal Achieved").alias("title"))
    return R.award(held, achievements_thresholds(spark, d))


def goal_recommendation(spark, d):
    """The type that each user achieved most."""
    return Q.mode_of(_goals(spark, d).where("status = 'achieved'"), ["user"], "type")


def mood_gate(spark, d):
    """Users whose latest event is an error of high value, each with the three largest purchases of all."""
    e = table(spark, d, "events")
    low = R.latest(e, "user_id", "ts", "event_id").where((F.col("event_type") == "error") & (F.col("value") > 20)).select("user_id")
    calm = e.where("event_type = 'purchase'").orderBy(F.desc("value"), "event_id").limit(3).select("event_id", F.col("value").alias("rating"))
    return low.join(F.broadcast(calm), how="cross")


def mood_lists(spark, d):
    """Economy parts by price and by number for users whose latest event is an error or a refund of high value."""
    e = R.latest(table(spark, d, "events"), "user_id", "ts", "event_id")
    moods = e.select(F.col("user_id").alias("user"), F.col("event_type").alias("mood"), F.when(F.col("value") > 20, "high").otherwise("low").alias("intensity"))
    p = table(spark, d, "part")
    scripts = p.select(F.col("p_partkey").alias("script"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("rating"))
    return R.on_mood(moods, "high", ("error", "refund"), scripts, scripts.select(F.col("script").alias("scene"), "type"), "ECONOMY")


def personal_bundle(spark, d):
    """One row per user: cards to try, the type achieved most, achievements."""
    o = _owned(spark, d)
    cards = R.new_types(o, o.select("type", "card")).groupBy("user").agg(F.array_sort(F.collect_list("card")).alias("cards"))
    goal = goal_recommendation(spark, d).select("user", F.col("type").alias("goal"))
    titles = achievements_thresholds(spark, d).groupBy("user").agg(F.count("*").alias("titles"))
    return o.select("user").distinct().join(cards, "user", "left").join(goal, "user", "left").join(titles, "user", "left")


QUERIES = {f.__name__: f for f in (
    user_rating_cosine, recommend_items, user_type_jaccard, recommend_cards, recommend_cards_similar, popular_cards, recent_cards, mode_type_scenes, engagement_score, connection_score,
    achievements_thresholds, award_if_absent, goal_recommendation, mood_gate, mood_lists, personal_bundle,
)}

_R = "r AS (SELECT o_custkey AS u, l_partkey AS item, max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), cs AS (SELECT a.u AS user, b.u AS other, count(*) AS common, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS similarity FROM r a JOIN r b ON a.item = b.item AND a.u <> b.u WHERE a.x <> 0 AND b.x <> 0 GROUP BY ALL)"
_O = "o AS (SELECT user_id AS user, CAST(json_extract_string(props, '$.k') AS INT) AS type, event_id AS card, ts FROM events)"
_G = "g AS (SELECT user_id AS user, event_type = 'purchase' AS done, CAST(json_extract_string(props, '$.k') AS INT) AS type FROM events)"
_T = _G + ", t AS (SELECT user, n, unnest([1, 5, 10]) AS least, unnest(['First Goal Achieved', 'Five Goals Achieved', 'Ten Goals Achieved']) AS title FROM (SELECT user, count(*) FILTER (WHERE done) AS n FROM g GROUP BY user))"
_GOAL = "gr AS (SELECT user, type, count(*) AS n FROM g WHERE done GROUP BY user, type QUALIFY row_number() OVER (PARTITION BY user ORDER BY count(*) DESC, type) = 1)"
_NEW = "nw AS (SELECT u.user, o.type, o.card FROM (SELECT DISTINCT user FROM o) u CROSS JOIN o WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.user = u.user AND x.type = o.type) QUALIFY row_number() OVER (PARTITION BY u.user ORDER BY o.card) <= 3)"
_E = """s AS (SELECT o_custkey AS u, count(*) AS s, avg(nullif(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END, 0)) AS d FROM orders GROUP BY 1), e AS (SELECT user_id AS u, count(*) AS e FROM events GROUP BY 1),
eng AS (SELECT c_custkey AS user, c_mktsegment AS seg, CASE WHEN s.s > 0 AND s.d IS NULL THEN 0 ELSE CAST(trunc(0.4::DOUBLE * coalesce(s.s, 0) + 0.3::DOUBLE * coalesce(s.d, 0) + 0.3::DOUBLE * coalesce(e.e, 0)) AS BIGINT) END AS score FROM customer LEFT JOIN s ON s.u = c_custkey LEFT JOIN e ON e.u = c_custkey)"""
SQL = {
    "user_rating_cosine": f"WITH {_R} SELECT user, other, common, round(similarity, 6) AS similarity FROM cs",
    "recommend_items": f"""WITH {_R}, us AS (SELECT c_custkey AS u FROM customer),
n AS (SELECT a.u AS user, b.u AS other FROM us a JOIN us b ON a.u <> b.u LEFT JOIN cs ON cs.user = a.u AND cs.other = b.u
  QUALIFY row_number() OVER (PARTITION BY a.u ORDER BY coalesce(round(cs.similarity, 6), 0) DESC, b.u) <= 5),
t AS (SELECT DISTINCT n.user, r.item FROM n JOIN r ON r.u = n.other WHERE NOT EXISTS (SELECT 1 FROM r m WHERE m.u = n.user AND m.item = r.item AND m.x <> 0))
SELECT user, item, row_number() OVER (PARTITION BY user ORDER BY item) AS rank FROM t QUALIFY rank <= 3""",
    "user_type_jaccard": f"""WITH {_O}, t AS (SELECT DISTINCT user, type FROM o), n AS (SELECT user, count(*) AS n FROM t GROUP BY user),
j AS (SELECT a.user, b.user AS other, count(*) AS c FROM t a JOIN t b ON a.type = b.type AND a.user <> b.user GROUP BY 1, 2),
s AS (SELECT x.user, y.user AS other, coalesce(round(j.c::DOUBLE / (x.n + y.n - j.c), 6), 0) AS similarity FROM n x JOIN n y ON x.user <> y.user LEFT JOIN j ON j.user = x.user AND j.other = y.user)
SELECT *, row_number() OVER (PARTITION BY user ORDER BY similarity DESC, other) AS rank FROM s QUALIFY rank <= 5""",
    "recommend_cards_similar": f"WITH {_O}, {_NEW} SELECT user, type, card, row_number() OVER (PARTITION BY user ORDER BY card) AS rank FROM nw",
    "mood_lists": """WITH l AS (SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
p AS (SELECT 'scripts' AS list, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos, p_partkey AS id FROM part WHERE p_type = 'ECONOMY' QUALIFY pos <= 3
 UNION ALL SELECT 'scenes', row_number() OVER (ORDER BY p_partkey DESC) AS pos, p_partkey FROM part WHERE p_type = 'ECONOMY' QUALIFY pos <= 3)
SELECT l.user_id AS user, p.list, p.pos, p.id FROM l CROSS JOIN p WHERE l.value > 20 AND l.event_type IN ('error', 'refund')""",
    "recommend_cards": f"WITH {_O}, {_NEW} SELECT user, type, card, row_number() OVER (PARTITION BY user ORDER BY card) AS rank FROM nw",
    "popular_cards": f"WITH {_O} SELECT user, type, card FROM o WHERE type = (SELECT type FROM o GROUP BY type ORDER BY count(*) DESC, type LIMIT 1)",
    "recent_cards": f"WITH {_O} SELECT user, card, row_number() OVER (PARTITION BY user ORDER BY ts DESC, card DESC) AS pos FROM o",
    "mode_type_scenes": """WITH m AS (SELECT l_partkey AS user, l_returnflag AS type FROM lineitem GROUP BY l_partkey, l_returnflag QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_returnflag) = 1)
SELECT m.user, m.type, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY m.user ORDER BY l_orderkey, l_linenumber) AS rank FROM lineitem JOIN m ON l_partkey = m.user AND l_returnflag = m.type QUALIFY rank <= 3""",
    "engagement_score": f"WITH {_E} SELECT user, score FROM eng",
    "connection_score": f"WITH {_E} SELECT user, CAST(trunc(CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 50 ELSE 0 END + 0.5::DOUBLE * score) AS BIGINT) AS score FROM eng",
    "achievements_thresholds": f"WITH {_T} SELECT user, title FROM t WHERE n >= least",
    "award_if_absent": f"WITH {_T} SELECT user, title FROM t WHERE n >= least UNION SELECT user, 'First Goal Achieved' FROM g WHERE user % 2 = 0",
    "goal_recommendation": f"WITH {_G}, {_GOAL} SELECT * FROM gr",
    "mood_gate": """WITH l AS (SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id, rating FROM l CROSS JOIN (SELECT event_id, value AS rating FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 3) WHERE l.event_type = 'error' AND l.value > 20""",
    "personal_bundle": f"""WITH {_O}, {_NEW}, {_T}, {_GOAL}, c AS (SELECT user, list(card ORDER BY card) AS cards FROM nw GROUP BY user), n AS (SELECT user, count(*) AS titles FROM t WHERE n >= least GROUP BY user)
SELECT u.user, c.cards, gr.type AS goal, n.titles FROM (SELECT DISTINCT user FROM o) u LEFT JOIN c USING (user) LEFT JOIN gr USING (user) LEFT JOIN n USING (user)""",
}
