"""URL filters by hashed host-suffix and path-prefix expressions.

A URL is expanded into every expression that a rule of the list could be: its
host cut to as many last labels, and its path to as many first characters, as
some rule has. Short prefixes of the expressions' SHA-256 digests are joined
with those of the rules, full digests confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, materialize, maybe_broadcast, table, without

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SHORT = 8  # hexadecimal digits


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


@apart("url")
def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (url) with host, path, rule and verdict.

    ``rules`` (host, path, verdict) may be large; only their shapes, the
    numbers of labels and the lengths of paths, come to the driver. Of rules
    that fit, the longest wins; among equals the longer host, then "block".
    Defined results: a null url, or one without "://", has an empty host and
    path, fits no rule and gets ``default``; repeated urls are judged once and
    joined back, so that a hot url costs no more than its rows; empty tables
    of pages or rules work; input columns named like an output are replaced.
    """
    kept = without(pages, "host", "path", "rule", "verdict")
    part = lambda k: F.coalesce(F.regexp_extract("url", URL, k), F.lit(""))
    lower = F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = kept.withColumns({"host": lower, "path": part(2)})
    known = rules.where(F.length("host") > 0).select(
        F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), F.length("host").alias("hosts")
    )
    shapes = [tuple(r) for r in known.select("labels", "chars").distinct().collect()]
    urls = kept.select("host", "path").where("host != ''").distinct()
    if shapes:
        shape = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes])
        labels = F.split("host", r"\.")
        fits = F.filter(shape, lambda s: (F.size("labels") >= s["labels"]) & (F.length("path") >= s["chars"]))
        made = F.transform(
            fits,
            lambda s: F.concat(F.array_join(F.slice("labels", F.size("labels") - s["labels"] + 1, s["labels"]), "."), F.substring(F.col("path"), F.lit(1), s["chars"])),
        )
        urls = urls.withColumn("labels", labels).select("host", "path", F.explode(F.array_distinct(made)).alias("made"))
    else:
        urls = urls.select("host", "path", F.lit("").alias("made"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    urls = urls.withColumn("digest", digest("made")).withColumn("short", F.substring("digest", 1, SHORT))
    known = known.withColumn("full", digest("rule")).withColumn("short", F.substring("full", 1, SHORT))
    won = F.max(F.struct(F.length("rule"), "hosts", (F.col("verdict") == "block").alias("block"), "rule", "verdict")).alias("won")
    # Where rules are too many to broadcast, a short rule's expression is the key of very many urls, which adaptive execution splits.
    known = maybe_broadcast(materialize(known.select("short", "full", "rule", "verdict", "hosts"), "rules"), 100_000)
    best = materialize(urls.join(known, "short").where("digest = full").groupBy("host", "path").agg(won), "verdicts")
    told = lambda rows, rule, verdict: rows.select(*kept.columns, rule.alias("rule"), verdict.alias("verdict"))
    fits = kept.where("host != ''").join(maybe_broadcast(best, 200_000), ["host", "path"], "left")
    # Urls without a host fit no rule and need not meet in a join.
    return told(fits, F.col("won.rule"), F.coalesce("won.verdict", F.lit(default))).unionByName(told(kept.where("host = ''"), F.lit(None).cast("string"), F.lit(default)))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT DISTINCT host, path FROM p),
b AS (SELECT u.host, u.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict = 'block' DESC) AS k
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path AND b.k = 1
"""
