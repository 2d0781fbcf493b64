"""Queries over texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from braidwork.functions import text as X
from braidwork.operators import history as H
from braidwork.operators import memory
from braidwork.sources.shared import shared_dir
from braidwork.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _pieces(name, f):
    """Number of pieces, and a digest of them in order."""

    def query(spark, d):
        return _docs(spark, d).select("doc_id", f(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))

    query.__name__ = name
    return query


PIECES = {
    "split_numbered": lambda t: X.split_keeping(t, r"\d+\s"),
    "split_markdown": X.split_markdown,
    "split_delims": lambda t: X.split_delimiters(t, (";", ",", "|")),
    "split_spaces": X.split_spaces,
    "split_caps": X.split_capitals,
    "split_parts": lambda t: X.split_literal(t, "the"),
    "segment_transcript": lambda t: X.transcript_segments(t, "\n"),
    "split_sentences": X.sentences,
    "token_list": X.tokens,
}


def title_body_split(spark, d):
    title, body = X.title_and_body(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(title).alias("title"), F.md5(body).alias("body"))


def segment_clean(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Part 3 tapestries of "), F.col("p_name"), F.lit(" P 12, Tapestry "), F.col("p_type")).alias("s"))
    return parts.select("p_partkey", X.clean_segment(F.col("s")).alias("clean"))


def template_prompt(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.fill_prompt(F.lit("think  about {option} when\n {dynamic_prompt} "), F.col("p_type"), F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_brand", F.lower("p_type"))).alias("prompt"))


def token_stats(spark, d):
    n = table(spark, d, "conversations").select("conv_id", X.token_count(F.col("text")).alias("t"), F.length("text").alias("c"))
    return n.groupBy("conv_id").agg(F.sum("t").alias("tokens"), F.round(F.var_pop("c"), 4).alias("variance"))


def novelty_factor(spark, d):
    """Each turn against all turns before it."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), "turn", "text")
    return H.novelty(c).select(F.col("conv").alias("conv_id"), "turn", F.round("novelty", 6).alias("novelty"))


def truncate_prompt(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.truncate_sentences(F.col("text"), 500)).alias("digest"))


def chunk_texts(spark, d):
    c = _docs(spark, d).select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk", "t"))
    return c.select("doc_id", "chunk", F.length("t").alias("chars"))


def content_lengths(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return c.select("conv_id", X.part_lengths(F.col("parts")).alias("lengths"))


def to_epoch(spark, d):
    """Dates of orders as text, every status but F made unreadable."""
    s = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("someday"))
    return table(spark, d, "orders").select("o_orderkey", X.epoch(s, F.lit(0).cast("long")).alias("epoch"))


def time_titles(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "MM-dd-yyyy-HH-mm-ss").alias("title"))


def sequence_labels(spark, d):
    r = table(spark, d, "region").select("r_regionkey", X.sequence_labels(F.char(F.col("r_regionkey") + 65)).alias("l"))
    return r.select("r_regionkey", F.array_join("l", " ").alias("labels"))


def map_with_memory(spark, d):
    """Letters of each turn, by a remembered function: first of what users said, then of all turns, which asks for the new ones only."""
    path = f"{shared_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    turns = table(spark, d, "conversations").select("role", F.col("text").alias("input"))
    runs = []
    for n, items in enumerate((turns.where("role = 'user'"), turns)):
        got, asked = memory.remembered(items, len, path)
        called = F.lit(asked.count()).alias("called")
        runs.append(got.agg(F.lit(n).alias("run"), F.count("input").alias("items"), F.countDistinct("input").alias("different"), called, F.sum(F.col("result").cast("long")).alias("letters")))
    return runs[0].unionByName(runs[1])


QUERIES = {n: _pieces(n, f) for n, f in PIECES.items()} | {f.__name__: f for f in (
    title_body_split, segment_clean, template_prompt, token_stats, novelty_factor, truncate_prompt, chunk_texts, content_lengths, to_epoch, time_titles, sequence_labels, map_with_memory,
)}

_S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _sql(parts: str) -> str:
    return f"SELECT doc_id, CAST(len(p) AS INT) AS n, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, {parts} AS p FROM documents)"


def _full(parts: str) -> str:
    return f"[y FOR y IN [{_S.format('x')} FOR x IN {parts}] IF y <> '']"


SQL = {
    "map_with_memory": """WITH t AS (SELECT text, bool_or(role = 'user') AS early FROM conversations WHERE text IS NOT NULL GROUP BY text)
SELECT 0 AS run, count(*) AS items, count(DISTINCT text) AS different, (SELECT count(*) FROM t WHERE early) AS called, CAST(sum(length(text)) AS BIGINT) AS letters FROM conversations WHERE role = 'user' AND text IS NOT NULL
UNION ALL SELECT 1, count(*), count(DISTINCT text), (SELECT count(*) FROM t WHERE NOT early), CAST(sum(length(text)) AS BIGINT) FROM conversations WHERE text IS NOT NULL""",
    "split_numbered": _sql(_full(r"string_split(regexp_replace(text, '(\d+\s)', chr(1) || '\1' || chr(1), 'g'), chr(1))")),
    "split_markdown": _sql(_full(f"regexp_split_to_array(text, '{X.MARKDOWN}')")),
    "split_delims": _sql("regexp_split_to_array(text, '[;,|]')"),
    "split_spaces": _sql(r"regexp_split_to_array(text, '\s{2,}')"),
    "split_caps": _sql("regexp_extract_all(text, '[A-Z][a-z]*')"),
    "split_parts": _sql("string_split(text, 'the')"),
    "segment_transcript": _sql(f"[{_S.format('x')} FOR x IN string_split({_S.format('text')}, chr(10))]"),
    "split_sentences": _sql("string_split(text, '. ')"),
    "token_list": _sql(rf"regexp_extract_all(text, '{X.TOKEN}')"),
    "title_body_split": f"SELECT doc_id, md5({_S.format('string_split(text, chr(10))[1]')}) AS title, md5(coalesce({_S.format('array_to_string(string_split(text, chr(10))[2:], chr(10))')}, '')) AS body FROM documents",
    "segment_clean": r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace('Part 3 tapestries of ' || p_name || ' P 12, Tapestry ' || p_type, 'Part\s*\d+', '', 'g'), 'P\s*\d+', '', 'g'), '(?i)tapestry', 'Synergy', 'g'), '(?i)tapestries', 'Synergies', 'g') AS clean FROM part",
    "template_prompt": r"""WITH t AS (SELECT p_partkey, p_type AS o, p_brand || ' ' || lower(p_type) || ' - Think about ' || lower(p_type) || ' when ' || lower(p_name || ' ' || p_type) || '!' AS s FROM part)
SELECT p_partkey, regexp_replace(s, '(?i)' || regexp_escape(o), '*\0*', 'g') AS prompt FROM t""",
    "token_stats": rf"SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '{X.TOKEN}'))) AS BIGINT) AS tokens, round(var_pop(length(text)), 4) AS variance FROM conversations GROUP BY conv_id",
    "novelty_factor": r"""WITH c AS (SELECT conv_id, turn, text, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS h FROM conversations),
w AS (SELECT conv_id, turn, list_distinct([x FOR x IN regexp_split_to_array(lower(text), '\s+') IF x <> '']) AS a, list_distinct([x FOR x IN regexp_split_to_array(lower(h), '\s+') IF x <> '']) AS b, len([x FOR x IN regexp_split_to_array(h, '\s+') IF x <> '']) AS k FROM c)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE greatest(0, least(1, (1 - 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b))) * greatest(1 - k / 5.0::DOUBLE, 0.2::DOUBLE) * greatest(len(a) / 5.0::DOUBLE, 0.2::DOUBLE))) END, 6) AS novelty FROM w""",
    "truncate_prompt": r"""WITH s AS (SELECT doc_id, [x FOR x IN string_split(text, '.') IF regexp_matches(x, '\S')] AS p FROM documents),
e AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM s),
c AS (SELECT doc_id, x, i, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS total FROM e),
k AS (SELECT *, bool_and(total < 500) OVER (PARTITION BY doc_id ORDER BY i) AS ok FROM c)
SELECT d.doc_id, md5(coalesce(string_agg(x || '.', '' ORDER BY i) FILTER (WHERE ok), '')) AS digest FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""",
    "chunk_texts": r"""WITH RECURSIVE w AS (SELECT doc_id, 0 AS k, text AS r, '' AS h FROM documents WHERE text IS NOT NULL UNION ALL
SELECT doc_id, k + 1, CASE WHEN whole <> '' THEN substr(r, length(head) + 1) END, CASE WHEN whole <> '' THEN head ELSE regexp_replace(r, '\s+$', '') END
FROM (SELECT doc_id, k, r, whole, CASE WHEN length(whole) - length(tail) > 350 THEN left(whole, length(whole) - length(tail)) ELSE whole END AS head
 FROM (SELECT doc_id, k, r, whole, regexp_extract(whole, '[^.?!\n]*$') AS tail FROM (SELECT doc_id, k, r, regexp_extract(r, '^\s*\S+(?:\s+\S+){199}') AS whole FROM w WHERE r IS NOT NULL)))),
t AS (SELECT doc_id, k, regexp_replace(replace(h, chr(10), ' '), '^\s+|\s+$', '', 'g') AS t FROM w WHERE k > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk, CAST(length(t) AS INT) AS chars FROM t WHERE length(t) > 5 QUALIFY chunk < 10000""",
    "content_lengths": r"SELECT conv_id, list(CAST(len(string_split(text, chr(10) || chr(10))) AS INT) ORDER BY turn) AS lengths FROM conversations GROUP BY conv_id",
    "to_epoch": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) ELSE 0 END AS epoch FROM orders",
    "time_titles": "SELECT event_id, strftime(ts, '%m-%d-%Y-%H-%M-%S') AS title FROM events",
    "sequence_labels": "SELECT r_regionkey, array_to_string(flatten([[chr(c::INT) || '-' || r FOR r IN ['I','II','III','IV','V','VI','VII','VIII','IX','X']] FOR c IN range(65, 66 + r_regionkey)]), ' ') AS labels FROM region",
}
