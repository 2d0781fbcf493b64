"""Benchmark decontamination by winnowing (built-in functions only).

Texts become hashes of k-grams of words. Of every ``window - k + 1``
consecutive k-grams, one window of words, the last of the least hashes is a
fingerprint, so any shared run of ``window`` words shares one, at the same
place of that run. Documents keep the fingerprints that items have too; each
hit is extended to all windows of words around it, and those windows are
joined with the items' windows as they are written, not by hash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, apart, materialize, maybe_broadcast, table, without

#: A word of lower-cased text; in ANY, A-Z are word characters too, so that texts need not be lower-cased to count.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same with each separator by itself: Java's regex looks those up in a table, where it tries ranges one after the other for every letter.
LISTED_WORD, LISTED_ANY = ("[^" + "".join(f"\\x{c:02X}" for c in range(128) if not re.match(p, chr(c))) + "]+" for p in (WORD, ANY))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words with A-Z lower-cased and nothing else changed."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LISTED_WORD), F.lit(0))


def _hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the hashes of the words.

    ``lower`` also folds letters other than A-Z: it is much faster than
    ``translate``, finds the same word borders, and can only make more words
    alike, which the comparison of words undoes. Capital sigma is replaced
    first: it is the one letter whose small form depends on what surrounds it.
    """
    folded = F.lower(F.replace("text", F.lit("\u03a3"), F.lit("\u03c3")))
    return df.select(*keys, F.transform(F.regexp_extract_all(folded, F.lit(LISTED_WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("h"))


def _grams(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``g``: the hash of the n-gram at each position."""
    gram = F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.xxhash64(F.lit(n), *[F.get("h", i + j) for j in range(n)]))
    return df.where(F.size("h") >= n).select(*keys, gram.alias("g"))


def fingerprints(hashed: DataFrame, keys: list[str], window: int, k: int) -> DataFrame:
    """(keys, n, q, print): winnowed k-grams of texts of at least ``window`` words; q is the k-gram's position.

    A window whose last least k-gram is that of the window before adds
    nothing. The others are those where the new k-gram is as small as all, or
    where the k-gram that left was smaller than the rest.
    """
    w = window - k + 1
    at = lambda j: F.get("g", F.col("p") + j)
    low = lambda n: F.least(*[at(i) for i in range(n)]) if n > 1 else at(0)
    inner = low(w - 1)
    last = F.lit(0)
    for j in range(1, w):
        last = F.when(at(j) <= low(j), j).otherwise(last)
    grams = _grams(hashed.where(F.size("h") >= window), keys, k).withColumn("p", F.explode(F.sequence(F.lit(0), F.size("g") - w)))
    fresh = grams.where((F.col("p") == 0) | (at(w - 1) <= inner) | (F.get("g", F.col("p") - 1) < inner))
    return fresh.select(*keys, F.lit(k).alias("n"), (F.col("p") + last).alias("q"), F.least(inner, at(w - 1)).alias("print"))


def _all_prints(hashed: DataFrame, keys: list[str], window: int, k: int, short: list[int]) -> DataFrame:
    """Winnowed prints; for items shorter than a window, of ``short`` words, every n-gram of those lengths too."""
    out = fingerprints(hashed, keys, window, k)
    for n in short:
        # Positions are exploded, not n-grams: a filter on exploded n-grams would be pushed down and hash the text at every position.
        each = hashed.where(F.size("h") >= n).withColumn("q", F.explode(F.sequence(F.lit(0), F.size("h") - n)))
        gram = F.xxhash64(F.lit(n), *[F.get("h", F.col("q") + j) for j in range(n)])
        each = each.select(*keys, F.lit(-n).alias("n"), "q", gram.alias("print"))
        out = out.unionByName(each)
    return out


def _window(at: Column, size: Column) -> Column:
    return F.array_join(F.slice("w", at + 1, size), " ").alias("win")


@apart("doc_id", "text")
def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted distinct item ids as strings) and contaminated.

    A document word is hit if an occurrence of a window of an item covers it;
    an item of fewer words is one window. Defined results: null texts have no
    words; items without words hit nothing; items with null ids hit words but
    are not listed; repeated documents and items count as one each in items
    and as often as they come in the rows; empty tables give empty or
    uncontaminated results; input columns named like an output are replaced.
    """
    kept = without(docs, "n_words", "n_hit", "items", "contaminated", "_hash", "_id", "_h")
    keyed = kept.withColumn("_hash", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull()).distinct()
    items = materialize(items.withColumn("key", F.xxhash64("item", "text")).withColumn("w", words(F.col("text"))).where(F.size("w") > 0), "items")
    # at most window - 1 numbers
    short = [r[0] for r in items.where(F.size("w") < window).select(F.size("w")).distinct().collect()]
    long_items, short_items = items.where(F.size("w") >= window), items.where(F.size("w") < window)
    item_prints = fingerprints(_hashed(long_items, ["key"]), ["key"], window, k)
    if short:
        whole = _hashed(short_items, ["key"]).select("key", (-F.size("h")).alias("n"), F.lit(0).alias("q"), F.col("h"))
        by_len = F.lit(None).cast("long")
        for n in short:
            by_len = F.when(F.size("h") == n, F.xxhash64(F.lit(n), *[F.get("h", F.lit(j)) for j in range(n)])).otherwise(by_len)
        item_prints = item_prints.unionByName(whole.select("key", "n", "q", by_len.alias("print")))
    item_prints = materialize(item_prints.select("n", "print").distinct(), "item-prints")
    m = F.least(F.lit(window), F.size("w"))
    item_windows = items.select("item", "w", F.explode(F.sequence(F.lit(0), F.size("w") - m)).alias("at")).select("item", _window(F.col("at"), m))
    item_windows = materialize(item_windows.distinct(), "item-windows")
    texts = keyed.where(F.col("text").isNotNull()).select("doc_id", "_hash", "text")
    prints = _all_prints(_hashed(texts, ["doc_id", "_hash"]), ["doc_id", "_hash"], window, k, short)
    met = prints.join(maybe_broadcast(item_prints), ["n", "print"], "left_semi")
    # A window's start and length as one number.
    code = lambda at, size: at * (window + 1) + size
    found = met.groupBy("doc_id", "_hash").agg(F.collect_list(F.struct("n", "q")).alias("found"))
    found = materialize(found, "candidates").withColumnsRenamed({"doc_id": "_id", "_hash": "_h"})
    same = keyed["doc_id"].eqNullSafe(found["_id"]) & (keyed["_hash"] == found["_h"])
    near = texts.join(maybe_broadcast(found, BROADCAST_ROWS // 10, "found", BROADCAST_ROWS), same).select("_id", "_h", "text", "found").dropDuplicates(["_id", "_h"])
    # Written out so that the words are made once, not at each use below.
    near = materialize(near.select("_id", "_h", words(F.col("text")).alias("w"), "found"), "aligned")
    around = lambda q: F.sequence(F.greatest(q - (window - k), F.lit(0)), F.least(q, F.size("w") - window))
    codes = F.transform("found", lambda f: F.when(f["n"] < 0, F.array(code(f["q"], -f["n"]))).otherwise(F.transform(around(f["q"]), lambda at: code(at, F.lit(window)))))
    each = near.select("_id", "_h", "w", F.explode(F.array_distinct(F.flatten(codes))).alias("code"))
    at, size = F.floor(F.col("code") / (window + 1)).cast("int"), F.col("code") % (window + 1)
    each = each.select("_id", "_h", "code", _window(at, size)).groupBy("_id", "_h", "win").agg(F.collect_list("code").alias("codes"))
    hits = materialize(each.join(maybe_broadcast(item_windows.select("win").distinct()), "win", "left_semi"), "window-hits")
    covered = lambda c: F.sequence(F.floor(c / (window + 1)).cast("int"), F.floor(c / (window + 1)).cast("int") + c % (window + 1) - 1)
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("codes")), covered)))
    counted = hits.groupBy("_id", "_h").agg(F.size(covered).cast("long").alias("n_hit"))
    named = hits.select("_id", "_h", "win").join(maybe_broadcast(item_windows.where("item IS NOT NULL")), "win").select("_id", "_h", "item").distinct()
    named = named.groupBy(F.col("_id").alias("_id2"), F.col("_h").alias("_h2")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    hits = counted.join(named, counted["_id"].eqNullSafe(named["_id2"]) & (counted["_h"] == named["_h2"]), "left").drop("_id2", "_h2")
    hits = maybe_broadcast(materialize(hits, "hits"), BROADCAST_ROWS // 4, "items", BROADCAST_ROWS)
    base = keyed.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(LISTED_ANY)), F.lit(0)).cast("long"))
    same = base["doc_id"].eqNullSafe(hits["_id"]) & (base["_hash"] == hits["_h"])
    out = base.join(hits, same, "left").drop("_id", "_h", "_hash")
    return out.withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
            "items": F.coalesce("items", F.array().cast("array<string>")),
            "contaminated": F.coalesce(F.col("n_hit") > 0, F.lit(False)),
        }
    )


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_LOW = f"translate(text, '{UPPER}', '{LOWER}')"
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all({_LOW}, '{WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, w[j + 1 : j + least(10, len(w))] AS win
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS j FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT id, p, m, w[p + 1 : p + m] AS win FROM (SELECT id, w, m, unnest(range(0, len(w) - m + 1)) AS p FROM d JOIN ms ON len(w) >= m)),
hit AS (SELECT dw.id, dw.p, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
pos AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(p, p + m)) AS x FROM hit) GROUP BY id),
it AS (SELECT id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (id) LEFT JOIN it USING (id)
"""
