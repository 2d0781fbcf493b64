"""Importance resampling towards a target distribution, by an external sort and count.

Runs of one to ``longest`` words are features, and a hash deals them into
buckets. A pass over the texts writes the buckets of many documents one after
the other as packed 16-bit numbers, with the offset of each document; nothing
reads the texts again. To count, every stream is sorted and run-length
encoded, a task adds its runs up, and Spark adds the tasks' counts, at most
one row for each bucket and task. The logarithm of how much more frequent a
bucket is in the target is its gain. Gains are gathered through the streams
and added between offsets (``np.add.reduceat``). The floored mean and Gumbel
noise seeded by the document's id give the score; the highest scores are a
sample without replacement of the documents, weighted by importance.
"""

from __future__ import annotations

from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ranked, table, without

BUCKETS = 10_000
LONGEST = 2
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
#: Features in a stream, but for a longer document, which has one of its own.
STREAM = 1 << 20
#: Words are made of digits, letters and what is not ASCII; A-Z are lower-cased.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def buckets_of(text: bytes | None, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every feature: its CRC-32 modulo ``buckets``.

    The CRC of a longer run goes on from that of the run without its last word.
    """
    words = (text or b"").translate(_FOLD).split()
    run, found = list(map(crc32, words)), []
    for n in range(1, longest + 1):
        if not run:
            break
        found.append(np.array(run, np.uint32) % buckets)
        run = list(map(crc32, words[n:], map(crc32, repeat(b" "), run)))
    return len(words), np.concatenate(found).astype(np.uint16) if found else np.zeros(0, np.uint16)


def streams(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, carry: list[str] | None = None) -> DataFrame:
    """Packed streams of whole texts: rows, words, offsets, stream.

    ``rows`` holds the columns ``carry`` (all but the text) of the stream's
    documents, ``words`` their numbers of words, ``offsets`` where each
    document's buckets start and where the last ends, ``stream`` the buckets as
    unsigned 16-bit numbers in the order of bytes of this machine.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError(f"{buckets} buckets: 16 bits hold 1 to 65536")
    carry = [c for c in docs.columns if c.lower() != "text"] if carry is None else carry
    given = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry]).alias("row"), F.col("text"))

    def packed(rows: pa.StructArray, words: list, parts: list) -> pa.RecordBatch:
        sizes = [len(p) for p in parts]
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                pa.array([words], pa.list_(pa.int64())),
                pa.array([np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)], pa.list_(pa.int64())),
                pa.array([np.concatenate(parts).tobytes()], pa.binary()),
            ],
            ["rows", "words", "offsets", "stream"],
        )

    def write(batches):
        for b in batches:
            rows, texts = b.column(0), b.column(1).cast(pa.large_binary())
            first, words, parts, held = 0, [], [], 0
            for at in range(len(texts)):
                n, part = buckets_of(texts[at].as_py(), longest, buckets)
                if parts and held + len(part) > STREAM:
                    yield packed(rows.slice(first, at - first), words, parts)
                    first, words, parts, held = at, [], [], 0
                words.append(n)
                parts.append(part)
                held += len(part)
            if parts:
                yield packed(rows.slice(first, len(texts) - first), words, parts)

    kind = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(write, f"rows array<{kind}>, words array<bigint>, offsets array<bigint>, stream binary")


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all streams; each is sorted and run-length encoded, and a task's runs are added up before they leave it."""

    def runs(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for s in b.column(0):
                found = np.sort(np.frombuffer(s.as_py(), np.uint16))
                starts = np.flatnonzero(np.concatenate([[len(found) > 0], found[1:] != found[:-1]]))
                total[found[starts]] += np.diff(np.append(starts, len(found)))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    return packed.select("stream").mapInArrow(runs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For every bucket, 1000 times the logarithm of its share of the target over that of the corpus, one added to all counts, floored.

    Both tables (bucket, n) and the result have at most 65,536 rows.
    """
    spark = corpus.sparkSession
    all_of = lambda df: (df.agg(F.sum("n")).first()[0] or 0) + buckets
    s, t = (F.coalesce(F.col(c), F.lit(0)) + F.lit(1.0) for c in ("s", "t"))
    ratio = t * F.lit(float(all_of(corpus))) / (s * F.lit(float(all_of(target))))
    joined = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    out = np.zeros(buckets, np.int64)
    for r in joined.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A standard Gumbel number, times 1000 and floored, from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """One row per document: its columns but for the text (or those of ``carry``), n_words, n_features, weight, score and rank.

    ``docs`` needs doc_id and text, ``target`` a text. Of the documents with
    at least ``least_words`` words, ``percent`` % (rounded down) have a rank,
    from 1, by falling score; ties go to the smaller doc_id, a null id last,
    then by number of features and weight; rows alike in all of these are
    told apart by nothing and take the next ranks in any order. The texts stay
    where they are: ``drawn`` joins them.

    Defined results: null and empty texts, and texts without words, have no
    features and weight 0; a null doc_id is hashed as the word "null"; rows
    that repeat an id toss the same noise and each count as a document; an
    empty target gives gains by an even share of all buckets; an empty table
    gives an empty table; input columns named like an output are replaced. A
    text is handled as one row.
    """
    made = ("n_words", "n_features", "weight", "score", "rank")
    carry = without(docs, "text", *made).columns if carry is None else carry
    packed = materialize(streams(docs, longest, buckets, carry), "bucket-streams")
    aimed = streams(target.select("text", F.lit(True).alias("aimed")), longest, buckets)
    corpus = materialize(bucket_counts(packed, buckets), "bucket-counts")
    wanted = materialize(bucket_counts(aimed, buckets), "target-counts")
    gain = gains(corpus, wanted, buckets)
    discard(corpus, wanted)

    @F.arrow_udf("array<bigint>")
    def gather(streams_: pa.Array, offsets: pa.Array) -> pa.Array:
        out = []
        for s, o in zip(streams_, offsets):
            at = np.asarray(o.values)
            full = np.flatnonzero(np.diff(at))
            sums = np.zeros(len(at) - 1, np.int64)
            if len(full):
                sums[full] = np.add.reduceat(gain[np.frombuffer(s.as_py(), np.uint16)], at[full])
            sizes = np.diff(at)
            out.append(np.floor_divide(sums, np.maximum(sizes, 1)))
        return pa.array(out, pa.list_(pa.int64()))

    sizes = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("offsets", i + 1) - F.get("offsets", i))
    each = packed.select("rows", "words", sizes.alias("sizes"), gather("stream", "offsets").alias("weights"))
    each = each.select(F.explode(F.arrays_zip("rows", "words", "sizes", "weights")).alias("_d"))
    scored = each.select("_d.rows.*", F.col("_d.words").alias("n_words"), F.col("_d.sizes").alias("n_features"), F.col("_d.weights").alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= least_words
    placed = ranked(scored, [fit.desc(), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.desc("n_features"), F.desc("weight")], "rank", "resampled")
    draws = placed.where(fit).count() * percent // 100
    discard(packed)
    return placed.withColumn("rank", F.when(fit & (F.col("rank") <= draws), F.col("rank")))


def drawn(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """The documents that ``resample`` drew, whole. Needs ids that are unique; those with a null id are left out."""
    return docs.join(scores.where("rank IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (SELECT row_number() OVER () AS id, doc_id, false AS aim, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
  UNION ALL SELECT -1, NULL, true, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) FROM benchmark),
f AS (SELECT id, aim, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
c AS (SELECT id, aim, f, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
  lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]))) % 10000 AS bucket FROM (SELECT DISTINCT f FROM c), tab),
h AS (SELECT c.id, c.aim, b.bucket, sum(n) AS n FROM c JOIN b USING (f) GROUP BY ALL),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (cs + 10000) / ((s + 1)::DOUBLE * (ct + 10000)))) AS BIGINT) AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (aim), 0) AS t, coalesce(sum(n) FILTER (NOT aim), 0) AS s FROM h GROUP BY bucket),
  (SELECT coalesce(sum(n) FILTER (aim), 0) AS ct, coalesce(sum(n) FILTER (NOT aim), 0) AS cs FROM h)),
m AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM h JOIN g USING (bucket) WHERE NOT aim GROUP BY id),
d AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
  CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (id) WHERE NOT w.aim),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, n_features DESC, weight DESC) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM s)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM r
"""
