"""Substring dedup by a compacted de Bruijn graph of tokens.

Each window of ``window`` words is an edge between its first and its last
``window - 1`` words, the nodes. The edges of a text that share a minimizer,
the least hash of the k-mers inside them, are one row (a super-k-mer), and
the minimizer says where they can meet others. What comes again as it is, and
stands alone under its minimizer, is one repeated segment; under a minimizer
with several different rows (at the borders of copied passages) every edge is
a segment of its own, and those that two rows share are repeated.

Repeated segments form the graph. Where a node has one segment in and one
out, the two are joined, and pointer doubling by Spark joins numbers the
segments of each path without branches. Every occurrence is then carried to
source coordinates as pieces of such paths, and the pieces that touch in a
text are the maximal repeated spans, whose words are removed.

Segments are equal if two independent hashes of their words are, one from the
prefix sums of the text, one of the bytes at the source coordinates: 128 bits
in all, so that no words cross the network to be compared.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, discard, materialize, maybe_broadcast, table, without

WINDOW = 35
K = 15
_BASE = 0x9E3779B97F4A7C15
#: Rows, and items of their arrays, up to which what is told of texts and their spans are broadcast.
TOLD_ROWS, TOLD_ITEMS = 100_000, 1_000_000
SPAN_ROWS, SPAN_ITEMS = 200_000, 2_000_000


def _digested(digest, items) -> np.ndarray:
    """The 64-bit digests of ``items`` as numbers."""
    return np.frombuffer(b"".join(map(digest, items)), ">u8").astype(np.uint64)


class Hasher:
    """Hashes of any run of words of a text from one pass: differences of prefix sums of a polynomial modulo 2**64, scaled back and mixed."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int):
        if len(self.powers) < n + 1:
            size = max(n + 1, 2 * len(self.powers), 4096)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers, self.inverses = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def read(self, words: list[bytes]):
        from xxhash import xxh64_digest

        n = len(words)
        self._grow(n)
        h = _digested(xxh64_digest, words)  # asking a dictionary for the hash of a known word takes longer
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.powers[:n])])
        self.joined = b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)

    def check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of words ``a`` to ``b``, joined by single spaces."""
        from xxhash import xxh3_64_digest

        starts = np.append(0, self.ends)[a].tolist()
        text = memoryview(self.joined)
        return _digested(xxh3_64_digest, (text[i:j] for i, j in zip(starts, (self.ends[b - 1] - 1).tolist()))).view(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * self.inverses[a] + (b - a).astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _parts(batch: pa.RecordBatch, most: int = 512, size: int = 2 << 20):
    """A batch with texts in its third column, in parts of up to ``most`` rows and about ``size`` bytes, so that a part's arrays stay small."""
    first, total = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(2)).to_pylist()):
        if i > first and (total + (n or 0) > size or i - first == most):
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n or 0
    if first < len(batch):
        yield batch.slice(first)


def _words(texts: pa.Array) -> list[list[bytes]]:
    return [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Where the first of the least values of each run of ``width`` is."""
    at, span = np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        later = x[step:] < x[:-step]
        x, at = np.where(later, x[step:], x[:-step]), np.where(later, at[step:], at[:-step])
        span += step
    return at


def _paths(hasher: Hasher, texts: list[list[bytes]], window: int, k: int):
    """Of each super-k-mer of some texts: its text, the hashes of its minimizer and, two, of its words, its first window and number of windows.

    The texts are read as one, as a hash of words does not depend on where
    they are; windows over the end of a text are left out.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    which = np.flatnonzero(sizes >= window)
    if not len(which):
        return None
    hasher.read(list(chain.from_iterable(texts[i] for i in which.tolist())))
    sizes = sizes[which]
    begin = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum() - k + 1)
    mers = hasher(at, at + k)
    windows = np.arange((sizes - window + 1).sum()) + np.repeat(np.arange(len(sizes)) * (window - 1), sizes - window + 1)
    low = _lowest(mers, window - k + 1)[windows]
    heads = np.append(0, np.flatnonzero(np.diff(low)) + 1)
    count = np.diff(np.append(heads, len(low)))
    first = windows[heads]
    ends = first + count - 1 + window
    text = np.searchsorted(begin, first, "right") - 1
    return which[text], mers[low[heads]], hasher(first, ends), hasher.check(first, ends), first - begin[text], count


def _find_paths(window: int, k: int):
    def find(batches):
        hasher = Hasher()
        for batch in batches:
            for part in _parts(batch):
                found = _paths(hasher, _words(part.column(2)), window, k)
                if found is None:
                    continue
                # What a text repeats is one row.
                order = np.lexsort(found[3::-1])
                text, mer, path, check, first, count = (c[order] for c in found)
                fresh = np.append(True, np.any([c[1:] != c[:-1] for c in (text, mer, path, check)], axis=0))
                heads = np.flatnonzero(fresh)
                starts = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype(np.int32)), pa.array(first.astype(np.int32)))
                take = pa.array(text[heads])
                hashes = [pa.array(x[heads]) for x in (mer, path, check)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *hashes, starts, pa.array(count[heads].astype(np.int32))],
                    ["doc_id", "text_hash", "mer", "path", "check", "starts", "n"],
                )

    return find


def _find_segments(window: int):
    """Of each super-k-mer that is told, its edges, or all of it if it stands alone: hashes of words and of both nodes, and its place."""

    def find(batches):
        hasher = Hasher()
        for batch in batches:
            for part in _parts(batch):
                texts = _words(part.column(2))
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                begin = np.cumsum(sizes) - sizes
                hasher.read(list(chain.from_iterable(texts)))
                told, many_told = part.column(3).flatten(), np.diff(part.column(3).offsets.to_numpy())
                text = np.repeat(np.arange(len(texts)), many_told)
                first, n, split = (told.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "branch"))
                many = np.where(split, n, 1)
                which = np.repeat(np.arange(len(told)), many)
                rel = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                start = first[which] + rel
                size = np.where(split, 1, n)[which]
                at = start + begin[text[which]]
                ends = at + size - 1 + window
                row, take = pa.array(text[which]), pa.array(which)
                named = {c: told.field(c).take(take) for c in ("mer", "path", "check", "again", "branch")}
                hashes = [hasher(at, ends), hasher.check(at, ends), hasher(at, at + window - 1), hasher(ends - window + 1, ends)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row), *named.values(), *map(pa.array, hashes), pa.array(rel.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["doc_id", "text_hash", *named, "seg", "sure", "left", "right", "rel", "start", "size"],
                )

    return find


def _cut(window: int):
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("sha", T.StringType())])

    def cut(texts: pa.Array, spans: pa.Array, with_text: bool) -> pa.Array:
        out = []
        for text, found in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist()):
            words = (text or b"").split()
            kept, removed = words, 0
            if found:
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, found[::2], 1)
                np.add.at(depth, found[1::2], -1)
                gone = np.cumsum(depth[:-1]) > 0
                removed = int(gone.sum())
                kept = [w for w, g in zip(words, gone) if not g]
            joined = b" ".join(kept)
            out.append((len(words), removed, joined if with_text else None, hashlib.sha256(joined).hexdigest()))
        return pa.StructArray.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.string()))], [f.name for f in kind])

    return kind, cut


def _merged(found: list[dict], window: int) -> list[int]:
    """Begins and ends, in turn, of the words that runs of ``n`` windows from each of ``starts`` cover, joined where they touch."""
    pairs = np.array(sorted((a, a + f["n"] - 1 + window) for f in found for a in f["starts"]))
    ends = np.maximum.accumulate(pairs[:, 1])
    fresh = np.append(True, pairs[1:, 0] > ends[:-1])
    return np.stack([pairs[fresh, 0], ends[np.append(fresh[1:], True)]], axis=1).ravel().tolist()


def compacted(segments: DataFrame) -> DataFrame:
    """(seg, sure, head, offset): distinct segments (seg, sure, left, right, size) numbered along paths without branches.

    Two segments are joined where they are the only ones to end and to begin
    at a node. ``head`` is the first segment of the path, ``offset`` the
    windows before this one; each doubling joins twice as far. A ring of
    segments has no first one: its segments stay paths of their own.
    """
    # Keys and what is aggregated are plain numbers: groups are hashed and joins sort by a number, which structs would not allow.
    into = segments.groupBy(F.col("right").alias("node")).agg(F.count("*").alias("n"), F.first("seg").alias("up_seg"), F.first("sure").alias("up_sure"), F.first("size").alias("before"))
    out = segments.groupBy(F.col("left").alias("node")).agg(F.count("*").alias("m"), F.first("seg").alias("seg"), F.first("sure").alias("sure"))
    links = into.where("n = 1").join(out.where("m = 1"), "node").select("seg", "sure", "up_seg", "up_sure", F.col("before").cast("long").alias("dist"))
    state = materialize(links, "links")
    closed, left = [], None
    while True:
        # Open are those whose way up has not come to a segment without a link; closed ones are written once.
        known = reduce(DataFrame.unionByName, [*closed, state])
        far = known.select(F.col("seg").alias("up_seg"), F.col("sure").alias("up_sure"), F.col("up_seg").alias("next_seg"), F.col("up_sure").alias("next_sure"), F.col("dist").alias("more"))
        done = state.join(far, ["up_seg", "up_sure"], "left").select(
            "seg",
            "sure",
            F.coalesce("next_seg", "up_seg").alias("up_seg"),
            F.coalesce("next_sure", "up_sure").alias("up_sure"),
            (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"),
            F.col("next_seg").isNotNull().alias("open"),
        )
        fresh = materialize(done, "doubled")
        closed.append(fresh.where("NOT open").drop("open"))
        state = fresh.where("open").drop("open")
        still = state.count()
        if not still or still == left:  # those left lie on rings
            break
        left = still
    heads = reduce(DataFrame.unionByName, closed).withColumnRenamed("dist", "offset")
    both = segments.select("seg", "sure").join(heads, ["seg", "sure"], "left")
    head = F.struct(F.coalesce("up_seg", "seg").alias("seg"), F.coalesce("up_sure", "sure").alias("sure"))
    return both.select("seg", "sure", head.alias("head"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))


def path_occurrences(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, text_hash, head, from, starts, n): pieces of compacted paths, ``n`` windows from the ``from``-th on, and where they start in a text (word numbers)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.col("text").isNotNull())
    key, same_path = ["doc_id", "text_hash"], ["mer", "path", "check"]
    paths = texts.mapInArrow(_find_paths(window, k), _schema(docs, "text_hash long, mer long, path long, check long, starts array<int>, n int"))
    paths = materialize(paths, "paths")
    # Each distinct super-k-mer once; which come again as they are, which share a minimizer with another.
    distinct = paths.groupBy(*same_path).agg(F.sum(F.size("starts")).alias("times"))
    several = distinct.groupBy("mer").agg(F.count("*").alias("ways"), F.max("times").alias("most")).where("ways > 1 OR most > 1")
    state = distinct.join(several, "mer").select(*same_path, (F.col("times") > 1).alias("again"), (F.col("ways") > 1).alias("branch"))
    met = materialize(paths.join(state, same_path), "met")
    discard(paths)
    # One copy stands for all that come again as they are.
    first = met.select(*key, F.get("starts", F.lit(0)).alias("start"), "n", *same_path, "again", "branch")
    told = first.where("again").dropDuplicates(same_path).unionByName(first.where("NOT again"))
    told = told.groupBy(*key).agg(F.collect_list(F.struct("start", "n", *same_path, "again", "branch")).alias("told"))
    told = materialize(told, "told").withColumnsRenamed({"doc_id": "_id", "text_hash": "_h"})
    same = texts["doc_id"].eqNullSafe(told["_id"]) & (texts["text_hash"] == told["_h"])
    looked = texts.join(maybe_broadcast(told, TOLD_ROWS, "told", TOLD_ITEMS), same).select("doc_id", "text_hash", "text", "told").dropDuplicates(key)
    found = looked.mapInArrow(_find_segments(window), _schema(docs, "text_hash long, mer long, path long, check long, again boolean, branch boolean, seg long, sure long, left long, right long, rel int, start int, size int"))
    found = materialize(found, "segments")
    # Repeated: of a row that comes again, or in two rows of one minimizer.
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("path", "check")]
    by_seg = found.groupBy("mer", "seg", "sure").agg(*ends, F.bool_or("again").alias("again"), *(F.first(c).alias(c) for c in ("left", "right", "size")))
    several = "again OR min_path <> max_path OR min_check <> max_check"
    segments = materialize(by_seg.where(several).select("seg", "sure", "left", "right", "size"), "repeated")
    where = materialize(compacted(segments), "compacted")
    named = found.join(where, ["seg", "sure"])
    piece = named.select(*key, *same_path, "again", "head", "start", "rel", "size", "offset")
    # Rows that come again: their pieces once, then at every start; the others where they are.
    pieces = piece.where("again").groupBy(*same_path, "head", (F.col("rel") - F.col("offset")).alias("diag")).agg(F.array_sort(F.collect_list(F.struct("rel", "size"))).alias("runs"))
    pieces = pieces.select(*same_path, "head", F.explode(_runs("runs")).alias("r"), "diag").select(*same_path, "head", "r.at", "r.n", (F.col("r.at") - F.col("diag")).alias("from"))
    again = met.where("again").drop("n").join(pieces, same_path).select(*key, "head", "from", F.transform("starts", lambda x: x + F.col("at")).alias("starts"), "n")
    single = piece.where("NOT again").groupBy(*key, "head", (F.col("start") - F.col("offset")).alias("diag")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("rel"), "size"))).alias("runs"))
    single = single.select(*key, "head", F.explode(_runs("runs")).alias("r"), "diag")
    single = single.select(*key, "head", (F.col("r.at") - F.col("diag")).alias("from"), F.array("r.at").alias("starts"), F.col("r.n").alias("n"))
    return again.unionByName(single)


def _runs(column: str):
    """Sorted (rel, size) that follow each other without a gap, as (at, n)."""

    def step(a, x):
        last = F.try_element_at(a, F.lit(-1))
        joined = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["at"].alias("at"), (last["n"] + x["size"]).alias("n"))))
        alone = F.concat(a, F.array(F.struct(x["rel"].alias("at"), x["size"].alias("n"))))
        return F.when((F.size(a) > 0) & (last["at"] + last["n"] == x["rel"]), joined).otherwise(alone)

    return F.aggregate(column, F.array().cast("array<struct<at:int,n:int>>"), step)


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, text_hash, spans): of each text with a window that also starts elsewhere, begins and ends, in turn, of the words that such windows cover."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def merged(found: pa.Array) -> pa.Array:
        return pa.array([_merged(f, window) for f in found.to_pylist()], pa.list_(pa.int32()))

    found = path_occurrences(docs, window, k).groupBy("doc_id", "text_hash")
    return found.agg(F.collect_list(F.struct("starts", "n")).alias("runs")).select("doc_id", "text_hash", merged("runs").alias("spans"))


def _schema(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {rest}"


@apart("doc_id", "text")
def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, with_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Defined results: null texts have no words; texts under ``window`` words
    keep all; documents that repeat, even with the same id, are copies of each
    other; an empty table gives an empty table; input columns named like an
    output are replaced.
    """
    kept = without(docs, "n_words", "n_removed", "kept_sha256", "kept_text", "_hash", "_cut", "_spans", "_id", "_h").withColumn("_hash", F.xxhash64("text"))
    spans = materialize(repeated_spans(docs, window, k), "spans").withColumnsRenamed({"doc_id": "_id", "text_hash": "_h", "spans": "_spans"})
    kind, cut = _cut(window)

    @F.arrow_udf(kind)
    def cutting(texts: pa.Array, found: pa.Array) -> pa.Array:
        return cut(texts, found, with_text)

    same = kept["doc_id"].eqNullSafe(spans["_id"]) & (kept["_hash"] == spans["_h"])
    out = kept.join(maybe_broadcast(spans, SPAN_ROWS, "_spans", SPAN_ITEMS), same, "left").withColumn("_cut", cutting("text", "_spans"))
    named = {"n_words": F.col("_cut.n_words"), "n_removed": F.col("_cut.n_removed"), "kept_sha256": F.col("_cut.sha")}
    if with_text:
        named["kept_text"] = F.decode("_cut.kept", "UTF-8")
    return out.withColumns(named).drop("_cut", "_hash", "_id", "_h", "_spans")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT id, p, md5(array_to_string(w[p + 1 : p + 35], ' ')) AS h FROM (SELECT id, w, unnest(range(0, len(w) - 34)) AS p FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT id, unnest(range(p, p + 35)) AS x FROM win SEMI JOIN rep USING (h)),
left_over AS (SELECT id, string_agg(t, ' ' ORDER BY x) AS kept, count(*) AS n FROM (SELECT id, unnest(w) AS t, unnest(range(0, len(w))) AS x FROM d) ANTI JOIN gone USING (id, x) GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (id)
"""
