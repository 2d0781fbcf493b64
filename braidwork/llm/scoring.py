"""LM scoring with stupid backoff.

Texts are numbered into blocks: one row holds the documents of a block, the
hashes of its distinct words and the word of each place. A block explodes into
its distinct n-grams with their counts, cut by ranges of their hash: one row a
range. Spark groups the rows of a range, where its part of the count table is
added up and joined with what each block asked; the totals go back to the
blocks by a join on the block, and are summed per document. Words and pairs
are counted first; a longer n-gram is only asked for where both its shorter
ones were counted, and what a round shuffled is gone before the next begins.

Rows hold arrays, as rows of single n-grams need over twice the disk and CPU
(figures in the README). There are never more rows than n-grams: a range that
a block has nothing of gets no row. An n-gram is told by 64 bits of hash: of
10**13 distinct ones, fewer than one in a million shares its hash with another.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
BLOCK_BYTES = 4 << 20
#: N-grams of a range of hashes, about, and the orders that are counted without asking for shorter ones first.
BUCKET_GRAMS = 1_000_000
FREE = 2
#: Blocks, or the n-grams of as many, that are read or written at once.
GROUP_BLOCKS = 4
#: Parts of the blocks that meet their totals one after the other.
WAVES = 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _list(values, kind: pa.DataType) -> pa.Array:
    """One row that holds ``values``."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _deal(block_bytes: int):
    """Rows (block, docs, lengths, hashes, ids) of consecutive documents of about ``block_bytes`` of text."""

    def block(number: int, docs: list[pa.Array], texts: list[bytes | None]) -> pa.RecordBatch:
        from xxhash import xxh64_intdigest

        split = [(t or b"").lower().split() for t in texts]
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for words in split for w in words), np.int32)
        hashes = np.fromiter(map(xxh64_intdigest, seen), np.uint64, len(seen)).view(np.int64)
        lists = (_list(pa.concat_arrays(docs), docs[0].type), _list([len(x) for x in split], pa.int32()), _list(hashes, pa.int64()), _list(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([number]), *lists], ["block", "docs", "lengths", "hashes", "ids"])

    def deal(batches):
        number = TaskContext.get().partitionId() << 32
        docs, texts, size = [], [], 0
        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                texts.append(text)
                size += len(text or b"")
                if size >= block_bytes:
                    docs.append(batch.column(0).slice(first, i + 1 - first))
                    yield block(number, docs, texts)
                    docs, texts, size, first, number = [], [], 0, i + 1, number + 1
            if first < len(batch):
                docs.append(batch.column(0).slice(first))
        if texts:
            yield block(number, docs, texts)

    return deal


class _Grams:
    """The n-grams of a block for each n of ``orders``: the distinct hashes, sorted, their counts, and for each word the place (slot) of the n-gram that ends there, or -1."""

    def __init__(self, lengths: np.ndarray, hashes: np.ndarray, ids: np.ndarray, orders: tuple[int, ...]):
        words = hashes.view(np.uint64)[ids]
        self.lengths = lengths
        self.place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.distinct, self.counts, self.at = {}, {}, {}
        gram = words
        for n in range(1, max(orders) + 1):
            if n > 1:
                gram = _mix(np.append(np.uint64(0), gram[:-1])[: len(gram)] * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(n))
            if n in orders:
                whole = self.place >= n - 1
                self.distinct[n], inverse, self.counts[n] = np.unique(gram[whole], return_inverse=True, return_counts=True)
                self.at[n] = np.full(len(gram), -1, np.int32)
                self.at[n][whole] = inverse


def _block(table: pa.Table | pa.RecordBatch, row: int, *orders: int) -> _Grams:
    lengths, hashes, ids = (table.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("lengths", "hashes", "ids"))
    return _Grams(lengths.astype(np.int64), hashes, ids, orders)


_ROWS = "n int, bucket int, block long, grams array<long>, counts array<int>"
_KINDS = pa.schema([("n", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("grams", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, kind))


def _asked(grams: _Grams, block: int, n: int, buckets: int, wanted: np.ndarray | None = None) -> pa.Table:
    """The distinct n-grams of a block, or those ``wanted``, in order of their hash: a row for each range that has any."""
    distinct, counts = grams.distinct[n], grams.counts[n]
    if wanted is not None:
        distinct, counts = distinct[wanted], counts[wanted]
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])
    sizes = np.diff(cuts)
    bucket = np.flatnonzero(sizes)
    columns = [np.full(len(bucket), n, np.int32), bucket.astype(np.int32), np.full(len(bucket), block, np.int64)]
    return pa.table([*columns, _lists(distinct.view(np.int64), sizes[bucket], pa.int64()), _lists(counts.astype(np.int32), sizes[bucket], pa.int32())], schema=_KINDS)


def _ask(orders: list[int], buckets: int):
    def ask(batches):
        for batch in batches:
            for row in range(len(batch)):
                grams = _block(batch, row, *orders)
                for n in orders:
                    yield from _asked(grams, batch.column("block")[row].as_py(), n, buckets).to_batches()

    return ask


def _answer(least: int):
    """Adds up the counts of a range; for each row that came, the totals in its order, 0 for those under ``least`` (words have no least)."""

    def answer(group: pa.Table) -> pa.Table:
        grams, counts = (group.column(c).combine_chunks() for c in ("grams", "counts"))
        sizes = np.diff(grams.offsets.to_numpy())
        distinct, inverse = np.unique(grams.flatten().to_numpy(), return_inverse=True)
        totals = np.bincount(inverse, counts.flatten().to_numpy(), len(distinct)).astype(np.int64)
        if group.column("n")[0].as_py() > 1:
            totals[totals < least] = 0
        return pa.table({"block": group.column("block"), "n": group.column("n"), "bucket": group.column("bucket"), "totals": _lists(totals[inverse], sizes, pa.int64())})

    return answer


def _totals(table: pa.Table, n: int, size: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """A block's totals of order ``n`` by slot, with a 0 at the end for -1."""
    own = sorted((b, t) for o, b, t in zip(table.column("n").to_pylist(), table.column("bucket").to_pylist(), range(len(table))) if o == n)
    lists = table.column("totals")
    out = np.zeros(size + 1, np.int64)
    if own:
        out[np.flatnonzero(wanted) if wanted is not None else slice(0, size)] = np.concatenate([lists[t].values.to_numpy() for _, t in own])
    return out


def _wanted(grams: _Grams, n: int, shorter: np.ndarray) -> np.ndarray:
    """The n-grams of which both shorter ones have a total."""
    has = shorter[grams.at[n - 1]] > 0
    at = grams.at[n]
    wanted = np.zeros(len(grams.distinct[n]), bool)
    wanted[at[has & np.append(False, has[:-1])[: len(has)] & (at >= 0)]] = True
    return wanted


def _counted(grams: _Grams, table: pa.Table, most: int) -> dict[int, np.ndarray]:
    """Totals by slot of the orders up to ``most`` that ``grams`` has."""
    out: dict[int, np.ndarray] = {}
    for n in range(1, most + 1):
        out[n] = _totals(table, n, len(grams.distinct[n]), _wanted(grams, n, out[n - 1]) if n > FREE else None)
    return out


def _ask_again(n: int, buckets: int):
    """Of a block and its totals so far: the n-grams of which both shorter ones have a total."""

    def ask(block: pa.Table, totals: pa.Table) -> pa.Table:
        first = n - 1 if n - 1 <= FREE else 1  # later orders need the ones before
        grams = _block(block, 0, *range(first, n + 1))
        size = len(grams.distinct[n - 1])
        shorter = _totals(totals, n - 1, size) if first == n - 1 else _counted(grams, totals, n - 1)[n - 1]
        return _asked(grams, block.column("block")[0].as_py(), n, buckets, _wanted(grams, n, shorter))

    return ask


def _sum(order: int, words: int, alpha: float):
    def add(block: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _block(block, 0, *range(1, order + 1))
        count = {n: t[grams.at[n]].astype(np.float64) for n, t in _counted(grams, answers, order).items()}
        size = len(grams.place)
        score, found = np.zeros(size), np.zeros(size, bool)
        for n in range(order, 0, -1):
            hit = ~found & (grams.place >= n - 1) & (count[n] > 0)
            context = np.append(0.0, count[n - 1][:-1])[:size] if n > 1 else np.full(size, float(words))
            backed = np.minimum(order - 1, grams.place) - (n - 1)
            score[hit] = np.log(count[n][hit] / context[hit]) + backed[hit] * np.log(alpha)
            found |= hit
        owner = np.repeat(np.arange(len(grams.lengths)), grams.lengths)
        sums = np.bincount(owner, score, len(grams.lengths)) if len(owner) else np.zeros(len(grams.lengths))
        return pa.table({"doc_id": block.column("docs")[0].values, "n_words": pa.array(grams.lengths), "lm_score": pa.array(sums)})

    return add


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, lm_score, mean_score): one row per row of ``docs`` (doc_id, text), scored by counts over all of them.

    Texts have A-Z lower-cased and are split at ASCII white space. A word
    scores log(count of n-gram / count of its context) for the longest n-gram
    that is counted at least ``min_count`` times, plus log(alpha) for each
    shorter step than the document's start allows; a single word scores
    log(count / words of the corpus). lm_score is the sum, mean_score that per
    word. ``block_bytes`` changes the cost, not the results.
    Defined results: null and empty texts have 0 words, score 0 and a null
    mean; repeated rows are counted and scored each on their own; null ids
    stay; an empty table gives an empty table; a very long text is a block of
    its own and takes about 60 bytes of a task's memory per word.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").mapInArrow(_deal(block_bytes), f"block long, docs array<{kind}>, lengths array<int>, hashes array<long>, ids array<int>")
    blocks = materialize(dealt, "blocks", GROUP_BLOCKS)
    words = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0  # the ids are not read
    # What a range of one order holds is bounded; of an n-gram a block has one, so a frequent one is no burden.
    buckets = int(words // BUCKET_GRAMS) + 1
    group_rows = GROUP_BLOCKS * buckets  # a block has a row for each range at most
    reply = "block long, n int, bucket int, totals array<long>"
    waves = [F.pmod(F.xxhash64("block"), F.lit(WAVES)) == w for w in range(WAVES)]
    known = []
    for n in range(min(order, FREE), order + 1):
        if n <= FREE:
            asked = [blocks.mapInArrow(_ask(list(range(1, n + 1)), buckets), _ROWS)]
        else:
            # A wave of blocks at a time meets its totals, so that not all of them are on the way at once.
            so_far = reduce(DataFrame.unionByName, known)
            asked = [materialize(blocks.where(w).groupBy("block").cogroup(so_far.where(w).groupBy("block")).applyInArrow(_ask_again(n, buckets), _ROWS), "asked", group_rows) for w in waves]
        known.append(materialize(reduce(DataFrame.unionByName, asked).groupBy("n", "bucket").applyInArrow(_answer(min_count), reply), "totals", group_rows))
        if n > FREE:
            discard(*asked)
    totals = reduce(DataFrame.unionByName, known)
    summed = f"doc_id {kind}, n_words long, lm_score double"
    scored = [materialize(blocks.where(w).groupBy("block").cogroup(totals.where(w).groupBy("block")).applyInArrow(_sum(order, words, alpha), summed), "scores", large_rows=True) for w in waves]
    discard(blocks, *known)
    scored = reduce(DataFrame.unionByName, scored)
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("lm_score") / F.col("n_words")))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("lm_score", 4).alias("lm_score"), F.round("mean_score", 6).alias("mean_score"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
g AS (SELECT id, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3,
  CASE WHEN i > 1 THEN w[i - 1] END AS x1, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS x2 FROM t),
n1 AS (SELECT g1, count(*) AS c FROM g GROUP BY g1), n2 AS (SELECT g2, count(*) AS c FROM g WHERE g2 IS NOT NULL GROUP BY g2), n3 AS (SELECT g3, count(*) AS c FROM g WHERE g3 IS NOT NULL GROUP BY g3),
s AS (SELECT g.id, CASE WHEN n3.c >= 2 THEN ln(n3.c::DOUBLE / y2.c)
   WHEN n2.c >= 2 THEN ln(n2.c::DOUBLE / y1.c) + (least(2, i - 1) - 1) * ln(0.4::DOUBLE)
   ELSE ln(n1.c::DOUBLE / (SELECT count(*) FROM g)) + least(2, i - 1) * ln(0.4::DOUBLE) END AS s
  FROM g JOIN n1 USING (g1) LEFT JOIN n2 USING (g2) LEFT JOIN n3 USING (g3) LEFT JOIN n1 y1 ON g.x1 = y1.g1 LEFT JOIN n2 y2 ON g.x2 = y2.g2),
a AS (SELECT id, sum(s) AS score FROM s GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(score, 0), 4) AS lm_score, round(CASE WHEN len(w) > 0 THEN score / len(w) END, 6) AS mean_score
FROM d LEFT JOIN a USING (id)
"""
