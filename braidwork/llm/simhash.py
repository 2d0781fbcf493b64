"""SimHash near-duplicates with bit-sliced comparison.

Whole texts become 64-bit fingerprints. Two fingerprints at ``radius`` 2 or
less agree on at least three of five blocks of bits, so equal values of some
three blocks (ten choices, 38 to 39 bits each) meet every pair. Where more
than ``HOT`` distinct fingerprints meet, the other bits are cut in three and
one part must agree too, which splits the meeting again. Fingerprints that
meet are compared with their bits stored as vertical planes: carry-save
counters add up many distances at once, and words of 64 candidates are
abandoned when all exceed the radius. Each meeting gives a spanning forest of
links, never all pairs; groups are their connected components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, without

RADIUS = 2
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
HOT = 4096
#: Fingerprints compared at once.
TILE = 512


def shingle_hashes(text: bytes | None, shingle: int, xx) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` lower-cased words, of the whole text if it has fewer; empty without words."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xx(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - shingle + 1].tolist()
    return np.array([xx(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def hashes_print(h: np.ndarray) -> int:
    """The fingerprint of hashes: bit i is set if over half of them have it; 0 without any."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(h)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def _fingerprint(text: bytes | None, shingle: int, xx) -> int:
    return hashes_print(shingle_hashes(text, shingle, xx))


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The SimHash of a text as a long: bit i is set if over half of the hashes (XXH64, seed 42) of its word shingles have it; 0 without words."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest

        return pa.array([_fingerprint(t.as_py(), shingle, xxh64_intdigest) for t in texts.cast(pa.binary())], pa.int64())

    return prints(text)


def planes(tile: np.ndarray) -> np.ndarray:
    """Vertical planes: row b holds bit b of all fingerprints of the tile, 64 to a word."""
    padded = np.zeros((-(-len(tile) // 64) * 64, 64), np.uint8)
    padded[: len(tile)] = np.unpackbits(tile.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, sliced: np.ndarray, n: int, radius: int) -> np.ndarray:
    """For each query, a row of words whose bits tell which of the ``n`` fingerprints in the planes are within ``radius`` (at most 2).

    ``ones`` and ``twos`` count differences up to three, ``far`` keeps those
    beyond; words whose 64 candidates are all beyond are abandoned.
    """
    if radius not in (0, 1, 2):
        raise ValueError(f"radius {radius}: the counters tell 0, 1 and 2 only")
    words = sliced.shape[1]
    full, none = np.uint64(2**64 - 1), np.uint64(0)
    flip = np.where(np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), full, none)
    row, col = (x.ravel() for x in np.indices((len(queries), words)))
    ones, twos, far = (np.zeros(len(row), np.uint64) for _ in range(3))
    for b in range(64):
        differs = sliced[b][col] ^ flip[row, b]
        carry = ones & differs
        ones ^= differs
        far |= twos & carry
        twos ^= carry
        if b % 8 == 7:
            beyond = far | (twos & ones) if radius == 2 else far | twos | (none if radius else ones)
            alive = beyond != full
            if not alive.all():
                row, col, ones, twos, far, beyond = (x[alive] for x in (row, col, ones, twos, far, beyond))
    out = np.zeros((len(queries), words), np.uint64)
    out[row, col] = ~beyond
    if n % 64:
        out[:, -1] &= np.uint64((1 << (n % 64)) - 1)
    return out


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, smaller fingerprint) links that span each component of ``prints``."""
    prints = np.unique(prints)
    parent = np.arange(len(prints))

    def roots(x):
        while not np.array_equal(up := parent[x], x):
            x = up
        return x

    for lo in range(0, len(prints), 32 * TILE):
        tile = prints[lo : lo + 32 * TILE]
        sliced = planes(tile)
        for at in range(0, len(prints), 64):
            lanes = np.unpackbits(near(prints[at : at + 64], sliced, len(tile), radius).view(np.uint8), axis=1, bitorder="little")
            for i in np.flatnonzero(lanes.sum(axis=1) > (lo <= at < lo + 32 * TILE)):
                ends = np.unique(roots(np.append(np.flatnonzero(lanes[i]) + lo, at + i)))
                parent[ends] = ends[0]
    top = roots(np.arange(len(prints)))
    return [(int(prints[i]), int(prints[r])) for i, r in enumerate(top) if i != r]


def _links(radius: int):
    def links(batches):
        """Whole meetings (runs of equal ``meeting``) gathered into tiles; a meeting may span batches."""
        held, key = [], None

        def flush(values):
            found = forest(np.concatenate(values), radius) if values else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        size = 0
        for batch in batches:
            keys, prints = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for part, first in zip(np.split(prints, cuts), keys[np.append(0, cuts)]):
                if first != key and size + len(part) > TILE:
                    yield flush(held)
                    held, size = [], 0
                held.append(part)
                size += len(part)
                key = first
        yield flush(held)

    return links


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that span all components at ``radius`` (0 to 2)."""
    if radius not in range(RADIUS + 1):
        raise ValueError(f"radius {radius}: the blocks meet pairs up to {RADIUS} only")
    masks = [sum(((1 << hi) - (1 << lo)) for lo, hi in blocks) for blocks in combinations(BLOCKS, len(BLOCKS) - RADIUS)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rest = []
    for m in masks:
        free = [b for b in range(64) if not m >> b & 1]
        rest.append([signed(m | sum(1 << b for b in free[k::3])) for k in range(3)])
    by_choice = lambda values: F.array(*[F.lit(v) for v in values])
    met = prints.select("fp", F.posexplode(F.transform(by_choice([signed(m) for m in masks]), lambda m: F.col("fp").bitwiseAND(m))).alias("choice", "part"))
    sizes = met.groupBy("choice", "part").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    met = met.join(sizes, ["choice", "part"])
    finer = F.array(*[by_choice(r) for r in rest])
    split = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.xxhash64("choice", k, F.col("fp").bitwiseAND(F.get(F.get(finer, F.col("choice")), k))))
    whole = F.array(F.xxhash64("choice", F.lit(-1), "part"))
    # Equal hashes of different meetings only bring together more fingerprints than needed.
    met = met.select(F.explode(F.when(F.col("n") > HOT, split).otherwise(whole)).alias("meeting"), "fp")
    return met.repartition("meeting").sortWithinPartitions("meeting", "fp").mapInArrow(_links(radius), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b), where root is the smallest node reachable.

    Alternates large-star and small-star steps, each a shuffled join on nodes,
    until no link changes; every step is written to the shared folder.
    """
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = sign(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(star.select("e.a", "e.b").where("a != b").distinct(), name)
        now = sign(edges)
        if tuple(now) == tuple(last):
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keep): one row per row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id of the group; keep marks one document
    of each group, the one with that id (repeated rows of it are all marked).
    Defined results: texts without words, null ones too, share fingerprint 0;
    null ids are never the smallest if the group has others, and a group of
    null ids has a null component_id; an empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text"), shingle).alias("fp"))
    rows = materialize(rows, "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    nodes = rows.groupBy("fp").agg(best)
    roots = components(links(nodes.select("fp"), radius))
    return mark_first(rows, nodes, roots)


def mark_first(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_hash, fp) with component_id and keep, from ``nodes`` (fp, best) and the ``roots`` (node, root) of linked ones."""
    groups = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    firsts = groups.groupBy("root").agg(F.min("best").alias("first"))
    by_print = groups.select("fp", "root").join(firsts, "root").select("fp", "first")
    return rows.join(by_print, "fp").select(
        "doc_id",
        "text_hash",
        "fp",
        F.col("first.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("keep"),
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without all but one document of each group of near-duplicates."""
    return only_kept(docs, near_duplicates(docs, radius))


def only_kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found`` (doc_id, text_hash, keep) keeps, repeated ones once."""
    kept = materialize(found.where("keep").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "kept")
    kept = kept.withColumnsRenamed({"doc_id": "_id", "text_hash": "_h"})
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_h"])
    out = docs.join(kept.where("n = 1"), same, "left_semi")
    if kept.where("n > 1").limit(1).count():  # rows that repeat an id and a text
        out = out.unionByName(docs.join(kept.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(without(table(spark, sf_dir, "documents").select("doc_id", "text"), "fp"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
