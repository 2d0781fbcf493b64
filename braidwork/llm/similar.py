"""Near-duplicates by shingle similarity: Jaccard of five-word shingles of 0.8 or more.

Texts with equal sets of shingles are one node. SimHash comes first: the sets'
64-bit fingerprints are compared bit-sliced, as in ``simhash``, and those at
radius 2 or less are candidates. A pair at similarity 0.8 differs in about 10
bits, so what these links leave apart goes on: sets whose MinHash agrees on
all rows of some band meet; at similarity 0.8 a pair is missed by all bands
with probability (1 - 0.8 ** ROWS) ** BANDS = 2.7e-5, less above. Meetings are
cut into cells of bounded size; in a cell, parity bits of the sets bound how
many shingles two of them can share, and pairs that cannot be similar enough
go no further. A first round takes only a spanning forest of what is left, so
that a large group of copies gives about one pair a member; the second round
takes all pairs that the first left in different groups. Every link is
confirmed on the sets themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialize, maybe_broadcast
from .simhash import components, hashes_print, links, mark_first, only_kept, shingle_hashes

SHINGLE = 5
LEAST = 0.8
BANDS = 20
ROWS = 4
#: Parity bits of a set, and members of a cell, about.
BITS = 1024
CELL = 4096


def _minima(h: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    return np.min([(h[at : at + 1024, None] * mul + add).min(axis=0) for at in range(0, len(h), 1024)], axis=0)


def sketches(text, shingle: int = SHINGLE):
    """Struct of the key of a text's set of shingles, its size n, its SimHash sim, its parity bits and its bands (none without words)."""

    @F.arrow_udf("struct<fp:long,n:long,sim:long,bits:binary,bands:array<long>>")
    def sketch(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest

        rng = np.random.default_rng(11)
        mul = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
        keys, sizes, sims, bits, bands = [], [], [], [], []
        for t in texts.cast(pa.binary()):
            h = np.unique(shingle_hashes(t.as_py(), shingle, xxh64_intdigest))
            keys.append(xxh64_intdigest(h.tobytes(), 1))
            sizes.append(len(h))
            sims.append(hashes_print(h))
            bits.append(np.packbits(np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes())
            low = _minima(h, mul, add).reshape(BANDS, ROWS) if len(h) else ()
            bands.append(np.array([xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low)], np.uint64).view(np.int64))
        keys = np.array(keys, np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(keys), pa.array(sizes, pa.int64()), pa.array(sims, pa.int64()), pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["fp", "n", "sim", "bits", "bands"])

    return sketch(text)


def shingle_sets(text, shingle: int = SHINGLE):
    """The sorted distinct hashes of a text's shingles, as bytes."""

    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest

        return pa.array([np.unique(shingle_hashes(t.as_py(), shingle, xxh64_intdigest)).tobytes() for t in texts.cast(pa.binary())], pa.binary())

    return sets(text)


def _confirm(least: float):
    def confirm(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def candidates(fp: np.ndarray, n: np.ndarray, bits: np.ndarray, root: np.ndarray, side: np.ndarray, least: float, forest: bool) -> list[tuple[int, int]]:
    """Pairs of a cell that may be ``least`` similar and have different roots; of a ``forest``, as many as span what they connect.

    Where parity bits differ, one set has a shingle that the other lacks: of
    n and m shingles with d such bits at most (n + m - d) / 2 are shared.
    Members of different sides are compared, or all of them if there is one.
    """
    order = np.argsort(fp)
    fp, n, bits, root, side = (x[order] for x in (fp, n, bits, root, side))
    one = (side == side[0]).all()
    comp, out = np.arange(len(fp)), []
    for a in range(0, len(fp), 64):
        rows = slice(a, a + 64)
        far = np.bitwise_count(bits[rows, None, :] ^ bits[None, a:, :]).sum(axis=2, dtype=np.int64)
        both = n[rows, None] + n[None, a:]
        fits = ((both - far) * (1 + least) / 2 >= least * both - 1e-9) & (root[rows, None] != root[None, a:])
        if not one:
            fits &= side[rows, None] != side[None, a:]
        for i in range(len(fits)):
            later = np.flatnonzero(fits[i, i + 1 :]) + a + i + 1
            if forest and len(later):
                at = comp[later]
                fresh, first = np.unique(at, return_index=True)
                new = fresh != comp[a + i]
                later = later[first[new]]
                if new.any():
                    comp[np.isin(comp, fresh)] = comp[a + i]
            out += [(int(fp[a + i]), int(fp[j])) for j in later]
    return out


def _compare(least: float, forest: bool):
    def compare(batches):
        """Whole cells (runs of equal ``cell``); a cell may span batches."""
        held, key = [], None

        def flush():
            parts = [np.concatenate([h[k] for h in held]) for k in range(5)]
            found = candidates(parts[0], parts[1], parts[2], parts[3], parts[4], least, forest) if len(parts[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            cells, fp, n, root, side = (batch.column(c).to_numpy() for c in ("cell", "fp", "n", "root", "side"))
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(batch), -1)
            starts = np.append(0, np.flatnonzero(np.diff(cells)) + 1)
            for a, b in zip(starts, np.append(starts[1:], len(cells))):
                if cells[a] != key and held:
                    if sum(len(h[0]) for h in held) > 1:
                        yield flush()
                    held = []
                key = cells[a]
                held.append((fp[a:b], n[a:b], bits[a:b], root[a:b], side[a:b]))
        if held:
            yield flush()

    return compare


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of ``nodes`` (fp, sim) that span those whose SimHash differs in at most 2 bits, directly or by others."""
    first = materialize(nodes.groupBy("sim").agg(F.min("fp").alias("first"), F.count("*").alias("c")), "prints")
    equal = nodes.join(first.where("c > 1"), "sim").where("fp != first").select(F.col("first").alias("x"), F.col("fp").alias("y"))
    near = links(first.select(F.col("sim").alias("fp")))
    near = near.join(first.select(F.col("sim").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("sim").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    return equal.unionByName(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_links(nodes: DataFrame, texts: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) of all linked ``nodes`` (fp, n, sim, bits, bands, text_hash), whose ``texts`` (text, text_hash) may repeat."""
    met = nodes.select("fp", F.explode("bands").alias("meeting"))
    several = met.groupBy("meeting").agg(F.count("*").alias("c")).where("c > 1")
    # A larger meeting is dealt into parts; every two of them, and each by itself, are a cell.
    parts = F.ceil(F.col("c") / CELL).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = met.join(several.select("meeting", parts.alias("parts")), "meeting").withColumn("side", part)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("meeting", F.least("side", "other"), F.greatest("side", "other"))
    cells = materialize(dealt.select("fp", "side", cell.alias("cell")), "cells")
    members = materialize(nodes.join(cells.select("fp").distinct(), "fp").select("fp", "n", "bits", "text_hash"), "members")
    known_links = roots = before = None
    for forest in (None, True, False):  # by SimHash, a forest of the cells, what is left of them
        if forest is None:
            pairs = print_pairs(nodes.select("fp", "sim"))
        else:
            known = members.join(roots, members["fp"] == roots["node"], "left").select("fp", "n", "bits", F.coalesce("root", "fp").alias("root"))
            placed = cells.join(known, "fp").repartition("cell").sortWithinPartitions("cell", "fp")
            pairs = placed.mapInArrow(_compare(least, forest), "a long, b long").distinct().join(before, ["a", "b"], "left_anti")
        tested = materialize(pairs, "pairs")
        before = tested if before is None else before.unionByName(tested)
        # Only texts of a pair are read again.
        asked = tested.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        wanted = materialize(nodes.select("fp", "text_hash").join(asked, "fp"), "wanted")
        found = texts.join(maybe_broadcast(wanted, BROADCAST_ROWS), "text_hash").groupBy("fp").agg(F.min("text").alias("text"))
        sets = materialize(found.select("fp", shingle_sets(F.col("text"), shingle).alias("set")), "sets")
        both = tested.join(sets.withColumnsRenamed({"fp": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"fp": "b", "set": "y"}), "b")
        fresh = materialize(both.select("a", "b", "x", "y").mapInArrow(_confirm(least), "a long, b long"), "links")
        discard(sets, wanted)
        known_links = fresh if known_links is None else known_links.unionByName(fresh)
        roots = materialize(components(known_links), "roots")
    return roots


def near_duplicates(docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keep), as ``simhash.near_duplicates`` defines them, by shingle similarity; fp is the key of the set of shingles."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketches(F.col("text"), shingle).alias("s"))
    rows = materialize(rows.select("doc_id", "text_hash", "s.*"), "sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    nodes = materialize(rows.groupBy("fp").agg(best, F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bits").alias("bits"), F.first("bands").alias("bands")), "nodes")
    texts = docs.select("text", F.xxhash64("text").alias("text_hash"))
    roots = similar_links(nodes.select("fp", "n", "sim", "bits", "bands", "best.text_hash"), texts, least, shingle)
    return mark_first(rows.select("doc_id", "text_hash", "fp"), nodes.select("fp", "best"), roots)


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without all but one document of each group of texts whose shingle similarity is ``least`` or more."""
    return only_kept(docs, near_duplicates(docs, least))
