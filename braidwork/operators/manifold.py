"""Coordinates that keep neighbours together: Laplacian eigenmaps of a neighbour graph.

Nodes are vectors, edges lead to the exact nearest of each, both ways. The
coordinates are the smoothest functions on the graph: those that averaging
over neighbours changes least. A block of functions is averaged again and
again by joins with the edges, in Chebyshev combinations that bring out the smooth
ones, and made orthogonal by its Gram matrix, a few dozen sums; vectors never
reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.sources.shared import discard, written

from .similarity import search

#: Functions beyond those asked for, which make the block settle faster.
SPARE = 4
DEGREE = 6
ROUNDS = 12
SETTLED = 1e-4


def neighbour_graph(vectors: DataFrame, k: int = 10, measure: str = "cosine") -> DataFrame:
    """(i, j): each vector of ``vectors`` (id, v) with its ``k`` nearest, in both directions, each pair once a direction."""
    near = search(vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q")), vectors, k, measure)
    one = near.select(F.col("query_id").alias("i"), F.col("id").alias("j"))
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def _averaged(edges: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """``state`` (id, columns) with each of ``names`` replaced by half itself and half the mean over neighbours; the old values stay as "was_<name>"."""
    # SQL text, as columns made one operation at a time took the driver longer than small graphs take the tasks.
    far = state.selectExpr("id AS j", *names)
    mean = edges.join(far, "j").groupBy("i").agg(*[F.expr(f"avg({n}) AS mean_{n}") for n in names]).withColumnRenamed("i", "id")
    own = [f"({n} + mean_{n}) / 2 AS {n}" for n in names]
    rest = [c for c in state.columns if c not in names and c != "id" and not c.startswith("was_")]
    return state.join(mean, "id").selectExpr("id", *rest, *own, *[f"{n} AS was_{n}" for n in names])


def _gram(rows: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Sums of products of columns, weighted by degree."""
    (r,) = rows.selectExpr(*[f"sum(degree * {a} * {b})" for a in left for b in right]).collect()
    return np.array(list(r), float).reshape(len(left), len(right))


def _mixed(names: list[str], by: np.ndarray) -> list[str]:
    """Columns times a small matrix, as SQL."""
    terms = lambda c: " + ".join(["0D", *(f"{n} * {float(by[r, c])!r}D" for r, n in enumerate(names))])
    return [f"{terms(c)} AS {names[c]}" for c in range(by.shape[1])]


def eigenmap(edges: DataFrame, dims: int = 2, rounds: int = ROUNDS, settled: float = SETTLED, seed: int = 3) -> tuple[DataFrame, list[float]]:
    """((id, x0, x1, ...), eigenvalues) of a graph (i, j) with both directions of each edge.

    The eigenvalues are those of averaging, half with neighbours and half with
    itself, without the constant function: falling from 1, which stands for
    parts of the graph that nothing joins. Of each coordinate the value
    largest in size is positive (ties: that of the smallest id). Rounds end when
    no eigenvalue changes by more than ``settled``; if they have not after
    ``rounds``, that is an error.
    """
    edges = written(edges, "edges")
    wide = dims + 1 + SPARE
    names = [f"x{n}" for n in range(wide)]
    start = [F.lit(1.0).alias(names[0])] + [(F.pmod(F.xxhash64("i", F.lit(seed), F.lit(n)), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1).alias(names[n]) for n in range(1, wide)]
    degree = edges.groupBy("i").agg(F.count("*").cast("double").alias("degree"))
    state = written(degree.select(F.col("i").alias("id"), "degree", *start), "functions")
    before, cut = None, 0.5
    for _ in range(rounds):
        # Chebyshev polynomials are small on [0, cut] and grow fast beyond it.
        scale, shift = 2 / cut, -1.0
        now = state.selectExpr("id", "degree", *names, *[f"0D AS old_{n}" for n in names])
        for step in range(DEGREE):
            once = _averaged(edges, now, names)
            factor = 1.0 if step == 0 else 2.0
            new = [f"{factor!r}D * ({n} * {scale!r}D + was_{n} * {shift!r}D) - old_{n} AS {n}" for n in names]
            now = once.selectExpr("id", "degree", *new, *[f"was_{n} AS old_{n}" for n in names])
            if step % 3 == 2 or step == DEGREE - 1:
                fresh = written(now, "functions")
                if step > 2:
                    discard(held)
                held = now = fresh
        # Orthogonal by the eigenvectors of the Gram matrix, then turned to the directions that averaging keeps.
        basis = _gram(now, names, names)
        sizes = np.sqrt(np.maximum(np.diag(basis), 1e-300))
        values, turn = np.linalg.eigh(basis / np.outer(sizes, sizes))
        good = values > 1e-12 * values.max()
        by = turn[:, good] / np.sqrt(values[good]) / sizes[:, None]
        both = written(_averaged(edges, now.select("id", "degree", *names), names), "averaged")
        was = [f"was_{n}" for n in names]
        inner = by.T @ _gram(both, was, names) @ by
        ritz, vectors = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-ritz)
        by = by @ vectors[:, order]
        ritz = ritz[order]
        full = np.zeros((wide, wide))
        full[:, : by.shape[1]] = by
        plain = both.selectExpr("id", "degree", *[f"was_{n} AS {n}" for n in names])
        fresh = written(plain.selectExpr("id", "degree", *_mixed(names, full)), "functions")
        discard(state, both, held)
        state = fresh
        own = ritz[1 : dims + 1]
        if before is not None and len(before) == len(own) and np.abs(own - before).max(initial=0) <= settled or by.shape[1] < wide:
            break
        before, cut = own, float(np.clip(ritz[-1], 0.1, 0.999))
    else:
        raise RuntimeError(f"the coordinates have not settled after {rounds} rounds: {before} and {own}")
    coordinates = [n for n in names[1 : dims + 1]]
    largest = state.agg(*[F.max_by(n, F.struct(F.abs(F.col(n)), -F.col("id"))).alias(n) for n in coordinates]).first()
    signs = [F.lit(-1.0 if (largest[n] or 0) < 0 else 1.0) for n in coordinates]
    out = state.select("id", *[(F.col(n) * s).alias(f"x{k}") for k, (n, s) in enumerate(zip(coordinates, signs))])
    return out, [float(x) for x in own]
