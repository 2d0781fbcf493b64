"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of whole texts are standardized and mapped to cosines that
approximate a Gaussian kernel. Partitions sum their share of the normal
equations, the driver adds a fixed number of such sums and solves them, and
binned raw scores of labelled rows outside the fit give a monotone map to
probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, materialize, maybe_broadcast, sampled, table, without

FEATURES = 256
PARTS = 16
BINS = 1000
THRESHOLD = 0.7
_PUNCT = [ord(c) for c in ".,;:'\"-()?"]
_ODD = [ord(c) for c in "!#$%&*@^~|<>{}[]\\/=+_`"]


def _log_share(x, n):
    return np.log1p(1000.0 * x / max(n, 1))


def statistics(text: bytes | None) -> list[float]:
    """Statistics of one text: shares of character classes, word lengths and repetition; all zero for an empty text."""
    text = text or b""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    k = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    twins = sum(map(bytes.__eq__, words, words[1:]))
    thirds = len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else k
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(words))),
        float(sizes.mean()),
        float(sizes.std()),
        float(np.log1p(sizes.max())),
        hist[65:91].sum() / max(n, 1),
        hist[97:123].sum() / max(n, 1),
        float(_log_share(hist[48:58].sum(), n)),
        hist[128:].sum() / max(n, 1),
        float(_log_share(hist[_PUNCT].sum(), n)),
        float(_log_share(hist[_ODD].sum(), n)),
        float(_log_share(hist[33], n)),
        float(_log_share(hist[124], n)),
        len(counts) / k,
        max(counts.values(), default=0) / k,
        twins / k,
        min(1.0, thirds / max(k - 2, 1)),
        float(_log_share(len(lines), len(words))),
        len(set(lines)) / max(len(lines), 1),
    ]


N_STATS = len(statistics(b""))


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts.cast(pa.binary())], np.float64).reshape(-1, N_STATS)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def stats(texts: pa.Array) -> pa.Array:
    x = _matrix(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATS, dtype=np.int32)), pa.array(x.ravel()))


class Model:
    """What scoring needs: standardization, random frequencies, weights and the calibration's points."""

    def __init__(self, mean, spread, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.freq = rng.normal(size=(N_STATS, FEATURES)) / np.sqrt(N_STATS / 2)
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + N_STATS + 1)
        self.points = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.freq + self.phase), z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of it is the raw order, which parts ties of the monotone map."""
        r = self.raw(x)
        return np.clip(0.999 * np.interp(r, *self.points) + 0.001 * np.clip(r, 0, 1), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (mean x, mean y) of the pooled blocks, by x."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 100_000, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """Fit on labelled rows whose remainder modulo 4 is not 2: 0 and 1 for the weights, 3 for the calibration.

    ``max_fit_rows`` bounds the sample of labelled rows (by a hash of the id).
    A document with several labels gets their mean; null labels and ids are
    left out. None without any usable label.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    marks = marks.where(remainder(F.col("doc_id"), 4) != 2)
    rate = min(1.0, max_fit_rows / max(marks.count(), 1))
    marks = marks.where(sampled(F.col("doc_id"), rate, seed))
    marks = materialize(marks.withColumnRenamed("doc_id", "_id"), "labels")
    rows = docs.select("doc_id", "text").join(maybe_broadcast(marks, 2 * max_fit_rows), F.col("doc_id") == F.col("_id"))
    rows = materialize(rows.select(stats("text").alias("x"), "y", (remainder(F.col("doc_id"), 4) == 3).alias("calibrate")), "statistics")
    means = rows.agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(N_STATS)]).first()
    if means[0] is None:
        return None
    spread = np.array(means[N_STATS:])
    model = Model(np.array(means[:N_STATS]), np.where(spread > 1e-9, spread, 1.0), seed)
    width = len(model.weights)

    def normal(batches):
        total = np.zeros((width, width + 2))
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, N_STATS)
            z, y = model.expand(x), b.column(1).to_numpy()
            total += np.hstack([z.T @ z, (z.T @ y)[:, None], np.full((width, 1), float(len(y)))])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    fitted = rows.where(~F.col("calibrate")).select("x", "y").coalesce(PARTS)
    # at most PARTS matrices of a fixed size
    total = sum(np.frombuffer(r[0]).reshape(width, width + 2) for r in fitted.mapInArrow(normal, "sums binary").collect())
    if isinstance(total, int) or not total[0, -1]:
        return None
    a = total[:, :width] + ridge * total[0, -1] / width * np.diag([1.0] * (width - 1) + [0.0]) + 1e-9 * np.eye(width)
    model.weights = np.linalg.solve(a, total[:, width])

    def raw(batches):
        for b in batches:
            r = np.clip(model.raw(b.column(0).flatten().to_numpy().reshape(-1, N_STATS)), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(r * BINS).astype(np.int32)), b.column(1)], ["bin", "y"])

    held = rows.where("calibrate").select("x", "y").mapInArrow(raw, "bin int, y double")
    bins = held.groupBy("bin").agg(F.avg("y"), F.count("*")).collect()  # at most 3 * BINS + 1
    bins = bins or [(0, 0.0, 1), (BINS, 1.0, 1)]
    x, y, w = (np.array(v, float) for v in zip(*sorted(map(tuple, bins))))
    model.points = isotonic(x / BINS, y, w)
    return model


@apart("doc_id", "text")
def classify(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted.

    Defined results: null and empty texts are scored by their statistics, all
    zero; without a model every score is 0.5; held_out is false for null ids;
    repeated rows are scored each on their own; an empty table gives an empty
    table; input columns named like an output are replaced.
    """
    kept = without(docs, "held_out", "score", "predicted")

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(texts)))

    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    out = kept.withColumns({"held_out": held, "score": score(F.col("text")) if model else F.lit(0.5)})
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", "held_out", "score", "predicted")
