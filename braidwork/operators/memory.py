"""A costly function over distinct inputs, whose answers are kept in a table."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.sources.shared import exists

ANSWERS = "key string, result string, error string, attempts int, run string"


def key_of(item: Column, version: str = "") -> Column:
    """A hash of an input and of the version of the function that answers it."""
    return F.sha2(F.concat(F.lit(f"{version}\0"), item).cast("binary"), 256)


def _answer(fn: Callable, item: str, attempts: int, wait: Callable[[int], float]) -> tuple[str | None, str | None, int]:
    """(result, error, attempts): the error is that of the last attempt."""
    for n in range(1, attempts + 1):
        try:
            found = fn(item)
            return None if found is None else str(found), None, n
        except Exception as e:
            failed = f"{type(e).__name__}: {e}"
        if n < attempts:
            time.sleep(wait(n))
    return None, failed, attempts


def answers_of(fn: Callable, items: list[str], at_once: int, seconds: float, attempts: int, wait: Callable[[int], float]) -> list[tuple]:
    """``_answer`` of each item in threads, ``at_once`` of them at a time. One that takes longer than ``seconds`` is left behind and is an error."""
    found: list = [(None, f"TimeoutError: over {seconds:g} s", attempts)] * len(items)
    running: dict[int, tuple[threading.Thread, float, list]] = {}
    waiting = list(range(len(items)))[::-1]
    while waiting or running:
        while waiting and len(running) < at_once:
            at, box = waiting.pop(), []
            thread = threading.Thread(target=lambda item=items[at], box=box: box.append(_answer(fn, item, attempts, wait)), daemon=True)
            thread.start()
            running[at] = (thread, time.monotonic() + seconds, box)
        next(iter(running.values()))[0].join(0.002)
        for at, (thread, end, box) in list(running.items()):
            if box:
                found[at] = box[0]
            if box or time.monotonic() > end or not thread.is_alive() and not box:
                running.pop(at)
    return found


def remembered(items: DataFrame, fn: Callable[[str], object], path: str, column: str = "input", version: str = "", at_once: int = 8, seconds: float = 60.0, attempts: int = 1, wait: Callable[[int], float] = lambda n: min(2.0**n, 30.0)) -> tuple[DataFrame, DataFrame]:
    """(``items`` with result and error, answers that were asked for in this call).

    ``fn`` is called in tasks, once for each different input that the table at
    ``path`` has no result for; what it returns is kept there as a string,
    under a hash of the input and ``version``. An exception or a call over
    ``seconds`` is a row with an error, not a failed task, and is asked again
    by the next call; ``attempts`` says how often at once, ``wait`` how
    long after which. A null input is not asked and has neither result nor
    error. An executor that is lost costs the calls of its task again, and
    only answers of whole jobs are added to the table.
    """
    spark, run = items.sparkSession, uuid.uuid4().hex
    keyed = items.select(F.struct("*").alias("_row"), F.col(f"`{column}`").alias("_item")).withColumn("_key", key_of(F.col("_item"), version))
    none = spark.createDataFrame([], ANSWERS)
    known = spark.read.schema(ANSWERS).parquet(path) if exists(spark, path) else none
    asked = keyed.where("_key IS NOT NULL").groupBy(F.col("_key").alias("key")).agg(F.first("_item").alias("item"))
    asked = asked.join(known.where("error IS NULL").select("key").distinct(), "key", "left_anti")

    def ask(batches):
        for b in batches:
            found = answers_of(fn, b.column(1).to_pylist(), at_once, seconds, attempts, wait)
            result, error, n = ([f[c] for f in found] for c in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(result, pa.string()), pa.array(error, pa.string()), pa.array(n, pa.int32()), pa.array([run] * len(found), pa.string())], ["key", "result", "error", "attempts", "run"])

    parts = 4 * spark.sparkContext.defaultParallelism  # inputs differ, so a hash of them deals them evenly
    asked.repartition(parts, "key").mapInArrow(ask, ANSWERS).write.mode("append").parquet(path)
    # Spark takes scans of one path for the same, whatever files they listed. True of every run, this condition keeps
    # a plan that holds the answers of two calls from reading those of the first twice.
    table = spark.read.schema(ANSWERS).parquet(path).where(F.col("run") < F.lit(f"g{run}"))
    # Two jobs at once may both have asked; a result counts more than an error, then any of the same key.
    best = table.groupBy(F.col("key").alias("_answered")).agg(F.max(F.struct(F.col("error").isNull().alias("ok"), "run", "result", "error")).alias("_best"))
    joined = keyed.join(best, F.col("_key") == F.col("_answered"), "left")
    own = [F.col(f"_row.`{c}`") for c in items.columns if c.lower() not in ("result", "error")]
    return joined.select(*own, "_best.result", "_best.error"), table.where(F.col("run") == run)
