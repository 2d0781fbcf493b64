"""Token streams cut into segments, with state per run; and the events around them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run string, n int, segment string"
STATE = "open string, n int"


def segment_stream(tokens: DataFrame, delimiter: str, idle_ms: int | None = None) -> DataFrame:
    """(run, n, segment) from a stream of (run, seq, token, last).

    Each token is added to its run's buffer; if the buffer then holds the
    delimiter, the trimmed text before the first is emitted and the rest
    stays, so at most one segment comes per token. A row with ``last`` true,
    or ``idle_ms`` of processing time without tokens, ends the run: what is
    left, if not blank, is its last segment. Tokens of a micro-batch are taken
    in the order of ``seq``. ``operators.history.segments`` is the batch twin.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, n = state.get if state.exists else ("", 0)
        out, ended = [], state.hasTimedOut
        if not ended:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            for token, last in zip(rows["token"], rows["last"]):
                text += token if isinstance(token, str) else ""
                head, found, rest = text.partition(delimiter)
                if found:
                    out.append((key[0], n, head.strip()))
                    text, n = rest, n + 1
                ended = ended or bool(last)
        if ended:
            if text.strip():
                out.append((key[0], n, text.strip()))
            if state.exists:
                state.remove()
        else:
            state.update((text, n))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["run", "n", "segment"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    rows = tokens.select(F.col("run").cast("string").alias("run"), "seq", "token", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("run").applyInPandasWithState(step, OUT, STATE, "append", timeout)


def active_counts(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(user, start, end, n): sessions of a stream of (user, ts), closed after ``gap`` without events; rows later than ``late`` are dropped."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user").agg(F.count("*").alias("n"))
    return s.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def visible(tokens: DataFrame) -> DataFrame:
    """Without tokens of white space only, which are stored but not shown."""
    return tokens.where(F.col("token").rlike(r"\S"))
