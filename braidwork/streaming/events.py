"""What goes on around a stream: events handed to several observers, and progress as rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

#: (name of the handler, number of the batch, error)
Log = Callable[[str, int, Exception], None]


def fan_out(handlers: dict[str, Callable[[DataFrame, int], None]], ignore: tuple[str, ...] = (), log: Log | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that hands each batch to all handlers but those to ignore, by name.

    The batch is kept while they run, so that the source is read once. A
    handler's error goes to ``log`` and does not keep the others from running.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, handler in handlers.items():
                if name in ignore:
                    continue
                try:
                    handler(batch, number)
                except Exception as e:
                    if log is not None:
                        log(name, number, e)
        finally:
            batch.unpersist()

    return each


def drained(stream: DataFrame, seconds: float) -> DataStreamWriter:
    """A writer that takes what has come every ``seconds``."""
    return stream.writeStream.trigger(processingTime=f"{round(seconds * 1000)} milliseconds")


class Progress(StreamingQueryListener):
    """Rows (query, event, batch, rows, ms) of all queries of a session: start, a row a batch, end with its error."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, str, int | None, int | None, int | None, str | None]] = []

    def onQueryStarted(self, event) -> None:
        self.seen.append((str(event.id), "start", None, None, None, None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen.append((str(p.id), "batch", p.batchId, p.numInputRows, p.batchDuration, None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.seen.append((str(event.id), "end", None, None, None, event.exception))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.seen, "query string, event string, batch long, rows long, ms long, error string")


def timed(step: Callable[[DataFrame], DataFrame], seen: list[tuple[str, datetime.datetime, float]], name: str) -> Callable[[DataFrame, int], None]:
    """A handler that runs ``step`` on a batch to its end and adds (name, begin, seconds) to ``seen``."""

    def run(batch: DataFrame, number: int) -> None:
        begin = datetime.datetime.now(datetime.timezone.utc)
        step(batch).write.format("noop").mode("overwrite").save()
        seen.append((name, begin, (datetime.datetime.now(datetime.timezone.utc) - begin).total_seconds()))

    return run
