"""The streaming segmenter against its batch twin."""

from pyspark.sql import functions as F

from braidwork.operators.history import segments
from braidwork.streaming.segments import active_counts, segment_stream, visible

SCHEMA = "run string, seq int, token string, last boolean"


def test_segments(spark, tmp_path):
    rows = [("r", 0, "a.", False), ("r", 1, "b", False), ("r", 2, "c.d", False), ("q", 0, "x. y", False), ("r", 3, " e", True), ("q", 1, "z. ", True)]
    batches = [rows[:3], rows[3:]]
    for k, part in enumerate(batches):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = segment_stream(stream, ".").writeStream.format("memory").queryName("segments_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("segments_out").collect()}
    want = {tuple(r) for r in segments(spark.createDataFrame(rows, SCHEMA), ".").collect()}
    assert got == want == {("r", 0, "a"), ("r", 1, "bc"), ("r", 2, "d e"), ("q", 0, "x"), ("q", 1, "yz")}


def test_sessions(spark):
    e = spark.createDataFrame([(1, 0), (1, 600), (1, 9000), (2, 0)], "user int, s int").select("user", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r.user, r.n) for r in active_counts(e).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_visible(spark):
    t = spark.createDataFrame([("a",), (" ",), ("\n",), (None,)], "token string")
    assert visible(t).count() == 1


def test_observers(spark, tmp_path):
    import time

    from braidwork.streaming.events import Progress, drained, fan_out, timed

    for part in ([("a", 1)], [("b", 2), ("c", 3)]):
        spark.createDataFrame(part, "run string, seq int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, seq int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, errors, times = [], [], []

    def bad(batch, number):
        raise ValueError("no")

    handlers = {"count": lambda batch, number: seen.append(batch.count()), "bad": bad, "mute": lambda batch, number: seen.append(-1), "timed": timed(lambda b: b.where("seq > 1"), times, "step")}
    listener = Progress()
    spark.streams.addListener(listener)
    q = drained(stream, 0.2).foreachBatch(fan_out(handlers, ("mute",), lambda *e: errors.append(e))).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(150):
            if len(times) == 2:
                break
            time.sleep(0.2)
    finally:
        q.stop()
    for _ in range(50):
        if any(r[1] == "end" for r in listener.seen):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert sorted(seen) == [1, 2] and [(e[0], str(e[2])) for e in errors] == [("bad", "no")] * 2 and len(times) == 2
    rows = listener.rows(spark).collect()
    assert [r.event for r in rows][0] == "start" and rows[-1].event == "end" and sum(r.rows or 0 for r in rows) == 3
