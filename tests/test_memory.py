"""A function is called once for each new input; errors and slow calls are rows."""

import threading
import time
import uuid

import pytest

from braidwork.operators import memory


@pytest.fixture
def counted(tmp_path):
    """A function that leaves a file for each call, and what it was called with."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def fn(item):
        (folder / uuid.uuid4().hex).write_text(item)
        if item.startswith("bad"):
            raise ValueError("no " + item)
        if item.startswith("slow"):
            time.sleep(30)
        return item.upper()

    def calls():
        found = sorted(f.read_text() for f in folder.iterdir())
        for f in folder.iterdir():
            f.unlink()
        return found

    return fn, calls


def test_second_run_asks_new_items_only(spark, tmp_path, counted):
    fn, calls = counted
    path = str(tmp_path / "memory")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "bad x")], "n int, input string")
    got, asked = memory.remembered(items, fn, path)
    assert calls() == ["", "a", "b", "bad x"]
    rows = {r.n: (r.result, r.error) for r in got.collect()}
    assert rows == {1: ("A", None), 2: ("B", None), 3: ("A", None), 4: (None, None), 5: ("", None), 6: (None, "ValueError: no bad x")}
    assert asked.count() == 4 and calls() == []  # reading the answers calls nothing
    more = items.unionByName(spark.createDataFrame([(7, "c"), (8, "c")], "n int, input string"))
    got, asked = memory.remembered(more, fn, path)
    assert calls() == ["bad x", "c"] and asked.count() == 2  # an error is asked again
    assert {r.n: r.result for r in got.collect()}[8] == "C" and got.count() == 8
    both = got.select("n", "result").unionByName(memory.remembered(more, fn, path)[0].select("n", "result"))
    assert both.where("result = 'C'").count() == 4 and calls() == ["bad x"]  # two calls in one plan
    _, asked = memory.remembered(more.where("n <> 6"), fn, path)
    assert calls() == [] and asked.count() == 0
    memory.remembered(more.where("n = 1"), fn, path, version="2")
    assert calls() == ["a"]


def test_slow_calls_are_errors(spark, tmp_path, counted):
    fn, calls = counted
    items = spark.createDataFrame([("slow",), ("quick",)], "input string")
    began = time.time()
    got, _ = memory.remembered(items, fn, str(tmp_path / "m"), seconds=1.0)
    rows = {r.input: (r.result, r.error) for r in got.collect()}
    assert rows == {"quick": ("QUICK", None), "slow": (None, "TimeoutError: over 1 s")} and time.time() - began < 25


def test_attempts(spark, tmp_path, counted):
    fn, calls = counted
    got, asked = memory.remembered(spark.createDataFrame([("bad",)], "input string"), fn, str(tmp_path / "m"), attempts=3, wait=lambda n: 0.01)
    assert calls() == ["bad"] * 3 and asked.first().attempts == 3 and got.first().error == "ValueError: no bad"


def test_threads_share_the_wait():
    most, now, lock = [0], [0], threading.Lock()

    def fn(item):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05)
        with lock:
            now[0] -= 1
        return int(item) * 2

    found = memory.answers_of(fn, [str(i) for i in range(40)], 8, 5.0, 1, lambda n: 0.0)
    assert [f[0] for f in found] == [str(2 * i) for i in range(40)] and 4 <= most[0] <= 8


def test_other_columns_and_no_items(spark, tmp_path):
    items = spark.createDataFrame([("a", 1, "x")], "input string, result int, _answered string")
    got, _ = memory.remembered(items, str.upper, str(tmp_path / "m"))
    assert got.columns == ["input", "_answered", "result", "error"] and got.first().result == "A" and got.first()._answered == "x"
    got, asked = memory.remembered(items.limit(0), str.upper, str(tmp_path / "n"))
    assert got.count() == 0 and asked.count() == 0
