"""Trees in the state of a stream: late, repeated and refused events, and an end like that of the batch functions."""

import datetime
import itertools

from pyspark.sql import functions as F

from braidwork.operators import trees
from braidwork.streaming import trees as live

BEGIN = datetime.datetime(2024, 1, 1)
NODES = "conv string, id string, parent string, ordinal long, text string"


def run(spark, tmp_path, batches, name):
    """Rows of a stream that gets these batches of events, and one more, hours later, that ends the trees."""
    end = [("clock", 0, BEGIN + datetime.timedelta(hours=h), "child", "x", None, None, None) for h in (9, 10)]
    for n, part in enumerate([*batches, end[:1], end[1:]]):
        spark.createDataFrame(part, live.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*.parquet"):
            f.rename(tmp_path / "in" / f"{n:03d}.parquet") if not f.name[:3].isdigit() else None
    stream = spark.readStream.schema(live.EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = live.live_trees(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300), q.exception()
    return spark.table(name).where("conv <> 'clock'")


def event(conv, seq, op, id_, parent=None, index=None, text=None, minute=0):
    return (conv, seq, BEGIN + datetime.timedelta(minutes=minute), op, id_, parent, index, text)


STEPS = [
    ("child", "r", None, None), ("child", "a", "r", None), ("child", "b", "r", None), ("after", "c", "a", None), ("before", "d", "a", None), ("child", "e", "a", None), ("child", "f", "e", None),
    ("move", "a", "b", 0), ("move", "c", "e", 5), ("cascade", "e", None, None), ("delete", "b", None, None),
]


def test_end_is_that_of_the_batch(spark, tmp_path):
    """The same steps on several trees, given in other orders and batches; each step is also applied by the batch functions."""
    events = [event(f"t{k}", n, op, f"{i}", p, x, f"{i}{k}") for k in range(4) for n, (op, i, p, x) in enumerate(STEPS)]
    first, second = [e for e in events if (e[1] + int(e[0][1])) % 3], [e for e in events if not (e[1] + int(e[0][1])) % 3]
    out = run(spark, tmp_path, [first, second], "live_end")
    assert out.where("kind = 'refused'").count() == 0 and out.where("kind = 'applied'").count() == len(events)
    applied = [(r.conv, r.seq) for r in out.where("kind = 'applied'").collect()]
    assert sorted(applied) == sorted((e[0], e[1]) for e in events)
    nodes = spark.createDataFrame([(f"t{k}", "r", None, 0, f"r{k}") for k in range(4)], NODES)
    for op, i, p, x in STEPS[1:]:
        convs = nodes.where("id = 'r'").select("conv")
        if op in ("child", "before", "after"):
            fresh = convs.select("conv", F.lit(i).alias("id"), F.lit(p).alias("parent"), F.lit(0).cast("long").alias("ordinal"), F.concat(F.lit(i), F.substring("conv", 2, 1)).alias("text"))
            nodes = trees.add(nodes, fresh, op)
        elif op == "move":
            nodes = trees.move(nodes, convs.select("conv", F.lit(i).alias("id"), F.lit(p).alias("new_parent"), F.lit(x).cast("long").alias("index")))
        else:
            nodes = trees.delete(nodes, convs.select("conv", F.lit(i).alias("id")), cascade=op == "cascade")
        nodes = spark.createDataFrame(nodes.collect(), NODES)
    want = sorted(map(tuple, trees.ranked(nodes).select("conv", "id", "parent", "ordinal", "text").collect()), key=repr)
    assert sorted(map(tuple, live.nodes_of(out).collect()), key=repr) == want


def test_late_repeated_and_refused(spark, tmp_path):
    one = [event("c", 0, "child", "r"), event("c", 0, "child", "r"), event("c", 3, "child", "b", "r"), event("c", 1, "child", "a", "r")]
    two = [event("c", 3, "child", "b", "r", minute=1), event("c", 2, "child", "a2", "a", minute=1), event("c", 1, "child", "a", "r", minute=1), event("c", 4, "child", "a", "r", minute=1)]
    three = [event("c", 5 + n, *e, minute=2) for n, e in enumerate([("child", "s"), ("child", "y", "nowhere"), ("after", "y", "r"), ("move", "a", "a2", 0), ("move", "zz", "a", 0), ("delete", "r"), ("delete", "zz"), ("jump", "a"), ("child", None, "r")])]
    three += [event("c", 99, "child", "late", "a", minute=2)]  # what is missing before it never comes
    out = run(spark, tmp_path, [one, two, three], "live_refused")
    got = sorted((r.seq, r.reason) for r in live.refused(out).collect())
    why = ["the id exists", "the tree has a root", "no such parent", "the parent is a root", "it would be under itself", "no such node", "a root stays", "no such node", "unknown operation", "no id"]
    assert got == sorted([(0, "repeated"), (1, "repeated"), (3, "repeated"), *zip(itertools.count(4), why)])
    assert {(r.id, r.parent, r.ordinal) for r in live.nodes_of(out).collect()} == {("r", None, 0), ("b", "r", 0), ("a", "r", 1), ("late", "a", 0), ("a2", "a", 1)}


def test_ended_trees_refuse(spark, tmp_path):
    first = [event("c", 0, "child", "r", text="x")]
    later = [event("d", 0, "child", "r", minute=300)]
    again = [event("d", 1, "child", "q", "r", minute=301)]
    back = [event("c", 1, "child", "a", "r", minute=302)]
    out = run(spark, tmp_path, [first, later, again, back], "live_ended")
    assert [(r.conv, r.seq, r.reason) for r in live.refused(out).collect()] == [("c", 1, "the tree has ended")]
    assert sorted((r.conv, r.id, r.text) for r in live.nodes_of(out).collect()) == [("c", "r", "x"), ("d", "q", None), ("d", "r", None)]
