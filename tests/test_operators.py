"""Small fixtures for what the generated tables do not hold."""

import datetime
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from braidwork.functions import colours, text, vectors
from braidwork.operators import history, merkle, recommend, relational, similarity, trees
from braidwork.sources import files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    assert one(spark, vectors.cosine(arr(1, 0), arr(0, 0))) == 0
    assert one(spark, vectors.cosine(arr(1, 2), arr(-1, -2))) == pytest.approx(-1)
    assert one(spark, vectors.euclid(arr(0, 0), arr(3, 4))) == 5
    assert one(spark, vectors.guarded(vectors.dot, arr(1, 2), arr(1))) is None
    assert one(spark, vectors.guarded(vectors.dot, arr(1, 2), arr(3, 4))) == 11


def test_user_cosine(spark):
    rows = [(1, 1, 5), (1, 2, 3), (2, 1, 4), (2, 2, 1), (3, 2, 2), (4, 9, 1), (5, 1, None), (5, 2, 0)]
    r = spark.createDataFrame(rows, "user int, item int, rating int")
    got = {(x.user, x.other): (x.common, x.similarity) for x in recommend.user_cosine(r).collect()}
    assert got[1, 2] == (2, pytest.approx((20 + 3) / (math.sqrt(34) * math.sqrt(17))))
    assert got[1, 3] == (1, pytest.approx(1.0))
    assert not any(4 in k or 5 in k for k in got)


def test_engagement(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user int")
    sessions = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 0.0), (2, None)], "user int, duration double")
    emotions = spark.createDataFrame([(1,), (3,), (3,), (3,), (3,)], "user int")
    got = {r.user: r.score for r in recommend.engagement(users, sessions, emotions).collect()}
    assert got == {1: int(0.4 * 3 + 0.3 * 15 + 0.3), 2: 0, 3: int(1.2)}


def test_achievements(spark):
    goals = [(u, "achieved") for u, n in ((0, 0), (1, 1), (4, 4), (5, 5), (9, 9), (10, 10)) for _ in range(n)] + [(0, "open")]
    got = recommend.achievements(spark.createDataFrame(goals, "user int, status string")).groupBy("user").count().collect()
    assert {r.user: r["count"] for r in got} == {1: 1, 4: 1, 5: 2, 9: 2, 10: 3}


def test_update_modes(spark):
    a = spark.createDataFrame([("k1", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("k1", 9), ("k2", 3), (None, 8)], "k string, v int")
    assert sorted(map(tuple, relational.difference(a, b, "k").collect())) == [("k2", 3)]
    assert {tuple(r) for r in relational.update_keeping_old(a, b, "k").collect()} == {("k1", 1), (None, 2), ("k2", 3)}
    assert {tuple(r) for r in relational.merge_keeping_new(a, b, "k").collect()} == {("k1", 9), (None, 8), ("k2", 3)}


def test_patch_rules(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, s string, n int")
    change = spark.createDataFrame([(1, "", 0), (2, None, 7)], "id int, s string, n int")
    rows = {rule: sorted(map(tuple, relational.patch(base, change, "id", rule).collect())) for rule in ("not_null", "truthy", "overwrite")}
    assert rows["not_null"] == [(1, "", 0), (2, "b", 7)]
    assert rows["truthy"] == [(1, "a", 5), (2, "b", 7)]
    assert rows["overwrite"] == [(1, "", 0), (2, None, 7)]


def test_prefix_strategies(spark):
    df = spark.createDataFrame([("Alpha",), ("alpha ",), ("ALPHABET",), ("beta alpha",)], "s string")
    names = lambda **kw: [r.s for r in df.where(relational.matches(F.col("s"), "alpha", **kw)).collect()]
    assert names() == ["Alpha", "alpha ", "ALPHABET"]
    assert names(cased=True) == ["alpha "]
    assert names(more=True) == ["ALPHABET"]
    assert names(strategy="regex") == ["Alpha", "alpha ", "ALPHABET", "beta alpha"]
    assert names(strategy="what") == []


def test_natural_order(spark):
    df = spark.createDataFrame([("file10",), ("File2",), ("file1b",), ("file1",)], "s string")
    assert [r.s for r in df.orderBy(relational.natural_key(F.col("s"))).collect()] == ["file1", "file1b", "File2", "file10"]
    long = ["n" + "9" * 30, "n1" + "0" * 30, "n" + "0" * 40 + "7", "n" + "9" * 29 + "8", "n8"]
    rows = spark.createDataFrame([(s,) for s in long], "s string").orderBy(relational.natural_key(F.col("s"))).collect()
    assert [r.s for r in rows] == [long[2], "n8", long[3], long[0], long[1]]


def test_validity(spark):
    now, ts = datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 1)
    valid = lambda period: one(spark, relational.is_valid(F.lit(ts), period, F.lit(now)))
    assert valid(F.lit(None).cast("interval day to second")) and valid(F.make_dt_interval(F.lit(1))) and not valid(F.make_dt_interval(F.lit(0), F.lit(23)))


NODES = [("c", "r", None, 0), ("c", "a", "r", 0), ("c", "b", "r", 1), ("c", "a1", "a", 0), ("c", "o", "gone", 0), ("d", "r", None, 0)]
SCHEMA = "conv string, id string, parent string, ordinal long"


def nodes(spark, rows=NODES):
    return spark.createDataFrame(rows, SCHEMA)


def test_tree_places(spark):
    got = {(r.conv, r.id): r.depth for r in trees.placed(nodes(spark)).collect()}
    assert got == {("c", "r"): 0, ("c", "a"): 1, ("c", "b"): 1, ("c", "a1"): 2, ("c", "o"): 0, ("d", "r"): 0}
    chain = [("x", str(i), str(i - 1) if i else None, 0) for i in range(150)]
    assert trees.heights(nodes(spark, chain)).first().height == 150
    assert trees.ancestors(nodes(spark, chain)).count() == 150 * 149 // 2
    assert trees.placed(nodes(spark, [])).count() == 0


def test_tree_edits(spark):
    walk = lambda df: [r.id for r in trees.placed(df).where("conv = 'c' AND root = 'r'").orderBy("enter").collect()]
    fresh = nodes(spark, [("c", "n", "a", 0)])
    assert walk(trees.add(nodes(spark), fresh)) == ["r", "a", "n", "a1", "b"]
    assert walk(trees.add(nodes(spark), fresh, "after")) == ["r", "a", "a1", "n", "b"]
    assert walk(trees.add(nodes(spark), fresh, "before")) == ["r", "n", "a", "a1", "b"]
    moves = spark.createDataFrame([("c", "a", "b", 0), ("c", "r", "a1", 0)], "conv string, id string, new_parent string, index long")
    assert walk(trees.move(nodes(spark), moves)) == ["r", "b", "a", "a1"]
    assert walk(trees.delete(nodes(spark), moves.select("conv", "id"), cascade=True)) == ["r", "b"]
    cut = spark.createDataFrame([("c", "a", "new")], "conv string, id string, new_conv string")
    got = trees.placed(trees.split(nodes(spark), cut)).orderBy("enter").collect()
    assert [(r.conv, r.id, r.depth) for r in got] == [("new", "a", 0), ("new", "a1", 1), ("new", "b", 1)]


def test_greedy_skips(spark):
    rows = [("c", i, "user", "x", n) for i, n in enumerate((5, 9, 3))] + [("c", 9, "user", "", 1)]
    m = spark.createDataFrame(rows, "conv string, turn long, role string, text string, tokens int")
    assert sorted(r.turn for r in history.greedy(m, 9).collect()) == [0, 2]
    assert [r.turn for r in history.prefix(m.where("text <> ''"), 9).collect()] == [2]


def test_segments_one_per_token(spark):
    t = spark.createDataFrame([("r", 0, "a|b|c"), ("r", 1, " "), ("r", 2, "d|"), ("q", 0, "x")], "run string, seq int, token string")
    got = sorted((r.run, r.n, r.segment) for r in history.segments(t, "|").collect())
    # the second delimiter of a token waits for the next token, and what is left is not split again
    assert got == [("q", 0, "x"), ("r", 0, "a"), ("r", 1, "b"), ("r", 2, "c d")]


def test_text(spark):
    assert one(spark, text.split_keeping(F.lit("x 1.2.3 intro 1.2.4 body"))) == ["x", "1.2.3", "intro", "1.2.4", "body"]
    assert one(spark, text.split_capitals(F.lit("CamelCaseÉtat"))) == ["Camel", "Case"]
    assert one(spark, text.clean_segment(F.lit("Part 1 P 2 TAPESTRY tapestries"))).split() == ["Synergy", "Synergies"]
    assert one(spark, text.novelty(F.lit(""), F.lit(""))) == 0
    assert one(spark, text.truncate_sentences(F.lit("aa. bb. cccccc. d"), 9)) == "aa. bb."
    assert one(spark, text.epoch(F.lit("1970-01-02"), F.lit(0).cast("long"))) == 86400
    assert one(spark, text.epoch(F.lit("never"), F.lit(7).cast("long"))) == 7
    body = " ".join(f"word{i}" + ("." if i % 50 == 49 else "") for i in range(450))
    parts = one(spark, text.chunks(F.lit(body)))
    assert " ".join(parts) == body and all(len(p.split()) <= 200 for p in parts) and parts[0].endswith(".")


def test_harmony(spark):
    white, black = (arr_ for arr_ in (tuple(F.lit(1.0) for _ in "rgb"), tuple(F.lit(0.0) for _ in "rgb")))
    assert one(spark, colours.delta_e(white, white)) == pytest.approx(0)
    assert one(spark, colours.delta_e(white, black)) == pytest.approx(100, abs=0.01)
    assert one(spark, colours.harmony(white, white)) == pytest.approx(0.4 + 40)


def test_merkle(spark):
    h = lambda b: hashlib.sha512(b).digest()[:32]

    def root(level):
        while len(level) > 1:
            level = level + level[-1:] * (len(level) % 2)
            level = [h(a + b) for a, b in zip(level[::2], level[1::2])]
        return level[0]

    data = {f"t{n}": [h(f"{n}/{i}".encode()) for i in range(n)] for n in (1, 2, 3, 4, 5)}
    leaves = spark.createDataFrame([(t, i, bytearray(x)) for t, xs in data.items() for i, x in enumerate(xs)], "tree string, pos int, hash binary")
    levels = merkle.levels(leaves)
    assert {r.tree: bytes(r.root) for r in merkle.roots(levels).collect()} == {t: root(xs) for t, xs in data.items()}
    j = merkle.proofs(levels, leaves).join(merkle.roots(levels), "tree").join(leaves, ["tree", "pos"])
    flipped = F.concat(F.expr("substring(hash, 1, 31)"), F.lit(bytearray(b"\x00")))
    rows = j.select("tree", merkle.verify(F.col("hash"), F.col("pos"), F.col("proof"), F.col("root")).alias("ok"), merkle.verify(flipped, F.col("pos"), F.col("proof"), F.col("root")).alias("bad")).collect()
    assert len(rows) == 14 and all(r.ok and not r.bad for r in rows)
    d = one(spark, merkle.descriptor(F.unhex(F.lit("ab" * 32)), F.lit(5), F.lit(7)))
    assert bytes(d) == b"\xab" * 32 + (5).to_bytes(16, "big") + (7).to_bytes(16, "big")


def test_json_trees(spark, tmp_path):
    tree = {"id": "t", "title": "x", "mapping": {"r": {"id": "r", "parent": None, "children": ["b", "a"], "message": {"id": "m", "role": "user", "parts": ["hi"]}}, "a": {"id": "a", "parent": "r", "children": []}, "b": {"id": "b", "parent": "r", "children": []}}}
    (tmp_path / "t.json").write_text(json.dumps([tree, {"id": "u", "mapping": {}}]))
    found = files.json_trees(spark, str(tmp_path), 1)
    n = files.tree_nodes(found)
    assert [r.id for r in trees.placed(n.select("conv", "id", "parent", "ordinal")).orderBy("enter").collect()] == ["r", "b", "a"]
    out = json.loads(files.trees_to_json(n).first().json)
    assert out["mapping"]["r"]["children"] == ["b", "a"] and "parent" not in out["mapping"]["r"]
    fine, bad = files.new_trees(found.unionByName(found), found.limit(0))
    assert (fine.count(), bad.count()) == (0, 2)


def test_tickets(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,tickets\na,1\nb,2\na,3\n")
    assert {r["name"]: r.tickets for r in files.tickets(spark, str(tmp_path / "t.csv")).collect()} == {"a": 3, "b": 2}
    (tmp_path / "u.csv").write_text("name,tickets\na,x\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        files.tickets(spark, str(tmp_path / "u.csv")).collect()


def test_media(spark, tmp_path):
    for path, content in {"T/image/1/file2.png": "i", "T/image/1/file10.png": "i", "T/prompt/1/p2.txt": "B\nbody two", "T/prompt/1/p1.txt": "A\nbody one", "T/caption/1/c.txt": "cap", "T/image/1/.DS_Store": "s", "X/prompt/1/p.txt": "no"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)
    (row,) = files.media(spark, str(tmp_path)).collect()
    assert row.prompt == ["A\nbody one", "B\nbody two"] and [p.rsplit("/", 1)[1] for p in row.image] == ["file2.png", "file10.png"] and row.audio == []
    scripts, sections = files.scenes(files.media(spark, str(tmp_path)))
    assert scripts.first().script == "body one\nbody two"
    assert [(r.part_title, r.caption) for r in sections.orderBy("pos").collect()] == [("A", "cap"), ("B", None)]


def test_requests(spark):
    rows = spark.createDataFrame([(0, "u", "a")], "n int, user_message string, assistant_message string")
    body = json.loads(files.requests(rows, "m").first().value)
    assert body["custom_id"] == "request-0" and [m["role"] for m in body["body"]["messages"]] == ["user", "assistant"]
    assert json.loads(files.requests(rows.drop("assistant_message"), "m").first().value)["body"]["messages"] == []


def test_flat_columns(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("b"), F.struct(F.lit(2).alias("d")).alias("c")).alias("a"), F.lit(3).alias("e"))
    assert files.flat_columns(df).columns == ["a_b", "a_c_d", "e"]


def test_cache(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    cache = spark.createDataFrame([("a", [1.0])], "key string, v array<double>")
    asked = []

    def encode(df):
        asked.extend(r.key for r in df.collect())
        return df.withColumn("v", similarity.bag_of_words(F.col("key"), 4))

    got = {r.key: r.v for r in similarity.with_cache(wanted, cache, encode).collect()}
    assert asked == ["b"] and got["a"] == [1.0] and sum(x * x for x in got["b"]) == pytest.approx(1)
