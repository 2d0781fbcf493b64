"""What SQL cannot tell of the composed operators: errors, rejects, hash trees, files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from braidwork.functions import text as X
from braidwork.operators import history, merkle, recommend, relational, similarity, trees
from braidwork.plans import registry
from braidwork.sources import files, shared
from tests.oracle import DATA, rows_of_sql


def short(b: bytes) -> bytes:
    return hashlib.sha512(b).digest()[:32]


def tree(leaves: list[bytes]) -> list[list[bytes]]:
    out = [leaves]
    while len(out[-1]) > 1:
        last = out[-1] + out[-1][-1:] * (len(out[-1]) % 2)
        out.append([short(a + b) for a, b in zip(last[::2], last[1::2])])
    return out


def described(data_hash: bytes, size: int, tickets: int) -> bytes:
    return data_hash + size.to_bytes(16, "big") + tickets.to_bytes(16, "big")


def brand_leaves():
    _, parts = rows_of_sql("SELECT p_brand, p_partkey, p_name, p_size FROM part ORDER BY p_brand, p_partkey", DATA)
    out: dict = {}
    for brand, key, name, size in parts:
        out.setdefault(brand, []).append(short(described(short(f"{key}|{name}".encode()), len(name), size)))
    return out


def test_merkle_root_query(spark):
    got = {r.tree: r.root for r in registry.queries()["merkle_root"](spark, DATA).collect()}
    assert got == {b: tree(x)[-1][0].hex() for b, x in brand_leaves().items()}


def test_merkle_verify_query(spark):
    rows = registry.queries()["merkle_verify"](spark, DATA).collect()
    leaves = brand_leaves()
    assert sorted((r.tree, r.pos, r.steps) for r in rows) == sorted((b, i, len(tree(x)) - 1) for b, x in leaves.items() for i in range(len(x)))
    assert all(r.valid for r in rows)


def test_folds_of_many_levels(spark):
    data = {n: [short(f"{n}/{i}".encode()) for i in range(n)] for n in (1, 2, 63, 64, 65, 127, 129, 4097)}
    leaves = spark.createDataFrame([(n, i, bytearray(x)) for n, xs in data.items() for i, x in enumerate(xs)], "tree int, pos int, hash binary")
    got = {(r.tree, r.level, r.pos): bytes(r.hash) for r in merkle.levels(leaves).collect()}
    assert got == {(n, level, i): h for n, xs in data.items() for level, row in enumerate(tree(xs)) for i, h in enumerate(row)}


def test_collections(spark):
    content = {"a.txt": b"A", "d/b.txt": b"BB", "d/e/c.txt": b"CCC", "d/e/x.txt": b"no ticket", "z/only.txt": b"no ticket", "d/tickets.csv": b"", ".hidden": b""}
    tickets = [("", "a.txt", 2), ("d", "b.txt", 3), ("d", ".", 50), ("d/e", "c.txt", 4), ("d/e", "c.txt", 5)]
    f = spark.createDataFrame([(p, bytearray(b)) for p, b in content.items()], "path string, content binary")
    t = spark.createDataFrame(tickets, "folder string, name string, tickets long")
    entries, refused = merkle.collections(f, t)
    assert sorted(r.path for r in refused.collect()) == ["d/e/x.txt", "z/only.txt"]
    want = {p: (short(content[p]), len(content[p]), n) for p, n in (("a.txt", 2), ("d/b.txt", 3), ("d/e/c.txt", 5))}
    h = lambda p: short(described(*want[p]))
    want["d/e"] = (tree([h("d/e/c.txt")])[-1][0], 3, 5)
    want["d"] = (tree([h("d/b.txt"), h("d/e")])[-1][0], 5, 50)
    want["z"] = (bytes.fromhex(merkle.EMPTY_ROOT), 0, 0)
    want[""] = (tree([h("a.txt"), h("d"), h("z")])[-1][0], 6, 52)
    got = {r.path: r for r in entries.collect()}
    assert {p: (bytes(r.data_hash), r["size"], r.tickets) for p, r in got.items()} == want
    assert all(bytes(r.hash) == h(p) for p, r in got.items())
    assert got[""].proof is None and got["d/e/c.txt"].proof == []
    assert [bytes(x) for x in got["a.txt"].proof] == [h("d"), tree([h("a.txt"), h("d"), h("z")])[1][1]]
    kinds = {(r.path, r.kind): r.hex for r in merkle.artefacts(entries).collect()}
    assert kinds["", "root"] == want[""][0].hex() and kinds["d", "desc"] == described(*want["d"]).hex() and ("d", "blob") not in kinds
    none, _ = merkle.collections(f.limit(0), t)
    assert none.count() == 0


def test_collection_entries_query(spark):
    rows = registry.queries()["collection_entries"](spark, DATA).collect()
    _, parts = rows_of_sql("SELECT p_brand, p_type, p_partkey, p_name, p_size FROM part", DATA)
    folders: dict = {}
    for brand, kind, key, name, size in parts:
        leaf = folders.setdefault(brand, {}).setdefault(kind, {})
        if size <= 40:
            leaf[f"{key}.txt"] = (short(name.encode()), len(name), size)

    def folded(entries, override=None):
        h = [short(described(*e)) for _, e in sorted(entries.items())]
        return (tree(h)[-1][0] if h else bytes.fromhex(merkle.EMPTY_ROOT), sum(e[1] for e in entries.values()), sum(e[2] for e in entries.values()) if override is None else override)

    brands = {b: folded({k: folded(leaf) for k, leaf in kinds.items()}, 7 if b.endswith("2") else None) for b, kinds in folders.items()}
    root = folded(brands)
    assert {r.path: r.hex for r in rows if r.kind == "root"} == {"": root[0].hex()}
    descs = {r.path: r.hex for r in rows if r.kind == "desc"}
    assert descs[""] == described(*root).hex()
    assert all(descs[b] == described(*e).hex() for b, e in brands.items())
    assert all(descs[f"{b}/{k}/{n}"] == described(*e).hex() for b, kinds in folders.items() for k, leaf in kinds.items() for n, e in leaf.items())


def test_cycles_are_errors(spark):
    rows = [("c", "a", "b", 0), ("c", "b", "a", 0), ("c", "x", "a", 0), ("c", "r", None, 0), ("c", "s", "r", 0), ("d", "o", "o", 0)]
    for f in (trees.placed, trees.ancestors):
        with pytest.raises(ValueError, match="cycle"):
            f(spark.createDataFrame(rows[:5], "conv string, id string, parent string, ordinal long")).count()
        with pytest.raises(ValueError, match="cycle"):
            f(spark.createDataFrame(rows[3:], "conv string, id string, parent string, ordinal long")).count()
    fine = trees.placed(spark.createDataFrame(rows[3:5], "conv string, id string, parent string, ordinal long"))
    assert {r.id: r.depth for r in fine.collect()} == {"r": 0, "s": 1}


def test_keys_of_two_columns(spark):
    rows = spark.createDataFrame([(1, 2), (1, None), (3, 4), (3, 9)], "a int, b int")
    bridge = spark.createDataFrame([(1, 5), (6, 2), (3, 4)], "x int, y int")
    check = (bridge, {"a": "x", "b": "y"})
    assert [tuple(r) for r in relational.accepted(rows, check).collect()] == [(3, 4)]
    assert sorted((tuple(r) for r in relational.rejected(rows, check).collect()), key=repr) == [(1, 2), (1, None), (3, 9)]
    assert relational.rejected(rows, check, (bridge, {"a": "x"})).count() == 3


def test_numbered(spark):
    df = spark.range(1000).withColumnRenamed("id", "n").repartition(7)
    got = relational.numbered(df).collect()
    assert sorted(r.id for r in got) == list(range(1, 1001)) and len({r.n for r in got}) == 1000
    assert relational.numbered(df, "n").columns == ["id"]
    with pytest.raises(ValueError, match="no column"):
        relational.numbered(df, "zzz")


def test_typed(spark):
    rows = ['{"prompt": "a", "response": null}', '{"prompt": "a", "response": "b"}', '{"prompt": null, "response": "b"}', '{"prompt": "a"}', '{"prompt": "a", "response": 1}', '{"prompt": "a", "response": "b", "x": 1}', "[]", "{", None, "1"]
    good, bad = relational.typed(spark.createDataFrame([(r,) for r in rows], "value string"), {"prompt": "STRING", "response": "STRING"}, ("prompt",))
    assert sorted(r.value for r in good.collect()) == sorted(rows[:2]) and bad.count() == 8


def test_vector_update(spark):
    m = spark.createDataFrame([(1, [1.0]), (2, None)], "id int, v array<double>")
    got = similarity.update_vectors(m, spark.createDataFrame([(2, [5.0])], "id int, v array<double>"))
    assert {r.id: r.v for r in got.collect()} == {1: [1.0], 2: [5.0]}
    with pytest.raises(Exception, match="no message with the id 9"):
        similarity.update_vectors(m, spark.createDataFrame([(9, [5.0])], "id int, v array<double>")).collect()


def test_prompt_marks_every_option(spark):
    fill = lambda template, option, name="N": spark.range(1).select(X.fill_prompt(F.lit(template).cast("string"), F.lit(option), F.lit("try A.B here"), F.lit(name), F.lit("the description")).alias("x")).first().x
    assert fill("a.b {option}  {dynamic_prompt}", "A.b", "the A.B way") == "the *A.B* way - *A.b* *a.b* try *a.b* here!"
    assert fill("x {option}", "aXb") == "N - X *axb*!"
    assert fill(None, "the") == "N - *The* description!"
    assert fill("q {option}", "\\Ed$1") == "N - Q *\\ed$1*!"


def test_zero_similarity_fills(spark):
    users = spark.createDataFrame([(i,) for i in range(1, 9)], "user int")
    pairs = spark.createDataFrame([(5, 8, 0.5), (8, 5, 0.5), (5, 1, -0.3), (1, 5, -0.3)], "user int, other int, similarity double")
    got: dict = {}
    for r in recommend.similar(pairs, users, 3).orderBy("user", "rank").collect():
        got.setdefault(r.user, []).append(r.other)
    assert got[5] == [8, 2, 3] and got[8] == [5, 1, 2] and got[1] == [2, 3, 4] and got[2] == [1, 3, 4]
    ratings = spark.createDataFrame([(1, 10, None), (2, 11, 0), (2, 12, 3), (3, 12, 4)], "user int, item int, rating int")
    items = {(r.user, r.item) for r in recommend.recommend_items(ratings, users.where("user < 4")).collect()}
    # unrated items of others count, and one's own that one did not rate
    assert items == {(1, 11), (1, 12), (2, 10), (3, 10), (3, 11)}


def test_new_types_against_all(spark):
    import random

    random.seed(3)
    cards = [(random.randrange(30), i) for i in range(200)]
    owned = [(u, t) for u in range(12) for t in random.sample(range(30), random.randrange(1, 30))]
    got: dict = {}
    for r in recommend.new_types(spark.createDataFrame(owned, "user int, type int"), spark.createDataFrame(cards, "type int, card int")).orderBy("user", "rank").collect():
        got.setdefault(r.user, []).append(r.card)
    for u in range(12):
        mine = {t for x, t in owned if x == u}
        assert got.get(u, []) == [c for t, c in cards if t not in mine][:3]


def test_rewind_stops_at_roots(spark):
    rows = [("c", "r", None, 0), ("c", "a", "r", 0), ("c", "b", "r", 1), ("c", "b1", "b", 0), ("d", "r", None, 0)]
    n = spark.createDataFrame(rows, "conv string, id string, parent string, ordinal long")
    assert sorted((r.conv, r.id) for r in trees.rewind(n, 2).collect()) == [("c", "a"), ("c", "r"), ("d", "r")]
    assert trees.rewind(n, 99).count() == 2


def test_story(spark):
    s = [("r", 0, "**Part 1: A: tale\n\n\n"), ("r", 1, "plain"), ("r", 2, "own\n\n"), ("r", 3, "** Part none")]
    df = spark.createDataFrame(s, "run string, n int, segment string")
    assert history.story(df, delimiter="|").first().story == "tale\n\nplain|own\n\n** Part none|"
    assert history.story(df, special=False).first().story == "".join(x[2] for x in s)
    m = spark.createDataFrame([("c", i) for i in range(3)], "conv string, turn int")
    assert history.without_last(m, 0).count() == 3 and history.without_first(m, 5).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "x"\nb', 1), (2, None, 2), (3, "c,d", 3)], "batch int, text string, n int")
    files.csv_batches(df, str(tmp_path / "c"))
    assert {(r.batch, r.text) for r in files.csv_rows(spark, str(tmp_path / "c"), "text string, n int, batch int").collect()} == {(1, 'a "x"\nb'), (2, None), (3, "c,d")}
    assert files.append(df, str(tmp_path / "p")).count() == 3 and files.append(df, str(tmp_path / "p")).count() == 6
    df.createOrReplaceTempView("t_one")
    assert set(files.named_tables(spark, "t_one")) == {"t_one"} and files.named_tables(spark, "t_one")["t_one"].count() == 3
    with pytest.raises(ValueError, match="no tables"):
        files.named_tables(spark, "t_two")
    (tmp_path / "n").mkdir()
    for name in ("p7.txt", "p10x3.txt", "none.txt"):
        (tmp_path / "n" / name).write_text("x")
    assert sorted(r.n for r in files.prompt_numbers(spark, str(tmp_path / "n")).collect()) == [7, 10]


def test_written_and_discarded(spark):
    df = shared.written(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "t")
    kept = shared.written(df, "u")
    shared.discard(df)
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)path|exist"):
        df.count()


def test_similar_by_types_is_jaccard(spark, monkeypatch):
    import random

    monkeypatch.setattr(recommend, "BLOCK_USERS", 7)
    monkeypatch.setattr(recommend, "TILE_TYPES", 5)
    random.seed(5)
    owned = spark.createDataFrame([(u, t) for u in range(40) for t in random.sample(range(25), random.randrange(1, 12))] + [(40, 99), (41, None)], "user long, type int")
    want = recommend.similar(recommend.jaccard(owned), owned.select("user").distinct(), 4)
    rows = lambda df: sorted((r.user, r["rank"], r.other, r.similarity) for r in df.collect())
    assert rows(recommend.similar_by_types(owned, 4)) == rows(want)


def test_novelty_counts(spark):
    from pyspark.sql import Window as W

    rows = [("c", 0, "A b a"), ("c", 1, ""), ("c", 2, "b B c"), ("c", 3, None), ("c", 4, "x y z q w e"), ("d", 0, ""), ("d", 5, "a")]
    df = spark.createDataFrame(rows, "conv string, turn int, text string")
    past = F.array_join(F.collect_list("text").over(W.partitionBy("conv").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), " ")
    want = {(r.conv, r.turn): r.x for r in df.select("conv", "turn", X.novelty(F.coalesce("text", F.lit("")), past).alias("x")).collect()}
    got = {(r.conv, r.turn): r.novelty for r in history.novelty(df).collect()}
    assert got == pytest.approx(want)


def test_proofs_of_many_levels(spark):
    """Trees of several bands and odd sizes; no join by tree and level alone, which would meet each leaf with its whole level."""
    data = {n: [short(f"{n}/{i}".encode()) for i in range(n)] for n in (1, 2, 3, 64, 65, 127, 129, 4097)}
    leaves = spark.createDataFrame([(n, i, bytearray(x)) for n, xs in data.items() for i, x in enumerate(xs)], "tree int, pos int, hash binary")
    nodes = merkle.levels(leaves)
    made = merkle.proofs(nodes, leaves)
    got = {(r.tree, r.pos): [bytes(x) for x in r.proof] for r in made.collect()}
    want = {}
    for n, xs in data.items():
        rows = tree(xs)[:-1]
        for i in range(n if n > 1 else 0):
            want[n, i] = [row[(i >> k) ^ 1] if (i >> k) ^ 1 < len(row) else row[i >> k] for k, row in enumerate(rows)]
    assert got == want
    joins = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in x]
    assert joins and all("key" in x or "tree" in x and "level" not in x for x in joins)
