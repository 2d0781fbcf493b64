"""Nulls, empty tables, repeats, clashing columns and hand-made cases of each operator."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import decontaminate, language, mixing, neighbours, quality, scoring, secrets, simhash, substrings, urls
from braidwork.llm.common import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(200)]


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], schema)


def edge_rows():
    long = " ".join(WORDS * 100)
    return [(1, None), (2, ""), (3, "   "), (4, "one"), (4, "one"), (None, "one two three four"), (None, None), (5, long), (6, long), (7, "ÀÉ ñ 中文 Ünï")]


OPERATORS = {
    "lm": lambda s, d: scoring.score_documents(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "quality": lambda s, d: quality.classify(d, quality.fit(d, s.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int"))),
    "secrets": lambda s, d: secrets.redact(secrets.find_secrets(d)),
    "language": lambda s, d: language.detect(d, language.fit(d)),
    "leaks": lambda s, d: decontaminate.find_leaks(d, s.createDataFrame([(1, " ".join(WORDS[:12])), (2, None), (None, "one two"), (3, "one"), (3, "one"), (4, "")], "item_id long, text string")),
    "mix": lambda s, d: mixing.emit(mixing.mix(d)),
    "repeats": lambda s, d: substrings.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    rows = edge_rows()
    got = OPERATORS[name](spark, docs(spark, rows)).collect()
    if name != "mix":
        assert len(got) == len(rows)
    assert OPERATORS[name](spark, docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "a b c", "en", "s", 3)])
    for c in ("Score", "SPANS", "n_words", "rate", "copy", "fp", "block", "text_hash", "held_out", "kept_text", "_hash", "items", "taken", "Lang_Pred", "_said", "_row"):
        clash = clash.withColumn(c, F.lit("x"))
    OPERATORS[name](spark, clash).collect()


def test_lm_counts(spark):
    d = docs(spark, [(1, "a b a b"), (2, "A b c"), (3, None)])
    got = {r.doc_id: r for r in scoring.score_documents(d, order=2).collect()}
    # words 7: a 3, b 3, c 1; pairs "a b" 3, the others once
    one = lambda c: math.log(c / 7)
    assert got[1].lm_score == pytest.approx(one(3) + 2 * math.log(3 / 3) + math.log(0.4) + one(3))
    assert got[2].lm_score == pytest.approx(one(3) + math.log(3 / 3) + math.log(0.4) + one(1))
    assert (got[3].n_words, got[3].lm_score, got[3].mean_score) == (0, 0.0, None)


def test_lm_blocks_agree(spark):
    d = docs(spark, [(i, " ".join(np.random.default_rng(i).choice(WORDS[:30], 50))) for i in range(40)])
    a, b = (sorted((r.doc_id, round(r.lm_score, 6)) for r in scoring.score_documents(d, block_bytes=n).collect()) for n in (1 << 20, 500))
    assert a == b


@pytest.mark.parametrize(("least", "order"), [(1, 3), (2, 3), (3, 3), (2, 4), (2, 1)])
def test_lm_brute(spark, monkeypatch, least, order):
    monkeypatch.setattr(scoring, "BUCKET_GRAMS", 100)
    rng = np.random.default_rng(least)
    rows = [(i, " ".join(rng.choice(WORDS[: 5 + i], int(rng.integers(0, 40))))) for i in range(30)] + [(5, "x" * 3_000_000), (6, "x" * 3_000_000)]
    count: dict = {}
    for _, t in rows:
        w = t.split()
        for n in range(1, order + 1):
            for k in range(n, len(w) + 1):
                g = tuple(w[k - n : k])
                count[g] = count.get(g, 0) + 1
    total = sum(c for g, c in count.items() if len(g) == 1)
    want = []
    for i, t in rows:
        w, s = t.split(), 0.0
        for k in range(1, len(w) + 1):
            longest = min(order, k)
            n = next((n for n in range(longest, 1, -1) if count[tuple(w[k - n : k])] >= least), 1)
            s += math.log(count[tuple(w[k - n : k])] / (count[tuple(w[k - n : k - 1])] if n > 1 else total)) + (longest - n) * math.log(0.4)
        want.append((i, len(w), round(s, 6)))
    got = scoring.score_documents(docs(spark, rows), order=order, min_count=least, block_bytes=300).collect()
    assert sorted((r.doc_id, r.n_words, round(r.lm_score, 6)) for r in got) == sorted(want)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_bit_slices(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    tile = np.array([base[i % 4] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for i in range(n)], np.uint64)
    for radius in (0, 1, 2):
        hits = np.unpackbits(simhash.near(tile, simhash.planes(tile), n, radius).view(np.uint8), axis=1, bitorder="little")[:, :n]
        assert (hits == (np.bitwise_count(tile[:, None] ^ tile[None, :]) <= radius)).all()


def test_forest_and_hot_meetings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    prints = {0}
    while len(prints) < 400:  # walks of single bits, so that chains form
        p = list(prints)[rng.integers(len(prints))]
        prints.add(p ^ (1 << int(rng.integers(0, 63))))
    prints = np.array(sorted(prints), np.int64)
    near = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= 2
    label = np.arange(len(prints))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(prints))])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    for hot in (4096, 8):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
        for i, p in enumerate(prints.tolist()):
            assert got.get(p, p) == prints[label[i]]


def test_keep_one(spark):
    text = " ".join(WORDS[:60])
    d = docs(spark, [(3, text), (2, text), (2, text), (9, " ".join(WORDS[60:120])), (None, text), (None, " ".join(WORDS[120:180]))])
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(d).collect()) == [0, 2, 9]


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 0, 1.0]), np.ones(6))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()
    assert y[0] == 0 and y[-1] == 1


def test_secrets(spark):
    token = "dGhpc0lzQVZlcnlMb25nU2VjcmV0MTIzNDU2"
    cases = {
        1: f"my password = '{'x' * 12}' and AKIA{'Q1' * 8}",
        2: "password: token: abcdefghijklmnop",  # the failing match takes the second word along
        3: f"key {token} here",
        4: f"example {token}EXAMPLE",
        5: "deadbeefdeadbeef 0123456789abcdef0",
        6: "API-KEY=abcdefghijkl apikey=abcdefghijkl Api_Key:abc",
        7: "é" * 5 + "0123456789abcdef",
        8: "thiswordisverylongbuthasnodigitsatall",
    }
    got = {r.doc_id: r for r in secrets.find_secrets(docs(spark, cases.items())).collect()}
    spans = {i: [(x.kind, x.start, x.end) for x in r.spans] for i, r in got.items()}
    for i, text in cases.items():
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert [s for s in spans[i] if not s[0].startswith("entropy")] == sorted(want, key=lambda s: s[1])
    assert [s[0] for s in spans[3]] == ["entropy_base64"] and spans[3][0][1] >= 4 and spans[3][0][2] <= 4 + len(token)
    assert spans[4] == spans[8] == []
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.find_secrets(docs(spark, cases.items()))).collect()}
    assert clean[1] == "my [REDACTED]' and [REDACTED]" and clean[8] == cases[8]


def test_incremental_entropy(spark):
    rng = np.random.default_rng(3)
    kind, (symbols, _, groups, least) = "entropy_base64", secrets.CLASSES["entropy_base64"]
    texts = ["".join(rng.choice(list("ABCDEFGHabcdefgh0123456789+"), 60)) for _ in range(20)] + ["aB3" * 20, "A" * 30 + "b1" * 10]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs(spark, enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        covered = set()
        for s in range(len(t) - 19):
            w = t[s : s + 20]
            h = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
            if h >= least - 1e-9 and all(any(c in symbols[a - 1 : b] for c in w) for a, b in groups):
                covered |= set(range(s, s + 20))
        assert {p for x in got[i] if x.kind == kind for p in range(x.start, x.end)} == covered


def test_url_rules(spark):
    urls_ = ["http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "x://org", "http://notexample.org/", "http://a.com/fr/", "http://com/de/1", "nothing", None, "http://example.org:80/", "http:///p", "http://b.org?q=/es/", "http://.org/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls_)], "page_id long, url string, Rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark)).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("org", "", None, "allow")
    assert got[3] == ("notexample.org", "/", "org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("example.org:80", "/", None, "allow") and got[9] == ("", "/p", None, "allow")
    assert got[10] == ("b.org", "", None, "allow") and got[11][2] == "org/"
    assert urls.judge(pages, urls.rule_table(spark).limit(0)).where("rule IS NOT NULL").count() == 0
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).count() == 0


def test_language_spans(spark):
    en, fr = "the house and the garden with this that", "le jardin et la maison avec cette voiture"
    train = [(i, (en if i % 2 else fr), "en" if i % 2 else "fr") for i in range(60)] + [(100, "дом и сад", "ru")] * 3
    d = docs(spark, train)
    model = language.fit(d)
    mixed = f"{en}. {fr}! дом и сад 123"
    got = language.spans(docs(spark, [(1, mixed), (2, None), (3, "123 !")]), model).orderBy("doc_id").collect()
    assert [s.lang for s in got[0].lang_spans] == ["en", "fr", "ru"]
    assert mixed[got[0].lang_spans[1].start : got[0].lang_spans[1].end] == fr
    assert got[1].lang_spans == [] and got[2].lang_spans == []
    said = {r.doc_id: (r.lang_pred, r.score) for r in language.detect(docs(spark, [(1, en), (2, None), (3, "123 !"), (4, "")]), model).collect()}
    assert said[1] == ("en", 1.0) and said[2] == said[3] == said[4] == ("und", 0.0)


def train_rows():
    rng = np.random.default_rng(6)
    sets = {"en": "abcdefgh", "fr": "efghijéà", "el": "αβγδσςΣ", "zh": "天地玄黄宇宙洪荒"}
    return [(i, " ".join("".join(rng.choice(list(sets[lang]), int(rng.integers(1, 9)))) for _ in range(12)), lang) for i, lang in enumerate(list(sets) * 12)]


def brute_language(rows, text, penalty=6 * 65536):
    """Counts, log scores and Viterbi in plain loops; the words are those of ``pieces``."""
    langs = sorted({r[2] for r in rows})
    count: dict = {lang: {} for lang in langs}
    letters: dict = {lang: {} for lang in langs}
    kinds: dict = {}
    parts = lambda t: [(b - a, w) for token in t.split() for a, b, w in language.pieces(token)]
    runs = lambda w: [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] not in "<>"]
    script = lambda w: language.script(w.lstrip("<")[0])
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            for n, w in parts(t):
                letters[lang][script(w)] = letters[lang].get(script(w), 0) + n
                for g in runs(w):
                    count[lang][g] = count[lang].get(g, 0) + 1
                    kinds[g] = 1
    total = {lang: sum(count[lang].values()) + 0.5 * (len(kinds) + 1) for lang in langs}

    def emit(w):
        s = [sum(math.log((count[lang].get(g, 0) + 0.5) / total[lang]) for g in runs(w)) for lang in langs]
        norm = max(s) + math.log(sum(math.exp(x - max(s)) for x in s))
        own = [letters[lang].get(script(w), 0) >= 0.01 * sum(letters[lang].values()) and any(script(w) in letters[x] for x in langs) for lang in langs]
        return [round(max(x - norm, -8.0) * 65536) - (0 if ok or not any(own) else 16 * 65536) for x, ok in zip(s, own)]

    words = parts(text or "")
    if not words:
        return "und", 0.0
    best, paths = None, None
    for n, w in words:
        e = emit(w)
        if best is None:
            best, paths = e, [[k] for k in range(len(langs))]
            continue
        top = max(range(len(langs)), key=lambda k: (best[k], -k))
        go = [(best[k], paths[k]) if best[k] >= best[top] - penalty else (best[top] - penalty, paths[top]) for k in range(len(langs))]
        best, paths = [v + e[k] for k, (v, _) in enumerate(go)], [[*p, k] for k, (_, p) in enumerate(go)]
    labels = paths[max(range(len(langs)), key=lambda k: (best[k], -k))]
    share = [sum(n for (n, _), x in zip(words, labels) if x == k) for k in range(len(langs))]
    k = max(range(len(langs)), key=lambda k: (share[k], -k))
    return langs[k], share[k] / sum(share)


def test_language_brute(spark):
    rows = train_rows()
    rng = np.random.default_rng(7)
    mixed = [(1000 + i, " ".join(str(rng.choice(rows[int(rng.integers(len(rows)))][1].split())) for _ in range(int(rng.integers(1, 30))))) for i in range(60)]
    mixed += [(2000, "天地玄黄宇宙洪荒" * 1250 + "abcdefgh" * 20), (2001, "a" * 10_000), (2002, "² ½ 123 ①"), (2003, "ª"), (2004, "αβγabcαβγ " * 5), (2005, "İİ abc"), (2006, "é́a é")]
    got = language.detect(docs(spark, mixed), language.fit(docs(spark, rows))).collect()
    for r in got:
        lang, score = brute_language(rows, r.text)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, abs=1e-6)), r.text[:50]
    assert {r.doc_id: r.lang_pred for r in got}[2002] == "und" and {r.doc_id: r.lang_pred for r in got}[2000] == "zh"


def test_language_pieces():
    for token in ("x" * 10_000, "天" * 200, "ab中c", "İıẞ", "a1b2", "éa", "—a—", "１a"):
        found = language.pieces(token)
        assert "".join(token[a:b] for a, b, _ in found) == "".join(language.WORD.findall(token))
        assert all(b - a <= language.PIECE for a, b, _ in found)
        assert all(w.strip("<>") == token[a:b].lower() for a, b, w in found)


def test_language_span_borders(spark):
    en, fr = "the house and the garden with this that", "le jardin et la maison avec cette voiture"
    model = language.fit(docs(spark, [(i, (en if i % 2 else fr), "en" if i % 2 else "fr") for i in range(60)]))
    text = f"İ İ İ İ {en} {fr}"
    (r,) = language.spans(docs(spark, [(1, text)]), model).collect()
    assert text[r.lang_spans[-1].start : r.lang_spans[-1].end] == fr


def test_viterbi_brute():
    from itertools import product

    rng = np.random.default_rng(0)
    emit = rng.normal(size=(30, 3)).astype(np.float32) * 3
    lengths = np.array([0, 4, 1, 6, 0, 3])
    flat = rng.integers(0, 30, lengths.sum())
    got, at = language.viterbi(lengths, flat, emit, 2.0), 0
    for n in lengths:
        ids = flat[at : at + n]
        score = lambda path: sum(emit[i, k] for i, k in zip(ids, path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        if n:
            assert score(got[at : at + n]) == pytest.approx(max(map(score, product(range(3), repeat=int(n)))), abs=1e-4)
        at += n


def test_leaks_short_items_and_folding(spark):
    items = spark.createDataFrame([(10, " ".join(WORDS[:15])), (9, "alpha beta"), (8, "K"), (7, "?!")], "item_id long, text string")
    rows = [(1, "x " + " ".join(WORDS[3:14]).upper() + " y"), (2, " ".join(WORDS[:9])), (3, "Alpha, BETA! alpha"), (4, "\u212a"), (5, "k K")]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.find_leaks(docs(spark, rows), items).collect()}
    assert got[1] == (13, 11, ["10"], True) and got[2] == (9, 0, [], False)
    assert got[3] == (3, 2, ["9"], True)
    assert got[4] == (1, 0, [], False) and got[5] == (2, 2, ["8"], True)


def test_winnowing_guarantee(spark):
    rng = np.random.default_rng(5)
    shared = [str(x) for x in rng.integers(0, 6, 10)]
    rows = [(i, " ".join([str(x) for x in rng.integers(0, 6, 30)] + shared + [str(x) for x in rng.integers(0, 6, 30)])) for i in range(50)]
    items = spark.createDataFrame([(1, " ".join(shared))], "item_id long, text string")
    assert decontaminate.find_leaks(docs(spark, rows), items).where("NOT contaminated").count() == 0


def test_mix_null_ids(spark):
    d = docs(spark, [(None, f"w{i} x", None, "s") for i in range(2000)])
    rows = mixing.mix(d).collect()
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * 4000, rel=0.08)


def test_targets(spark):
    sizes = [("b", 100), ("a", 1000), (None, 10), ("c", 1000)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weight, cap = {"a": 5, "b": 2, "c": 1, None: 5}, {s: 2 * n for s, n in sizes}
    left, want, free = 1.5 * 2110, {}, set(weight)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap[s]}
        if not over:
            break
        for s in over:
            want[s] = cap[s]
            left -= cap[s]
        free -= over
    want |= {s: level * weight[s] for s in free}
    assert got == pytest.approx(want)


def test_mix_copies(spark):
    d = docs(spark, [(i, "w " * (i % 7 + 1), None, "s") for i in range(500)])
    rows = mixing.mix(d).collect()
    assert {r.copies for r in rows} == {1, 2} and sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.05)
    assert mixing.emit(mixing.mix(d)).count() == sum(r.copies for r in rows)


def test_secrets_beside_allowed_words_and_patterns(spark):
    key, tail = "Zx9Qw3Er7Ty1Ui5Op2As8Df4Gh6Jk0", "Ui5Op2As8Df4Gh6Jk0Lz"
    cases = {
        1: f"use sample_key={key} here",  # the allow-list speaks for its piece only
        2: f"id Zx9Qw3Er7Ty0123456789abcdef{tail} end",  # a pattern found the middle
        3: f"password: {key} end",  # found whole by a pattern
        4: f"see example-{key[:19]}-{key[:10]} end",  # no other piece is as long as a window
        5: "id 123e4567-e89b-12d3-a456-426614174000 end",
        6: f"see sample{key} end",
    }
    found = secrets.find_secrets(docs(spark, cases.items()))
    clean = {r.doc_id: r.text for r in secrets.redact(found).collect()}
    assert not any(key in clean[i] for i in (1, 3)) and clean[1].endswith("[REDACTED] here")
    assert clean[2] == "id [REDACTED] end" and clean[3] == "[REDACTED] end"
    assert all(clean[i] == cases[i] for i in (4, 5, 6))
    assert [s.kind for r in found.where("doc_id = 3").collect() for s in r.spans] == ["assign"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(cases.items()))
    want = {r[0]: r[-1] for r in con.execute(secrets.OP4_SQL).fetchall()}
    got = {r.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans) for r in found.collect()}
    assert got == want


def test_nearest_edges(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8)).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(10)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [1.0]), (None, base[1]), (3, base[3])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.nearest(d, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100}
    assert [v for _, v, _ in sorted(got[0])] == [100, 101, 102, 103, 104] and [v for _, v, _ in sorted(got[100])] == [0, 101, 102, 103, 104]
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    (r,) = neighbours.nearest(two, F.col("vec_id") % 50 == 0).collect()
    assert (r.query_id, r["rank"], r.vec_id) == (0, 1, 1) and r.score == pytest.approx(math.sqrt(0.5))
    assert neighbours.nearest(two.limit(0), F.lit(True)).count() == 0


def brute_nearest(rows, queries, k=5):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        out[q] = [int(ids[i]) for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:k]
    return out


def recall(got, want):
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(want)
    return sum(len(found[q] & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def test_nearest_extreme_sizes(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [5e-324, 5e-324]), (3, [0.0, 1e-160]), (4, [1.7e308, -1.7e308]), (5, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "id", "packed", "Asks")})
    got = {(r.query_id, r.vec_id): r.score for r in neighbours.nearest(d, F.col("vec_id") >= 0).collect()}
    assert got[0, 5] == 1.0 and got[1, 2] == pytest.approx(1.0) and got[0, 3] == 0.0 and got[1, 4] == 0.0 and len(got) == 30


def test_nearest_narrow_walk(spark):
    rng = np.random.default_rng(12)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(5000, 32)).tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, F.col("vec_id") % 50 == 0, width=64).collect()
    assert recall(got, brute_nearest(rows, range(0, 5000, 50))) >= 0.9


def test_nearest_clusters_of_near_copies(spark):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 1e-4 * rng.normal(size=16)).tolist()) for i in range(1800)] + [(1800 + i, rng.normal(size=16).tolist()) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, F.col("vec_id") % 50 == 0).collect()
    assert recall(got, brute_nearest(rows, range(0, 2000, 50))) >= 0.95


@pytest.mark.parametrize("noise", [0.001, 0.01, 0.03])
def test_nearest_clusters_larger_than_a_walk(spark, noise):
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(4, 64))
    rows = [(i, (centres[i % 4] + noise * rng.normal(size=64)).tolist()) for i in range(4000)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, F.col("vec_id") % 50 == 0).collect()
    assert recall(got, brute_nearest(rows, range(0, 4000, 50))) >= 0.9


def test_walks_that_do_not_end_are_errors(spark):
    d = spark.createDataFrame([(i, float(np.cos(i / 99)), float(np.sin(i / 99))) for i in range(100)], "id long, x double, y double")
    packed = spark.createDataFrame([(r.id, bytearray(neighbours._pack(np.array([[r.x, r.y]]))[0])) for r in d.collect()], "id long, packed binary")
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(99)], "id long, other long, score float")
    with pytest.raises(RuntimeError, match="did not end"):
        neighbours.search(chain, packed, packed.where("id = 0"), 2, width=50, step=1, most_hops=3)


def test_repeats_brute(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"t{i}" for i in range(50)]
    passage = rng.choice(vocabulary, 80).tolist()
    texts = []
    for i in range(30):
        body = rng.choice(vocabulary, 60).tolist()
        cut = int(rng.integers(0, 40))
        texts.append(body[:20] + (passage[cut : cut + int(rng.integers(30, 41))] if i % 2 else []) + body[20:])
    texts += [["same"] * 100, ["same"] * 34, ["a", "b"] * 40, passage[:35], passage[:34], texts[0], texts[0]]
    window, seen = 35, {}
    for t in texts:
        for p in range(len(t) - window + 1):
            seen[tuple(t[p : p + window])] = seen.get(tuple(t[p : p + window]), 0) + 1
    d = docs(spark, [(i, "\n ".join(t)) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in substrings.remove_repeats(d).collect()}
    for i, t in enumerate(texts):
        gone = {x for p in range(len(t) - window + 1) if seen[tuple(t[p : p + window])] > 1 for x in range(p, p + window)}
        kept = " ".join(w for x, w in enumerate(t) if x not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(t), len(gone), kept), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_paths_compact(spark):
    # a chain of 20, a fork of two from its end, a ring of three, and one alone
    rows = [(i, i, i + 1, 2) for i in range(20)] + [(100, 20, 300, 1), (101, 20, 301, 1)] + [(200 + i, 400 + i, 400 + (i + 1) % 3, 1) for i in range(3)] + [(500, 600, 601, 7)]
    df = spark.createDataFrame([(s, -s, a, b, n) for s, a, b, n in rows], "seg long, sure long, left long, right long, size int")
    got = {r.seg: (r.head.seg, r.offset) for r in substrings.compacted(df).collect()}
    assert got == {i: (0, 2 * i) for i in range(20)} | {s: (s, 0) for s in (100, 101, 200, 201, 202, 500)}


def test_paths_are_where_they_say(spark):
    rng = np.random.default_rng(9)
    words = [f"t{i}" for i in range(30)]
    passage = rng.choice(words, 120).tolist()
    texts = [rng.choice(words, 15).tolist() + passage[a:b] + rng.choice(words, 15).tolist() for a, b in ((0, 120), (10, 90), (40, 120), (0, 60), (60, 119))] + [["a", "b"] * 60]
    found = substrings.path_occurrences(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), 10, 5).collect()
    read: dict = {}  # of each path, the words at each place
    for r in found:
        for start in r.starts:
            for j in range(r.n + 9):
                read.setdefault((tuple(r.head), r["from"] + j), set()).add(texts[r.doc_id][start + j])
    assert all(len(w) == 1 for w in read.values()) and max(r["from"] + r.n for r in found) > 20


def test_remainder(spark):
    rows = spark.range(50).select(quality.remainder(F.col("id"), 4).alias("r"), "id").collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_materialize(spark):
    assert materialize(spark.range(5).toDF("x"), "t").count() == 5


SIGMA = "ΟΔΟΣ"


@pytest.mark.parametrize("sep", [" ", ".", "'", ". ", "-", "́ "])
def test_leaks_capital_sigma(spark, sep):
    item = [f"{SIGMA}{c}{SIGMA}" for c in "ABCDEFGHIJKL"]
    items = spark.createDataFrame([(1, " ".join(item)), (2, SIGMA)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs(spark, [(1, sep.join(item)), (2, f"x{sep}{SIGMA}{sep}y")]), items).collect()}
    if "́" in sep:  # a mark belongs to the word it follows
        assert got[1].n_hit == 0
    else:
        assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (12, 12, ["1"])
        assert got[2].n_hit == 1


def brute_leaks(text, items, window=10):
    cut = lambda t: decontaminate_word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, named = cut(text), set(), set()
    for item, t in items:
        iw = cut(t)
        m = min(window, len(iw))
        for j in range(len(iw) - m + 1) if m else ():
            for p in range(len(w) - m + 1):
                if w[p : p + m] == iw[j : j + m]:
                    hit |= set(range(p, p + m))
                    named.add(str(item))
    return len(w), len(hit), sorted(named)


decontaminate_word = re.compile(decontaminate.WORD)


def test_leaks_random_unicode(spark):
    rng = np.random.default_rng(8)
    letters = list("aAbBkKKΣσςİiIßẞéÉ .'-中")
    pool = ["".join(rng.choice(letters, rng.integers(1, 5))) for _ in range(25)]
    items = [(i, " ".join(rng.choice(pool, int(rng.integers(1, 30))))) for i in range(12)]
    rows = []
    for i in range(40):
        base = rng.choice(pool, 40).tolist()
        copied = items[i % 12][1].split(" ")
        base[10:10] = [w.swapcase() if w.isascii() else w for w in copied[: int(rng.integers(5, 25))]]
        rows.append((i, [" ", "."][i % 2].join(base)))
    frame = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.find_leaks(docs(spark, rows), frame).collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute_leaks(r.text, items), r.text


def test_leaks_of_one_repeated_word(spark):
    items = spark.createDataFrame([(1, "a " * 50_000), (2, "a " * 12), (3, "a")], "item_id long, text string")
    (r,) = decontaminate.find_leaks(docs(spark, [(1, "A " * 50_000 + "b")]), items).collect()
    assert (r.n_words, r.n_hit, r["items"]) == (50_001, 50_000, ["1", "2", "3"])
