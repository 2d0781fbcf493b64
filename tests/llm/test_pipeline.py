"""The pipeline's rows against a brute-force version of its stages."""

import hashlib
import re

import corpus_pipeline
from braidwork.llm import secrets
from braidwork.llm.common import table
from tests.llm.test_edges import brute_leaks, docs
from tests.oracle import DATA, rows_of_sql


def brute_groups(texts: dict) -> dict:
    """The smallest id linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    group = {i: i for i in texts}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def brute_targets(size: dict) -> dict:
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    left, free, target = 1.5 * sum(size.values()), set(size), {}
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * size[s]}
        if not over:
            return target | {s: level * weights[s] for s in free}
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    return target


def test_run(spark):
    # The quality stage against the labels, as its fit cannot be repeated by hand: it drops bad documents and keeps good ones.
    docs_ = table(spark, DATA, "documents")
    passed = {r.doc_id: r for r in corpus_pipeline.quality_filter(spark, docs_, DATA).collect()}
    _, labels = rows_of_sql("SELECT doc_id, quality FROM labels", DATA)
    assert sum((i in passed) == (q == 1) for i, q in labels) >= 0.97 * len(labels)
    groups = brute_groups({i: r.text for i, r in passed.items()})
    _, items = rows_of_sql("SELECT item_id, text FROM benchmark", DATA)
    clean = {i: r for i, r in passed.items() if groups[i] == i and not brute_leaks(r.text, items)[1]}
    # Secrets have brute-force tests of their own; here every text that changed is one with a mark for a secret.
    safe = {r.doc_id: r.text for r in secrets.redact(secrets.find_secrets(docs(spark, [(i, r.text) for i, r in clean.items()]))).collect()}
    for i, text in safe.items():
        assert text == clean[i].text or "[REDACTED]" in text
        assert not re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", text or "")
    size = {i: len((t or "").encode().split()) for i, t in safe.items()}
    total: dict = {}
    for i, r in clean.items():
        total[r.source] = total.get(r.source, 0) + size[i]
    target = brute_targets(total)
    want = []
    for i, r in clean.items():
        rate = target[r.source] / total[r.source]
        coin = int(hashlib.md5(f"17:{i}:{hashlib.md5((safe[i] or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        chars = r.n_chars if safe[i] == r.text else len(safe[i])
        want += [(i, safe[i], r.lang, r.source, chars, k + 1) for k in range(int(rate) + (coin < rate - int(rate)))]
    got = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, r.copy) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
