"""The passes of the substring operator read many texts as one; their rows are those of each text alone, at a bounded size."""

import random

import pyarrow as pa

from braidwork.llm import substrings


def batch(texts):
    ids = pa.array(range(len(texts)))
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts, pa.string())], ["doc_id", "text_hash", "text"])


def test_paths_of_many_texts_are_those_of_each():
    r = random.Random(4)
    texts = [None, "", "one", "x " * 34, "x " * 35, "x " * 90] + [" ".join(r.choice(["a", "b", "cc", "é"]) for _ in range(r.randrange(20, 400))) for _ in range(60)]
    together = [row for b in substrings._find_paths(35, 15)([batch(texts)]) for row in b.to_pylist()]
    alone = [row | {"doc_id": i, "text_hash": i} for i, t in enumerate(texts) for b in substrings._find_paths(35, 15)([batch([t])]) for row in b.to_pylist()]
    key = lambda row: (row["doc_id"], row["mer"], row["path"], row["check"])
    assert sorted(together, key=key) == sorted(alone, key=key)
    covered = [sum(len(row["starts"]) * row["n"] for row in together if row["doc_id"] == i) for i in range(len(texts))]
    assert covered == [max(len((t or "").split()) - 34, 0) for t in texts]  # every window of every text once


def test_parts_are_bounded_and_texts_are_hashed_together(monkeypatch):
    assert [len(p) for p in substrings._parts(batch(["a" * 10] * 5 + ["b" * 100, None, "c"]), most=3, size=40)] == [3, 2, 1, 2]
    reads = []
    real = substrings.Hasher.read
    monkeypatch.setattr(substrings.Hasher, "read", lambda self, words: (reads.append(len(words)), real(self, words))[1])
    list(substrings._find_paths(35, 15)([batch(["w " * 50] * 100)]))
    assert reads == [5000]  # one pass, not a hundred
