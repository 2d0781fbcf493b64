"""Exact neighbours in groups of bounded size."""

import numpy as np
import pytest

from braidwork.operators import similarity as S


def test_groups_are_bounded():
    assert all(n / S.parts_of(n) <= S.GROUP_ROWS for n in (0, 1, 200_000, 1_000_000, 10**8))


@pytest.mark.parametrize("some", [False, True])
def test_tiles_and_groups_agree_with_brute_force(spark, monkeypatch, some):
    monkeypatch.setattr(S, "GROUP_ROWS", 7)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(120, 4)))
    x[40:60] = x[0]  # ties
    ids = rng.permutation(1000)[:120]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {}
    for r, i in enumerate(ids.tolist()):
        if not some or i % 10 == 0:
            s = np.round(unit @ unit[r], 6)
            want[i] = [(int(ids[c]), float(s[c])) for c in np.lexsort((ids, -s)) if ids[c] != i][:3]
    v = spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "id long, v array<double>")
    got: dict = {}
    for r in S.all_neighbours(v, 3, of=v.where("id % 10 = 0") if some else None).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, r.score + 0.0))
    assert {i: [o for o, _ in g] for i, g in got.items()} == {i: [o for o, _ in w] for i, w in want.items()}
    monkeypatch.setattr(S, "TILE", 16)
    out, _ = S.nearest_of(unit, ids, unit, ids, 3)
    for r, i in enumerate(ids.tolist()):
        assert i not in want or out[r].tolist() == [o for o, _ in want[i]]
