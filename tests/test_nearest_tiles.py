"""The nearest of blocks against a full sort, with many ties, and how many scores are rounded."""

import numpy as np
import pytest

from braidwork.operators import similarity as S


@pytest.mark.parametrize("measure", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("k", [1, 3, 20])
def test_against_a_full_sort(monkeypatch, measure, k):
    monkeypatch.setattr(S, "TILE", 64)
    rng = np.random.default_rng(k)
    y = rng.integers(-2, 3, (500, 4)).astype(float)  # few different vectors: nearly all scores tie
    y[::7] = rng.normal(size=(len(y[::7]), 4))
    j = rng.permutation(5000)[:500].astype(np.int64)
    for skip, n in ((True, 500), (False, 500), (True, 5), (True, 65)):
        ids, scores = S.nearest_of(y[:200], j[:200], y[:n], j[:n], k, measure, skip)
        compare, more = S.MEASURES[measure]
        full = S.rounded(compare(y[:200], y[:n]), 6)
        for row in range(200):
            order = sorted((-full[row, c] if more else full[row, c], j[c]) for c in range(n) if not skip or j[c] != j[row])[:k]
            fine = np.isfinite(scores[row])
            assert [(round(-s if more else s, 5), d) for s, d in zip(scores[row][fine], ids[row][fine])] == [(round(s, 5), d) for s, d in order]


def test_few_scores_are_rounded(monkeypatch):
    """Only those that may be among the best, where every score was before."""
    x = np.random.default_rng(1).normal(size=(4096, 64))
    i, seen, plain = np.arange(len(x)), [], S.rounded
    monkeypatch.setattr(S, "rounded", lambda s, digits: seen.append(s.size) or plain(s, digits))
    S.nearest_of(x, i, x, i, 10)
    assert 10 * len(x) <= sum(seen) < len(x) ** 2 / 50
