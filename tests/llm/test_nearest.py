"""Nearest examples over the vocabulary."""

import numpy as np

from skein.llm import toxicity


def made(rng, n, terms):
    out = []
    for _ in range(n):
        v = {int(t): float(rng.random()) + 0.1 for t in rng.choice(terms, rng.integers(1, 6), replace=False)}
        norm = np.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def test_blocks_are_visited_together(monkeypatch):
    rng, ranked, lexsort = np.random.default_rng(3), [], np.lexsort
    index = toxicity.Index(made(rng, 2000, 12), block=8)
    monkeypatch.setattr(np, "lexsort", lambda keys: ranked.append(1) or lexsort(keys))
    for q in made(rng, 20, 12):
        ranked.clear()
        index.nearest(q, 10)
        assert len(ranked) <= 2  # however many blocks can hold one of the nearest


def test_nearest_with_repeated_examples():
    rng = np.random.default_rng(4)
    vectors = made(rng, 500, 20)
    index, weights = toxicity.Index(vectors, block=8), rng.integers(1, 5, 500).astype(float)
    for q in made(rng, 100, 24):
        cos = np.array([sum(x * v.get(t, 0.0) for t, x in q.items()) for v in vectors])
        rank = np.lexsort((np.arange(500), -cos))
        rank = rank[cos[rank] > 0]
        at_k = int(np.searchsorted(np.cumsum(weights[rank]), 10))
        want = rank[cos[rank] >= cos[rank[min(at_k, len(rank) - 1)]] - 1e-12] if len(rank) else rank
        found, got = index.nearest(q, 10, weights)
        assert set(found.tolist()) == set(want.tolist())
        assert np.allclose(got, np.minimum(cos[found], 1.0))
