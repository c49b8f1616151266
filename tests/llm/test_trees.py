"""Boosted trees against an exhaustive search for the first split, and isotonic rates against a plain pooling."""

import numpy as np
import pytest

from loomwork.llm import toxicity


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_split_is_the_best(monkeypatch, seed):
    monkeypatch.setattr(toxicity, "TREES", 1)
    monkeypatch.setattr(toxicity, "DEPTH", 1)
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (40, 3)).astype(float)
    y = (rng.random(40) < 0.2 + 0.5 * (x[:, seed % 3] > 2)).astype(float)
    model = toxicity.boost(x, y)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    g, h = y - p, np.full(40, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(
        (score(x[:, j] <= c) + score(x[:, j] > c) - score(np.ones(40, bool)), j, c)
        for j in range(3) for c in range(6)
        if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= 0.5
    )
    j, c = int(model.feature[0][0]), float(model.cut[0][0])
    gain = score(x[:, j] <= c) + score(x[:, j] > c) - score(np.ones(40, bool))
    assert abs(gain - best[0]) < 1e-9
    left = x[:, j] <= c
    want = [0.15 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)]
    assert np.allclose(model.value[0], want) and np.allclose(model.margin(x), model.base + np.where(left, *want))


def test_isotonic_weights_are_repeats():
    rng = np.random.default_rng(5)
    m, y, w = np.sort(rng.normal(size=30)), rng.random(30), rng.integers(1, 5, 30)
    one = toxicity.isotonic(m, y, w.astype(float))
    many = toxicity.isotonic(np.repeat(m, w), np.repeat(y, w))
    assert np.allclose(np.interp(m, *one), np.interp(m, *many)) and (np.diff(one[1]) >= -1e-12).all()
    assert abs((np.interp(m, *one) * w).sum() - (y * w).sum()) < 1e-9
