"""The graphical lasso by its optimality conditions."""

import numpy as np

from loomwork.operators import sparse


def samples(seed, n=400, p=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 1] += 0.8 * x[:, 0]
    x[:, 3] -= 0.6 * x[:, 2]
    return x


def test_no_penalty_gives_the_inverse():
    s = np.stack([np.cov(samples(k).T, bias=True) for k in range(3)])
    got = sparse.graphical_lasso(s, 0.0)
    assert all(np.allclose(a @ b, np.eye(5), atol=1e-7) for a, b in zip(got, s, strict=True))


def test_optimality():
    s = np.stack([np.corrcoef(samples(k).T) for k in range(4)])
    for penalty in (0.05, 0.3):
        o = sparse.graphical_lasso(s, penalty)
        for a, b in zip(o, s, strict=True):
            gap, off = np.linalg.inv(a) - b, ~np.eye(5, dtype=bool)
            assert np.linalg.eigvalsh(a).min() > 0 and np.allclose(np.diag(gap), 0, atol=1e-7)
            zero = off & (np.abs(a) < 1e-9)
            assert (np.abs(gap[zero]) <= penalty + 1e-7).all()
            some = off & ~zero
            assert np.allclose(gap[some], penalty * np.sign(a[some]), atol=1e-6)
    assert (np.abs(sparse.graphical_lasso(s, 2.0)[:, ~np.eye(5, dtype=bool)]) == 0).all()


def test_edges_of_groups(spark):
    rows = [(k, *map(float, x)) for k in range(3) for x in samples(k)] + [(9, 1.0, 1.0, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0, 1.0, 1.0)]
    cols = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    got = {(r.g, r.i, r.j): r.partial for r in sparse.edges(df, "g", cols, 0.2).collect()}
    for k in range(3):
        o = sparse.graphical_lasso(np.corrcoef(samples(k).T)[None], 0.2)[0]
        want = {(k, i, j): -o[i, j] / np.sqrt(o[i, i] * o[j, j]) for i in range(5) for j in range(i + 1, 5) if o[i, j]}
        assert {e for e in got if e[0] == k} == set(want) and all(abs(got[e] - v) < 1e-8 for e, v in want.items())
        assert got[k, 0, 1] > 0.2 and got[k, 2, 3] < -0.1
    assert not [e for e in got if e[0] == 9]
