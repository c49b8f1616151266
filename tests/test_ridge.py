"""Ridge residuals and their CUSUMs against plain loops."""

import numpy as np

from loomwork.operators import monitor


def test_ridge_cusum(spark):
    rng = np.random.default_rng(8)
    n, cols = 90, ["a", "b", "c"]
    x = {u: rng.normal(size=(n, 3)).cumsum(axis=0) * 0.1 + rng.normal(size=(n, 3)) for u in (1, 2)}
    x[2][60:, 1] += 3  # a shift
    rows = [(u, t, *map(float, v)) for u in x for t, v in enumerate(x[u])] + [(1, 500, None, 1.0, 1.0)]
    got = {(r.u, r.t): r for r in monitor.ridge_cusum(spark.createDataFrame(rows, "u int, t int, a double, b double, c double").repartition(3), "u", "t", cols).collect()}
    wide = np.concatenate([np.c_[x[u][1:], x[u][:-1]] for u in x])
    z = np.zeros((len(wide), 3))
    for y in range(3):
        rest = [i for i in range(6) if i != y]
        d = wide - wide.mean(axis=0)
        beta = np.linalg.solve(d[:, rest].T @ d[:, rest] + np.eye(5), d[:, rest].T @ d[:, y])
        e = d[:, y] - d[:, rest] @ beta
        z[:, y] = e / e.std(ddof=1)
    assert len(got) == len(wide)
    for k, u in enumerate(x):
        up, dn = np.zeros(3), np.zeros(3)
        for t in range(1, n):
            v = z[k * (n - 1) + t - 1]
            up, dn = np.maximum(0, up + v - 0.25), np.minimum(0, dn + v + 0.25)
            worst = max(up.max(), -dn.min())
            assert abs(got[u, t].worst - worst) < 1e-7 and got[u, t].alarm == (got[u, t].worst > 5)
    assert any(got[2, t].alarm for t in range(62, 90))
