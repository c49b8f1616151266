"""The conformal ensemble against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import ensemble


def plain(ref, cal, rows):
    mean, sd = ref.mean(axis=0), ref.std(axis=0)
    z = lambda x: (np.asarray(x) - mean) / sd
    zr = np.array([z(x) for x in ref])
    cov = zr.T @ zr / len(zr)
    w, q = np.linalg.eigh(cov)
    lead = q[:, np.argsort(-w)[:2]]

    def scores(x):
        v = z(x)
        rest = v - lead @ (lead.T @ v)
        two = max(v[[i, j]] @ np.linalg.inv(cov[np.ix_([i, j], [i, j])]) @ v[[i, j]] for i in range(3) for j in range(i + 1, 3))
        return [v @ np.linalg.inv(cov) @ v, sorted(math.dist(v, r) for r in zr)[4], rest @ rest, two]

    held = [scores(x) for x in cal]
    out = []
    for x in rows:
        s = scores(x)
        out.append([(1 + sum(c[k] >= s[k] for c in held)) / (len(cal) + 1) for k in range(4)])
    return out


def test_against_loops(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    x[:, 1] += x[:, 0]
    x[100:110] += 6  # far off
    kind = ["ref"] * 60 + ["cal"] * 40 + ["new"] * 50
    rows = [(i, i % 2, k, *map(float, v)) for i, (k, v) in enumerate(zip(kind, x, strict=True))] + [(900, 0, "new", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t int, u int, kind string, a double, b double, c double").repartition(4)
    found = ensemble.conformal(df, ["u", "t"], ["a", "b", "c"], F.col("kind") == "ref", F.col("kind") == "cal")
    got = {r.t: r for r in ensemble.monitored(found, "u", ["t"]).collect()}
    want = plain(x[:60], x[60:100], x[100:])
    assert set(got) == set(range(100, 150))
    z = {0: 8.0, 1: 8.0}
    for t, p in zip(range(100, 150), want, strict=True):
        r = got[t]
        assert all(abs(r[f"p_{s}"] - v) < 1e-9 for s, v in zip(ensemble.SCORES, p, strict=True))
        fisher = -2 * sum(math.log(v) for v in p)
        z[t % 2] = 0.2 * fisher + 0.8 * z[t % 2]
        assert abs(r.fisher - fisher) < 1e-9 and abs(r.ewma - z[t % 2]) < 1e-9
    assert min(got[t].fisher for t in range(100, 110)) > max(np.quantile([got[t].fisher for t in range(110, 150)], 0.9), 15)
    with pytest.raises(ValueError, match="reference"):
        ensemble.conformal(df.limit(0), ["u", "t"], ["a", "b", "c"], F.col("kind") == "ref", F.col("kind") == "cal")
