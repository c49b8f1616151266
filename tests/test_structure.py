"""Row numbers, running sums and block structures against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomwork.operators import scan, structure


def test_numbers_and_rising_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1) if i % 17 else None) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "t int, x double").repartition(5)
    assert all(r.n == r.t + 1 for r in scan.numbered(df, ["t"], "n").collect())
    got = {r.t: r.c for r in scan.rising_sum(df, ["t"], "x", "c").collect()}
    c = 0.0
    for t, x in sorted(rows):
        c = max(0.0, c + (x or 0.0))
        assert abs(got[t] - c) < 1e-9
    assert scan.numbered(df.limit(0), ["t"], "n").count() == 0 and scan.rising_sum(df.limit(0), ["t"], "x", "c").count() == 0


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (230, 3)).astype(float)
    x[100:200, 1] = x[100:200, 0] + rng.normal(size=100)
    x[:50, 2] = 1.0  # a column that doesn't vary
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "t int, a double, b double, c double").repartition(4)
    blocks = structure.block_structure(df, ["t"], ["a", "b", "c"], 50)
    got = {r.block: r for r in blocks.collect()}
    assert sorted(got) == [0, 1, 2, 3]
    held = []
    for k in range(4):
        part = np.stack([ranks(v) for v in x[50 * k : 50 * k + 50].T])
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.nan_to_num(np.corrcoef(part))
        m = c.copy()
        np.fill_diagonal(m, 1 + structure.RIDGE)
        o = np.linalg.inv(m)
        want = [c[0, 1], c[0, 2], c[1, 2]]
        assert np.allclose(got[k]["rank"], want)
        assert np.allclose(got[k]["partial"], [-o[i, j] / np.sqrt(o[i, i] * o[j, j]) for i, j in ((0, 1), (0, 2), (1, 2))])
        held.append(want)
    far = np.sqrt(2 * ((np.array(held) - np.mean(held, axis=0)) ** 2).sum(axis=1))
    seen = structure.drift(blocks, 3, 0.3).orderBy("block").collect()
    c = 0.0
    for r, d in zip(seen, far, strict=True):
        c = max(0.0, c + d - 0.3)
        assert abs(r.rank_dist - d) < 1e-9 and abs(r.c_up - c) < 1e-9 and r.partial_dist >= 0
    assert structure.block_structure(df.where(F.col("t") < 20), ["t"], ["a", "b", "c"], 50).count() == 0
