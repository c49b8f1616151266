"""Scans against plain recursions; one key over several tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import monitor, scan


def test_one_key_of_a_million_rows(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(7).alias("k"), F.col("id").alias("t"), (F.xxhash64("id") % 1000 / 100.0).alias("x"))
    got = monitor.ewma(df, "k", ["t"], "x", 0.2, 5.0)
    rows = got.orderBy("t").toPandas()
    xs = df.orderBy("t").toPandas()["x"].tolist()
    z, worst = 5.0, 0.0
    for x, seen in zip(xs, rows["z"].tolist(), strict=True):
        z = 0.2 * x + 0.8 * z
        worst = max(worst, abs(z - seen))
    assert worst < 1e-9
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1  # several tasks hold the key


def plain_kalman(ys, q, r, x, p):
    out = []
    for y in ys:
        p = p + q
        if y is not None:
            k = p / (p + r)
            x, p = x + k * (y - x), (1 - k) * p
        out.append((x, p))
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_kalman(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    rng = random.Random(4)
    data = [(k, t, None if rng.random() < 0.1 else rng.gauss(10, 3)) for k, n in (("a", 700), ("b", 1), ("c", 40), (None, 5)) for t in range(n)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, t int, y double").repartition(5)
    got = {}
    for row in scan.kalman(df, ["k"], ["t"], "y", q=0.3, r=2.0, start=8.0, start_var=4.0).orderBy("t").collect():
        got.setdefault(row.k, []).append((row.level, row["var"]))
    for k in ("a", "b", "c", None):
        want = plain_kalman([y for kk, _, y in sorted(data, key=lambda d: d[1]) if kk == k], 0.3, 2.0, 8.0, 4.0)
        assert len(want) == len(got[k]) and all(abs(a - c) < 1e-9 and abs(b - d) < 1e-9 for (a, b), (c, d) in zip(want, got[k], strict=True))


def test_nulls_and_several_keys(spark):
    df = spark.createDataFrame([(1, 1, 0, 2.0), (1, 1, 1, None), (1, 1, 2, 4.0), (1, 2, 0, 6.0)], "a int, b int, t int, x double")
    assert [row.z for row in monitor.ewma(df.where("b = 1"), "b", ["t"], "x", 0.5, 0.0).orderBy("t").collect()] == [1.0, None, None]
    got = scan.linear(df, ["a", "b"], ["t"], 0.5, F.coalesce("x", F.lit(0.0)), 1.0, "z").orderBy("b", "t").collect()
    assert [row.z for row in got] == [2.5, 1.25, 4.625, 6.5] and df.columns == [c for c in got[0].asDict() if c != "z"]
    assert monitor.ewma(df.limit(0), "a", ["t"], "x", 0.5).count() == 0
    assert not math.isnan(got[0].z)
