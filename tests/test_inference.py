"""Bootstrap replicates and chi-square against plain versions."""

import hashlib
import math
import random
from collections import Counter

from loomwork.operators import relational as R


def weight(row, b):
    u = int(hashlib.md5(f"{row}:{b // 8}".encode()).hexdigest()[4 * (b % 8) : 4 * (b % 8) + 4], 16)
    total, term, k = 0.0, math.exp(-1), 0
    for i in range(8):
        total += term
        k += u >= round(total * 65536)
        term /= i + 1
    return k


def test_bootstrap_means(spark):
    rng = random.Random(1)
    rows = [(i, "ab"[i % 3 == 0], rng.gauss(5, 2)) for i in range(3000)] + [(5000, "a", None), (7, "a", 1.0), (9000, "c", 2.0)]
    df = spark.createDataFrame(rows, "id long, k string, x double").repartition(3)
    got = {(r.k, r.replicate): r["mean"] for r in R.bootstrap_means(df, ["k"], "id", "x", 20).collect()}
    assert len(got) == 60
    for k in "abc":
        mine = [(i, x) for i, kk, x in rows if kk == k and x is not None]
        for b in range(20):
            n = sum(weight(i, b) for i, _ in mine)
            want = sum(weight(i, b) * x for i, x in mine) / n if n else None
            assert got[k, b] is None if want is None else abs(got[k, b] - want) < 1e-9
    seen = Counter(weight(i, 3) for i in range(20_000))
    assert abs(sum(k * n for k, n in seen.items()) / 20_000 - 1) < 0.03 and abs(seen[0] / 20_000 - math.exp(-1)) < 0.015
    assert R.bootstrap_means(df.limit(0), ["k"], "id", "x", 4).count() == 0


def test_chi_square(spark):
    table = {("m", "x"): 20, ("m", "y"): 30, ("f", "x"): 25, ("f", "z"): 5}
    rows = [k for k, n in table.items() for _ in range(n)] + [(None, "x"), ("m", None)]
    r = R.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    n, want = 80, 0.0
    for a in "mf":
        for b in "xyz":
            e = sum(v for (i, _), v in table.items() if i == a) * sum(v for (_, j), v in table.items() if j == b) / n
            want += (table.get((a, b), 0) - e) ** 2 / e
    assert abs(r.chi2 - want) < 1e-9 and (r.dof, r.n) == (2, 80)
