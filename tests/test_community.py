"""Label propagation against a plain version."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork.operators import community


def plain(edges, rounds, side):
    near = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        if a != b:
            near[a][b] += w
            near[b][a] += w
    label = {n: n for n in near}
    for _ in range(rounds):
        before = dict(label)
        for half in (0, 1):
            held = dict(label)
            for n in near:
                if side(n) == half:
                    votes = defaultdict(float)
                    for m, w in near[n].items():
                        votes[held[m]] += w
                    label[n] = min(votes, key=lambda x: (-votes[x], x))
        if label == before:
            break
    return label


@pytest.mark.parametrize("rounds", [2, 20])
def test_label_propagation(spark, rounds):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randint(1, 3))) for _ in range(90)]
    df = spark.createDataFrame(edges, "src long, dst long, w double").repartition(3)
    got = {r.node: r.label for r in community.label_propagation(df, rounds, F.col("node") % 2).collect()}
    assert got == plain(edges, rounds, lambda n: n % 2)


def test_two_cliques_and_a_bridge(spark):
    clique = lambda ns: [(a, b, 1.0) for a in ns for b in ns if a < b]
    edges = [*clique(range(1, 7)), *clique(range(11, 17)), (6, 11, 0.5)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    got = community.label_propagation(df)
    seen = {r.node: r.label for r in got.collect()}
    assert len({seen[n] for n in range(1, 7)}) == 1 and len({seen[n] for n in range(11, 17)}) == 1 and seen[1] != seen[11]
    m = 30.5
    want = sum(2 * 15 / (2 * m) - ((2 * 15 + 0.5) / (2 * m)) ** 2 for _ in range(2))
    assert abs(community.modularity(df, got).first().modularity - want) < 1e-12
    assert community.label_propagation(df.limit(0)).count() == 0
