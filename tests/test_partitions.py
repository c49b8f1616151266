"""Partitions in proportion to the rows, so that no task's memory grows with the input."""

import random

from pyspark.sql import functions as F

from loomwork.operators import community
from tests.test_community import plain


def test_partitions_grow_with_the_graph(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with community.spread(spark, 100 * community.ROWS) as n:
        assert n == 100 and spark.conf.get("spark.sql.shuffle.partitions") == "100"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60), 1.0) for _ in range(200)]
    monkeypatch.setattr(community, "ROWS", 20)
    got = community.label_propagation(spark.createDataFrame(edges, "src long, dst long, w double"), 3, F.col("node") % 2)
    assert {r.node: r.label for r in got.collect()} == plain(edges, 3, lambda n: n % 2)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
