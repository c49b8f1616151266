"""Graph scores on worked examples."""

from loomwork.operators import graph as G


def test_weighted_cohesion_folds_directions(spark):
    edges = spark.createDataFrame([(1, 2, 3.0), (2, 1, 1.0), (2, 3, 2.0), (3, 3, 9.0), (1, 4, 5.0)], "src int, dst int, w double")
    placed = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "c"), (6, "c")], "node int, bucket string")
    got = {row.bucket: (row.n, row.coh) for row in G.weighted_cohesion(edges, placed).collect()}
    assert got == {"a": (3, 2.0), "b": (1, 0.0), "c": (2, 0.0)}  # (3 + 1 + 2) over three pairs


def test_cycles_of_any_length(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src int, dst int")
    assert {row.node: row.lead for row in G.cycles(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert G.cycles(edges.where("src = 7")).count() == 0
