"""Label propagation keeps little on disk: links are shuffled once, and what is done with goes."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loomwork.operators import community
from tests.test_community import plain


def shuffled(spark):
    """Bytes written to shuffles so far, and the shuffle files that lie on disk."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(True)
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size())), {x for x in names if x.startswith("shuffle_")}


def test_moves_shuffle_no_links_and_leave_no_files(spark):
    rng = random.Random(7)
    edges = [(2 * rng.randrange(40), 2 * rng.randrange(400) + 1, 1.0) for _ in range(6000)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    top = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}"
    wrote, got = [], None
    for rounds in (1, 3):
        (before, had), tables = shuffled(spark), len(spark.catalog.listTables("spark_catalog.default"))
        got = community.label_propagation(df, rounds, F.col("node") % 2)
        for _ in range(50):
            after, have = shuffled(spark)
            if not have - had:
                break
            time.sleep(0.2)
        wrote.append(after - before)
        assert not have - had and len(spark.catalog.listTables("spark_catalog.default")) == tables
    assert 0 < wrote[1] < 1.5 * wrote[0]
    assert not [d for d in os.listdir(f"{top}/sinks") if d.startswith("links-")]
    assert {r.node: r.label for r in got.collect()} == plain(edges, 3, lambda n: n % 2)


@pytest.mark.parametrize("sent", [0, 10_000])
@pytest.mark.parametrize("bipartite", [False, True])
def test_ways_of_moving_agree(spark, monkeypatch, sent, bipartite):
    rng = random.Random(11)
    k = (lambda: 2 * rng.randrange(30), lambda: 2 * rng.randrange(30) + 1) if bipartite else (lambda: rng.randrange(60),) * 2
    edges = [(k[0](), k[1](), float(rng.randint(1, 3))) for _ in range(120)] + [(2, 2 * i + 1, 1.0) for i in range(30)]  # 2 is a hub
    monkeypatch.setattr(community, "ROWS", 25)
    monkeypatch.setattr(community, "MOST_SENT", sent)
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    for rounds in (1, 3):
        got = community.label_propagation(df, rounds, F.col("node") % 2).collect()
        assert len(got) == len({r.node for r in got}) and {r.node: r.label for r in got} == plain(edges, rounds, lambda n: n % 2)


def test_nodes_of_no_side_stay(spark):
    edges = [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0), (4, 1, 3.0), (5, 5, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    got = {r.node: r.label for r in community.label_propagation(df, 4, F.when(F.col("node") > 1, F.col("node") % 2)).collect()}
    assert got == plain(edges, 4, lambda n: n % 2 if n > 1 else None)
