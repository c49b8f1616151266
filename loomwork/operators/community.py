"""Communities of a weighted graph by label propagation, as joins and aggregates over the whole graph."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.sinks import scratch_path

#: Rows of a shuffle's partition, so that the memory of a task doesn't grow with the graph.
ROWS = 250_000
#: Labels that are sent to all workers at most (some 30 MB); they are counted first.
MOST_SENT = 500_000


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[int]:
    """Shuffles of as many partitions as so many rows ask, at least one a core; they aren't put together again by their compressed bytes, and their files go when an action ends."""
    n = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), -(-rows // ROWS))
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other and w of undirected edges from either end; directions are folded, loops go."""
    one = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))
    return one.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(one.select(F.col("b").alias("node"), F.col("a").alias("other"), "w"))


@contextmanager
def by_node(links: DataFrame, n: int) -> Iterator[DataFrame]:
    """links in n buckets of their node, so that joins and groups by node read them without a shuffle. Their files go at the end."""
    spark, path, name = links.sparkSession, scratch_path(links.sparkSession, "links"), f"spark_catalog.default.links_{uuid.uuid4().hex}"
    links.write.partitionBy("own", "far").bucketBy(n, "node").sortBy("node", "other").option("path", path).option("compression", "zstd").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        _delete(spark, path)


def _held(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder, and where."""
    path = scratch_path(df.sparkSession, "labels")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _best(votes: DataFrame) -> DataFrame:
    """The label with most weight of each node; ties go to the lowest."""
    added = votes.groupBy("node", "label").agg(F.sum("w").alias("w"))
    return added.groupBy("node").agg(F.max(F.struct(F.col("w"), (-F.col("label")).alias("least"))).alias("m")).select("node", (-F.col("m.least")).alias("label"))


def _turn(links: DataFrame, half: int, known: DataFrame, small: bool, hubs: list, n: int) -> DataFrame:
    """node and label of one half after its move. A small table of the neighbours' labels is sent to the links of the nodes that move; otherwise labels go along the links, which lie by their senders."""
    told = links.where(F.col("far") == half).join(known, "node").select(F.col("other").alias("node"), "label", "w")
    hub = F.col("node").isin(hubs)
    if small:
        heard = links.where(F.col("own") == half).join(F.broadcast(known.withColumnRenamed("node", "other")), "other").select("node", "label", "w")
        votes = heard.where(~hub) if hubs else heard
    else:
        votes = (told.where(~hub) if hubs else told).repartition(n, "node")
    return _best(votes).unionByName(_best(told.where(hub))) if hubs else _best(votes)


def label_propagation(edges: DataFrame, rounds: int = 20, side: F.Column | None = None, most: int | None = None) -> DataFrame:
    """node and label: nodes take the label that has most weight among their neighbours (ties: the lowest), until none changes.

    In each round one half of the nodes moves, then the other, so that pairs don't swap labels for ever; ``side`` (0 or 1, over
    node) says which half, by default a hash of the node. A node starts with its own id as label. There are as many partitions
    as the edges ask; ``most`` is a bound of their number, if it is known without counting them.

    Links are shuffled once and kept in buckets by node. A move reads the links of its half only; the first one, and those
    whose neighbours have at most MOST_SENT labels, shuffle nothing, the others one row for each link. Votes for a node with
    more than ROWS links are added up before they move. Each move is written; shuffle files and what no move reads any more go at once.
    """
    spark = edges.sparkSession
    side = F.coalesce((F.pmod(F.xxhash64("node"), F.lit(2)) if side is None else side).cast("int"), F.lit(-1))
    with spread(spark, 2 * (edges.count() if most is None else most)) as n:
        there = edges.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("other"), "w")
        both = there.unionByName(there.select(F.col("other").alias("node"), F.col("node").alias("other"), "w"))
        once = both.repartition(n, "node").groupBy("node", "other").agg(F.sum("w").alias("w")).withColumn("own", side)
        far = once.select(F.col("node").alias("from"), F.col("other").alias("node"), "w", "own").withColumn("far", side)
        with by_node(far.select(F.col("from").alias("node"), F.col("node").alias("other"), "w", "own", "far"), n) as links:
            kinds = {(x.own, x.far) for x in links.select("own", "far").distinct().collect()}
            hubs = [x.node for x in links.groupBy("node").count().where(F.col("count") > ROWS).collect()]  # one a partition on average at most
            labels = {s: _held(links.where(F.col("own") == s).select("node").distinct().select("node", F.col("node").alias("label"))) for s in sorted({0, 1} | {own for own, _ in kinds})}
            for i in range(rounds):
                moved = not i  # all nodes that move first do change
                for half in (0, 1):
                    senders = [s for s in labels if (s, half) in kinds]
                    if not senders:
                        continue
                    if not i and not half:
                        now = _best(links.where(F.col("own") == half).select("node", F.col("other").alias("label"), "w"))
                    else:
                        known = reduce(DataFrame.unionByName, [labels[s][0] for s in senders])
                        now = _turn(links, half, known, known.count() <= MOST_SENT, hubs, n)
                    old, path = labels[half]
                    labels[half] = _held(now)
                    if not moved and i + 1 < rounds:
                        moved = not old.join(labels[half][0].withColumnRenamed("label", "new"), "node").where("label <> new").isEmpty()
                    _delete(spark, path)
                if not moved:
                    break
    return reduce(DataFrame.unionByName, [df for df, _ in labels.values()])


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the modularity of labelled nodes: the share of weight inside communities less what degrees alone would give."""
    links = both_ways(edges)
    a, b = labels.select("node", F.col("label").alias("la")), labels.select(F.col("node").alias("other"), F.col("label").alias("lb"))
    each = links.join(a, "node").join(b, "other")
    per = each.groupBy("la").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = per.agg(F.sum("degree").alias("all"))
    return per.join(F.broadcast(total)).agg(F.sum(F.expr("inside / all - pow(degree / all, 2)")).alias("modularity"))  # total is one row
