"""MoJo distance and MoJoFM of two clusterings, with a maximum matching over their contingency table."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.sources.sinks import shared_dir


def augment(edges: list[tuple[int, int]]) -> int:
    """The size of a maximum matching of a bipartite graph, by augmenting paths in breadth-first order."""
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
    taken: dict[int, int] = {}  # b: a
    mine: dict[int, int] = {}
    for root in near:
        came, queue, end = {}, [root], None
        while queue and end is None:
            following = []
            for a in queue:
                for b in near[a]:
                    if b in came:
                        continue
                    came[b] = a
                    if b not in taken:
                        end = b
                        break
                    following.append(taken[b])
                if end is not None:
                    break
            queue = following
        while end is not None:  # every node on the path changes its partner
            a = came[end]
            taken[end], mine[a], end = a, end, mine.get(a)
    return len(taken)


def _components(edges: DataFrame) -> DataFrame:
    """Edges with comp, the lowest a of their component: lowest labels go over both sides until none changes."""
    label = edges.groupBy("b").agg(F.min("a").alias("comp")).checkpoint()
    while True:
        up = edges.join(label, "b").groupBy("a").agg(F.min("comp").alias("comp"))
        now = edges.join(up, "a").groupBy("b").agg(F.min("comp").alias("comp")).checkpoint()
        if not now.join(label.select("b", F.col("comp").alias("was")), "b").where("comp <> was").limit(1).count():
            return edges.join(now, "b")
        label = now


def matching_size(edges: DataFrame) -> int:
    """How many pairs a maximum matching of the edges (a, b: longs) has.

    Ends of degree one can be matched at once without loss, which is done in rounds over the whole table; what is left, where
    every end has a choice, is solved component by component.
    """
    shared_dir(edges.sparkSession)
    left, size = edges.select("a", "b").distinct().checkpoint(), 0
    while True:
        for one, other in (("a", "b"), ("b", "a")):
            single = left.groupBy(one).agg(F.count("*").alias("n"), F.min(other).alias("only")).where("n = 1")
            done = single.select(F.col("only").alias(other)).distinct().checkpoint()  # each of them takes one of those that want it alone
            n = done.count()
            if n:
                size, left = size + n, left.join(done, other, "left_anti").checkpoint()
                break
        else:
            break

    def solve(t: pa.Table) -> pa.Table:
        return pa.table({"n": [augment(sorted(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True)))]})

    rest = _components(left).groupBy("comp").applyInArrow(solve, "n long")
    return size + (rest.agg(F.sum("n")).first()[0] or 0)


def mojofm(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, moves, joins, mojo (the fewest moves of an element and joins of two clusters that turn a into b) and mojofm in percent.

    Every cluster of a is tagged with a cluster of b that it shares most elements with, so that as many different tags as
    possible are used; elements outside the tag move, clusters with one tag join. The most distant clustering needs n
    less the most clusters of b that can be told apart by rising sizes. Rows with a null in either play no part.
    """
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.xxhash64(F.col(a)).alias("a"), F.xxhash64(F.col(b)).alias("b")).agg(F.count("*").alias("n"))
    shared_dir(df.sparkSession)
    n = n.checkpoint()
    top = n.groupBy("a").agg(F.max("n").alias("top"))
    tags = matching_size(n.join(top, "a").where("n = top").select("a", "b"))
    sizes = n.groupBy("b").agg(F.sum("n").alias("s")).groupBy("s").agg(F.count("*").alias("c"))  # no more rows than there are different sizes
    rising = F.aggregate(F.sort_array(F.collect_list(F.struct("s", "c"))), F.lit(0).cast("long"), lambda g, x: F.when(g < x["s"], F.least(g + x["c"], x["s"])).otherwise(g))
    one = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).join(F.broadcast(top.agg(F.coalesce(F.sum("top"), F.lit(0)).alias("same"), F.count("*").alias("clusters")))).join(F.broadcast(sizes.agg(rising.alias("g"))))  # one row each
    moves, joins = F.col("n") - F.col("same"), F.col("clusters") - F.lit(tags)
    most = F.col("n") - F.col("g")
    return one.select("n", moves.alias("moves"), joins.alias("joins"), (moves + joins).alias("mojo"), F.when(most > 0, (1 - (moves + joins) / most) * 100).otherwise(100.0).alias("mojofm"))
