"""Dependency graphs: closure, decomposition scores, Pareto fronts and clustering measures."""

from __future__ import annotations

import random
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.sinks import shared_dir

#: Weight of a level is BASE ** (depth - level); the tree has three levels.
BASE, DEPTH = 3, 3


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node of every seed's downstream closure: (seed, node, steps), by joins until nothing new is reached.

    Each round extends only the frontier, keeps distinct pairs and cuts its lineage with a checkpoint, so the plan doesn't grow.
    """
    shared_dir(edges.sparkSession)
    hop = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("steps"))
    front = seen
    for step in count(1):  # ends, as each round adds distinct pairs
        reached = front.join(hop, "node").select("seed", F.col("next").alias("node")).distinct()
        front = reached.join(seen, ["seed", "node"], "left_anti").withColumn("steps", F.lit(step)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if step % 16 == 0:
            seen = seen.coalesce(edges.sparkSession.sparkContext.defaultParallelism).checkpoint()  # a deep graph has many rounds
    return seen


def assigned(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges with the buckets of both ends (bs, bd)."""
    a = assignment.select(F.col("node").alias("src"), F.col("bucket").alias("bs"))
    b = assignment.select(F.col("node").alias("dst"), F.col("bucket").alias("bd"))
    return edges.join(a, "src").join(b, "dst")


def cohesion(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """bucket, n and internal directed calls over n (n - 1); a single node has 0."""
    inside = assigned(edges.select("src", "dst").where("src <> dst").distinct(), assignment).where("bs = bd").groupBy(F.col("bs").alias("bucket")).agg(F.count("*").alias("calls"))
    size = assignment.groupBy("bucket").agg(F.count("*").alias("n"))
    ratio = F.when(F.col("n") > 1, F.coalesce("calls", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return size.join(inside, "bucket", "left").select("bucket", "n", ratio.alias("cohesion"))


def weighted_cohesion(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """bucket, n and coh: the weight w of all edges inside over the C(n, 2) pairs of its nodes, either direction counting for the pair; a single node has 0."""
    inside = assigned(edges.select("src", "dst", "w").where("src <> dst"), assignment).where("bs = bd").groupBy(F.col("bs").alias("bucket")).agg(F.sum("w").alias("w"))
    size = assignment.groupBy("bucket").agg(F.count("*").alias("n"))
    ratio = F.when(F.col("n") > 1, F.coalesce("w", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0)
    return size.join(inside, "bucket", "left").select("bucket", "n", ratio.alias("coh"))


def cycles(edges: DataFrame) -> DataFrame:
    """node and lead (the lowest node of its cycle) of every node that lies on a cycle of two nodes or more: nodes that reach each other."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    reach = closure(edges, ends).where("seed <> node").select("seed", "node")
    both = reach.join(reach.select(F.col("node").alias("seed"), F.col("seed").alias("node")), ["seed", "node"])
    return both.groupBy(F.col("seed").alias("node")).agg(F.min("node").alias("least")).select("node", F.least("node", "least").alias("lead"))


def contamination(tag: Column, path: Column) -> Column:
    """Sum of the weights of the levels at which a tag and a path differ."""
    return sum((F.when(tag[i] != path[i], BASE ** (DEPTH - 1 - i)).otherwise(0) for i in range(DEPTH)), F.lit(0))


def dominates(pairs: DataFrame, better: dict[str, str]) -> Column:
    """Whether x_<c> dominates y_<c>: nowhere worse, somewhere better; better maps an objective to min or max."""
    ok, strict = F.lit(True), F.lit(False)
    for c, way in better.items():
        x, y = (F.col(f"x_{c}"), F.col(f"y_{c}")) if way == "max" else (F.col(f"y_{c}"), F.col(f"x_{c}"))
        ok, strict = ok & (x >= y), strict | (x > y)
    return ok & strict


def domination(points: DataFrame, better: dict[str, str]) -> DataFrame:
    """winner and loser of every dominated pair of a small set of solutions (one row each)."""
    x = points.select(F.col("id").alias("winner"), *[F.col(c).alias(f"x_{c}") for c in better])
    y = points.select(F.col("id").alias("loser"), *[F.col(c).alias(f"y_{c}") for c in better])
    return x.join(y, dominates(points, better)).select("winner", "loser")


def agreement(df: DataFrame, group: str, tag: str) -> DataFrame:
    """Share of a group's most common tag."""
    n = df.groupBy(group, tag).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg((F.max("n") / F.sum("n")).alias("share"))


def pair_scores(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairwise precision and recall, adjusted Rand index and normalised mutual information of two clusterings."""
    n = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    two = lambda c: c * (c - 1) / 2
    ra, rb = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    total = n.agg(F.sum("n").alias("t"), F.sum(two(F.col("n"))).alias("both"))
    sa, sb = ra.agg(F.sum(two(F.col("na"))).alias("pa")), rb.agg(F.sum(two(F.col("nb"))).alias("pb"))
    ent = lambda d, c: d.join(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))).alias(f"h_{c}"))
    mi = n.join(ra, "a").join(rb, "b").join(F.broadcast(total)).agg(F.sum(F.expr("n / t * ln(n * t / (na * nb))")).alias("mi"))  # all of these are one row
    one = total.join(F.broadcast(sa)).join(F.broadcast(sb)).join(F.broadcast(mi)).join(F.broadcast(ent(ra, "na"))).join(F.broadcast(ent(rb, "nb")))
    expected = F.expr("pa * pb / (t * (t - 1) / 2)")
    return one.select((F.col("both") / F.col("pa")).alias("precision"), (F.col("both") / F.col("pb")).alias("recall"), ((F.col("both") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected)).alias("ari"), (2 * F.col("mi") / (F.col("h_na") + F.col("h_nb"))).alias("nmi"))


def crossover(a: list[int], b: list[int], seed: int) -> list[int]:
    at = random.Random(seed).randrange(1, len(a))
    return a[:at] + b[at:]


def mutate(genes: list[int], buckets: int, rate: float, seed: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(buckets) if rng.random() < rate else g for g in genes]


def agglomerate(weights: dict[tuple[int, int], float], k: int) -> dict[int, int]:
    """Merge the two clusters of highest affinity until k are left; a cluster is named by its lowest member."""
    label = {n: n for pair in weights for n in pair}
    w = {tuple(sorted(p)): v for p, v in weights.items()}
    while len(set(label.values())) > k and w:
        (a, b), _ = max(w.items(), key=lambda x: (x[1], -x[0][0], -x[0][1]))
        label = {n: a if c == b else c for n, c in label.items()}
        merged: dict = {}
        for (x, y), v in w.items():
            p = tuple(sorted((a if x == b else x, a if y == b else y)))
            if p[0] != p[1]:
                merged[p] = merged.get(p, 0.0) + v
        w = merged
    return label


def rank_within(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
