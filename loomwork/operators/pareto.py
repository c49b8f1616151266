"""Pareto fronts of many points: local fronts first, then merges of bounded size; crowding and trimming.

A point's front is one more than the length of the longest chain of points that dominate one another up to it. Its front among
the points of one task is never higher than among all. So the points whose local front is K at most settle all global fronts
up to K between them, and each round merges as many local fronts as a task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.sinks import shared_dir

#: Points that one task ranks among themselves, and that one merge takes.
LOCAL, MERGE = 25_000, 50_000


def ranks(x: np.ndarray) -> np.ndarray:
    """The front (from 1) of each row of x, smaller being better in every column; equal rows share a front.

    In lexicographic order dominators come first. A point that a front's member dominates has dominators in all earlier fronts
    too, so its own front is found by halving.
    """
    order = np.lexsort(x.T[::-1])
    held: list[np.ndarray] = []
    size: list[int] = []
    out = np.zeros(len(x), np.int64)
    for i in order:
        p, lo, hi = x[i], 0, len(held)
        while lo < hi:
            mid = (lo + hi) // 2
            f = held[mid][: size[mid]]
            worse = (f <= p).all(axis=1)
            if worse.any() and (f[worse] < p).any():
                lo = mid + 1
            else:
                hi = mid
        if lo == len(held):
            held.append(np.empty((16, x.shape[1])))
            size.append(0)
        if size[lo] == len(held[lo]):
            held[lo] = np.concatenate([held[lo], np.empty_like(held[lo])])
        held[lo][size[lo]] = p
        size[lo] += 1
        out[i] = lo + 1
    return out


def _goals(points: DataFrame, better: dict[str, str]) -> DataFrame:
    """id and x: the objectives, turned so that smaller is better; a null or NaN is the worst."""
    worst = F.lit(float("inf"))
    x = [F.coalesce(F.nanvl(F.col(c).cast("double") * (1 if way == "min" else -1), worst), worst) for c, way in better.items()]
    return points.select("id", F.array(*x).alias("x"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, width)


def _ranked(points: DataFrame, width: int) -> DataFrame:
    """Points with their front among those of their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is not None and held.num_rows:
            held = held.combine_chunks()
            x = held.column("x").chunk(0)
            yield pa.RecordBatch.from_arrays([held.column("id").chunk(0), x, pa.array(ranks(_matrix(x, width)))], ["id", "x", "k"])

    kind = points.schema["id"].dataType.simpleString()
    return points.mapInArrow(run, f"id {kind}, x array<double>, k long")


def _skyline(points: DataFrame, width: int, n: int) -> DataFrame:
    """The points that no other one dominates, where they are too many for one task: every block meets every block."""
    blocks = -(-n // LOCAL)
    mine = points.withColumn("b", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int"))
    each = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tests = each.select("id", "x", F.col("b").alias("i"), F.col("o").alias("j"), F.lit(True).alias("asked")).unionByName(each.select("id", "x", F.col("o").alias("i"), F.col("b").alias("j"), F.lit(False).alias("asked")))

    def run(t: pa.Table) -> pa.Table:
        asked = np.asarray(t.column("asked").combine_chunks().cast(pa.int8())).astype(bool)
        x = _matrix(t.column("x").combine_chunks(), width)
        a, b = x[asked], x[~asked]
        beaten = np.zeros(len(a), bool)
        for at in range(0, len(a), 256):
            p = a[at : at + 256, None]
            beaten[at : at + 256] = ((b <= p).all(axis=2) & (b < p).any(axis=2)).any(axis=1)
        return pa.table({"id": t.column("id").filter(pa.array(asked)), "beaten": beaten})

    kind = points.schema["id"].dataType.simpleString()
    seen = tests.groupBy("i", "j").applyInArrow(run, f"id {kind}, beaten boolean")
    return seen.groupBy("id").agg(F.max("beaten").alias("beaten")).where("not beaten").select("id")


def fronts(points: DataFrame, better: dict[str, str], most: int | None = None) -> DataFrame:
    """id and front (from 1) of points with distinct ids; better maps each objective to min or max.

    With ``most``, whole fronts until so many points are in. Every round ranks within tasks, merges the best local
    fronts up to MERGE points in one task (or finds one front block by block, if that alone has more), and cuts its lineage.
    """
    shared_dir(points.sparkSession)
    width, done, base, taken = len(better), None, 0, 0
    left = _goals(points, better).checkpoint()
    while n := left.count():
        ranked = _ranked(left.repartition(max(1, -(-n // LOCAL)), F.xxhash64("id")), width).checkpoint()
        sizes = ranked.groupBy("k").agg(F.count("*").alias("n")).orderBy("k")
        upto = sizes.withColumn("t", F.sum("n").over(Window.orderBy("k"))).where(F.col("t") <= MERGE).agg(F.max("k")).first()[0]
        if upto is None:
            first = ranked.where("k = 1").select("id", "x")
            found = _skyline(first, width, first.count()).withColumn("front", F.lit(base + 1).cast("long")).checkpoint()
            upto = 1
        else:
            best = ranked.where(F.col("k") <= upto).select("id", "x").coalesce(1)  # MERGE points at most
            found = _ranked(best, width).where(F.col("k") <= upto).select("id", (F.col("k") + base).alias("front")).checkpoint()
        done = found if done is None else done.unionByName(found)
        base, taken = base + upto, taken + found.count()
        left = ranked.join(found, "id", "left_anti").select("id", "x").checkpoint()
        if most is not None and taken >= most:
            break
    return points.select("id", F.lit(0).cast("long").alias("front")).limit(0) if done is None else done


def crowding(df: DataFrame, objectives: list[str], front: str | None = None) -> DataFrame:
    """df with crowding: the gap between a point's neighbours in each objective (of its front), summed; infinite at the ends."""
    total = F.lit(0.0)
    for c in objectives:
        w = (Window.partitionBy(front) if front else Window.partitionBy()).orderBy(c, "id")
        total = total + F.coalesce(F.lead(c).over(w) - F.lag(c).over(w), F.lit(float("inf")))
    return df.withColumn("crowding", total)


def trim(points: DataFrame, better: dict[str, str], n: int) -> DataFrame:
    """id, front and crowding of the best n points: whole fronts first, and of the last one those with the most room around them."""
    ranked = points.join(fronts(points, better, n), "id")
    return crowding(ranked, list(better), "front").orderBy("front", F.desc("crowding"), "id").limit(n).select("id", "front", "crowding")
