"""Drift of the dependence between columns, over blocks of rows in order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import scan

#: Added to the diagonal of a block's correlations before they are inverted, so that dependent columns do no harm.
RIDGE = 1e-3


def block_structure(df: DataFrame, order: list[str], cols: list[str], size: int) -> DataFrame:
    """block (from 0), rank (Spearman correlations) and partial (partial correlations of the ranks) of every full block of ``size`` rows in order.

    Both are arrays over the pairs of columns, in order. Rows get their numbers range by range, so no task sees all of them; a
    block is one group. Ties have their mean rank; a column that doesn't vary in a block correlates with nothing. Nulls
    rank first; an incomplete last block is left out.
    """
    rows = scan.numbered(df.select(*order, *cols), order, "__n")
    rows = rows.withColumn("block", F.floor((F.col("__n") - 1) / size))
    whole = Window.partitionBy("block")
    mean_rank = lambda c: F.rank().over(whole.orderBy(c)) + (F.count("*").over(Window.partitionBy("block", c)) - 1) / 2.0
    ranks = rows.select("block", *[mean_rank(c).alias(c) for c in cols])
    varying = ranks.select("block", *[F.when(F.min(c).over(whole) < F.max(c).over(whole), F.col(c)).alias(c) for c in cols])
    pairs = list(combinations(range(len(cols)), 2))
    each = [F.coalesce(F.corr(cols[i], cols[j]), F.lit(0.0)) for i, j in pairs]
    held = varying.groupBy("block").agg(F.count("*").alias("n"), F.array(*each).alias("rank")).where(F.col("n") == size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(cols)
        i, j = np.array(pairs).T
        for batch in batches:
            r = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, len(pairs))
            m = np.tile(np.eye(p) * (1 + RIDGE), (len(r), 1, 1))
            m[:, i, j] = m[:, j, i] = r
            o = np.linalg.inv(m)
            d = np.sqrt(np.einsum("nii->ni", o))
            part = (-o / (d[:, :, None] * d[:, None, :]))[:, i, j]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(part), pa.list_(pa.float64()))], ["block", "rank", "partial"])

    return held.select("block", "rank").mapInArrow(run, "block long, rank array<double>, partial array<double>")


def drift(blocks: DataFrame, pairs: int, k: float) -> DataFrame:
    """block, rank_dist and partial_dist (Frobenius distances from the mean of all blocks) and c_up, the CUSUM of rank_dist over blocks with allowance k."""
    means = blocks.agg(*[F.avg(F.get(c, i)).alias(f"{c}{i}") for c in ("rank", "partial") for i in range(pairs)])  # one row
    far = lambda c: F.sqrt(sum((2 * F.pow(F.get(c, i) - F.col(f"{c}{i}"), F.lit(2.0)) for i in range(pairs)), F.lit(0.0)))
    dist = blocks.join(F.broadcast(means)).select("block", far("rank").alias("rank_dist"), far("partial").alias("partial_dist"))
    return scan.rising_sum(dist.withColumn("__x", F.col("rank_dist") - k), ["block"], "__x", "c_up").drop("__x")
