"""Pairs of vectors above a cosine: all pairs of a group, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block; two blocks meet in one tile. Rows of a tile that are multiplied with its columns at a time.
BLOCK, STRIP = 8192, 256
#: Products of unit vectors that are so much too low may be rounding; what is near enough is added up again, component by component.
SLACK = 1e-9


def _matrix(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as columns of components, 0 where there is none, and where there is one."""
    lists = col.combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    x, there = np.zeros((int(size.max(initial=0)), len(size))), np.zeros((int(size.max(initial=0)), len(size)), bool)
    x[at, row] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    there[at, row] = flat.is_valid().to_numpy(zero_copy_only=False)
    square = np.zeros(len(size))
    for c in x:  # in the order of components
        square += c * c
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(there, x / np.sqrt(square), 0.0), there


def cosine_pairs(rows: DataFrame, group: str, id_col: str, vector_col: str, least: float) -> DataFrame:
    """a, b and s of all pairs a < b of a group whose cosine s is above ``least``; one that isn't a number (a vector of zeros) counts as above all.

    Components that are null or missing at the end count for nothing. A group's vectors lie in blocks by a hash of their ids, as many as
    their number asks, and each two blocks meet in one tile: memory of a task doesn't grow with a group, the work is the square of it.
    Vectors are shuffled once for each block of their group.
    """
    v = rows.where(F.col(group).isNotNull() & F.col(id_col).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    blocks = v.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("mine")
    dealt = v.join(blocks, "g").select("g", "id", "v", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("g", F.least("mine", "other").alias("ti"), F.greatest("mine", "other").alias("tj"), (F.col("mine") > F.col("other")).alias("second"), "id", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        x, there = _matrix(t.column("v"))
        ids, second = t.column("id").to_numpy(), t.column("second").to_numpy()
        alone = t.column("ti")[0].as_py() == t.column("tj")[0].as_py()
        first, other = np.flatnonzero(~second), np.flatnonzero(~second if alone else second)
        whole = bool(there.all())
        right = np.ascontiguousarray(x[:, other])
        for k in range(0, len(first), STRIP):
            strip = first[k : k + STRIP]
            with np.errstate(invalid="ignore"):
                i, j = np.nonzero(~(x[:, strip].T @ right <= least - SLACK))
            i, j = strip[i], other[j]
            keep = ids[i] < ids[j] if alone else ids[i] != ids[j]
            i, j = i[keep], j[keep]
            s, any_ = np.zeros(len(i)), np.zeros(len(i), bool)
            with np.errstate(invalid="ignore"):
                for c, ok in zip(x, there, strict=True):  # in the order of components
                    both = True if whole else ok[i] & ok[j]
                    s = s + np.where(both, c[i] * c[j], 0.0)
                    any_ |= both
                keep = any_ & ~(s <= least)
            a, b = np.minimum(ids[i], ids[j])[keep], np.maximum(ids[i], ids[j])[keep]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s[keep])], ["a", "b", "s"])

    return dealt.groupBy("g", "ti", "tj").applyInArrow(meet, "a long, b long, s double")
