"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import scratch

#: Equal texts meet in one of so many cells. The packing places cells, and groups above HOT of the whole by themselves.
CELLS, HOT = 4096, 1 / 512
#: What bytes, tokens and rows weigh when moves are judged.
WEIGHTS = np.array([64.0, 1.0, 1.0])


def pack(items: np.ndarray, bins: int) -> np.ndarray:
    """Place each row of items (one column a dimension) into one of the bins.

    Largest items go first; each goes where the dot product of its vector with the residual capacity is
    highest (ties: the lowest bin). Capacity is an equal share of each dimension. Moves of single items from
    the bin with most bytes to the one with least follow as long as they bring these two nearer to their
    capacity, judged over all dimensions.
    """
    items = np.asarray(items, dtype=np.float64)
    where = np.zeros(len(items), dtype=np.int64)
    if not len(items):
        return where
    share = items / np.maximum(items.sum(axis=0), 1.0) * bins
    residual = np.ones((bins, share.shape[1]))
    weights = WEIGHTS[: share.shape[1]]
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1))):
        where[i] = int(np.argmax(residual @ share[i]))
        residual[where[i]] -= share[i]
    for _ in range(4 * len(items)):
        full, empty = int(np.argmin(residual[:, 0])), int(np.argmax(residual[:, 0]))
        mine = np.flatnonzero(where == full)
        after = ((residual[full] + share[mine]) ** 2 + (residual[empty] - share[mine]) ** 2) @ weights
        best = int(np.argmin(after)) if len(mine) else 0
        if not len(mine) or after[best] >= (residual[full] ** 2 + residual[empty] ** 2) @ weights - 1e-12:
            break
        residual[full] += share[mine[best]]
        residual[empty] -= share[mine[best]]
        where[mine[best]] = empty
    return where


def vector_shards(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Every row with its shard and its slot there.

    Equal texts form a group and stay together; only a group larger than a whole shard (in bytes, tokens or rows) is
    split over several. Groups above HOT of the whole are packed by themselves, others by the cell that they meet in,
    so the driver packs at most ``cells`` vectors plus 3 / HOT for hot groups and the parts of split ones.

    Returns the id, size (UTF-8 bytes + 1), text_crc32, tokens, shard and slot (gapless from 0 in each shard).
    A null text has size 1, no token and the crc32 of an empty text; null ids and repeated rows are rows like
    any other; an empty table gives an empty table. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    base = scratch.table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.length(text) - F.length(F.translate(text, " \n\t", "")) + F.when(text == "", 0).otherwise(1), F.lit(0)).cast("long").alias("tokens"),
            F.xxhash64(text).alias("g"),
            F.xxhash64(F.monotonically_increasing_id()).alias("row"),
        ).withColumn("cell", F.pmod(F.col("g"), F.lit(cells)).cast("int")),
        "sharding",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    vector = lambda r: np.array([r["size"], r["tokens"], r["n"]], dtype=np.float64)
    by_cell = base.groupBy("cell").agg(*sums).collect()  # at most `cells` rows
    total = np.maximum(np.array([vector(r) for r in by_cell]).reshape(-1, 3).sum(axis=0), 1)
    cap = np.maximum(total * max(HOT, 8 / cells), 1)
    heavy = [r["cell"] for r in by_cell if any(vector(r) > cap)]
    hot = []
    if heavy:
        over = (F.col("size") > float(cap[0])) | (F.col("tokens") > float(cap[1])) | (F.col("n") > float(cap[2]))
        hot = base.where(F.col("cell").isin(heavy)).groupBy("g").agg(*sums).where(over).orderBy("g").collect()  # each holds a fixed share of the whole, so these are few
    # a unit goes to one shard; its slices only spread the work of numbering its rows
    plans, unit = [], cells
    for r in hot:
        parts = 1 if all(vector(r) <= total / n_shards) else 4 * math.ceil(max(vector(r) / total) * n_shards)
        plans.append((r["g"], unit, parts, math.ceil(max(vector(r) / cap)) if parts == 1 else 1))
        unit += parts
    plans = spark.createDataFrame(plans, "g long, first int, parts int, slices int")
    placed = base.join(F.broadcast(plans), "g", "left")  # at most 3 / HOT rows
    placed = placed.select(
        "doc_id", "size", "text_crc32", "tokens", "row",
        F.coalesce(F.col("first") + F.pmod("row", "parts"), F.col("cell")).cast("int").alias("unit"),
        F.coalesce(F.pmod(F.shiftright("row", 20), F.col("slices")), F.lit(0)).cast("int").alias("slice"),
    )
    slices = placed.groupBy("unit", "slice").agg(*sums).orderBy("unit", "slice").collect()  # the units and a bounded number of slices
    units = sorted({r["unit"] for r in slices})
    place = {u: k for k, u in enumerate(units)}
    items = np.zeros((len(units), 3))
    for r in slices:
        items[place[r["unit"]]] += vector(r)
    where = pack(items, n_shards)
    offset, rows = np.zeros(n_shards, dtype=np.int64), []
    for r in slices:
        s = where[place[r["unit"]]]
        rows.append((int(r["unit"]), int(r["slice"]), int(s), int(offset[s])))
        offset[s] += r["n"]
    plan = spark.createDataFrame(rows, "unit int, slice int, shard int, at long")
    order = Window.partitionBy("unit", "slice").orderBy("doc_id", "text_crc32", "size", "row")
    return (
        placed.join(F.broadcast(plan), ["unit", "slice"])  # as many rows as the driver packed
        .withColumn("slot", F.col("at") + F.row_number().over(order) - 1)
        .select("doc_id", "size", "text_crc32", "tokens", "shard", "slot")
    )


def op9_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return vector_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op9_vector_bin_packing": op9_vector_bin_packing}
