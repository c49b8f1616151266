"""Recursions along an order as an associative scan, so that one key of any length spreads over many tasks.

A step x -> (a x + b) / (c x + d) is a 2 x 2 matrix, and steps compose by matrix products. Each range of rows composes its
own steps first; what earlier ranges of the same key do to the start is applied afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomwork.sources.sinks import scratch_path

#: Rows whose steps are composed by doubling at a time.
BLOCK = 4096
_STEP = ["__a", "__b", "__c", "__d"]


def _then(late: np.ndarray, early: np.ndarray) -> np.ndarray:
    """The matrices (rows of a, b, c, d) of first taking the early step, then the late one, scaled to entries of about 1."""
    a, b, c, d = late.T
    e, f, g, h = early.T
    out = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h], axis=1)
    top = np.abs(out).max(axis=1, keepdims=True)
    return out / np.where((top > 0) & np.isfinite(top), top, 1.0)


def compose(steps: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The product of the steps up to each row since the last row marked ``fresh`` (row 0 counts as one)."""
    out = steps.copy()
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(steps)), 0))
    gap = 1
    while gap < len(steps):
        at = np.flatnonzero(np.arange(len(steps)) - first >= gap)
        out[at] = _then(out[at], out[at - gap])
        gap *= 2
    return out


def _local(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Of rows in order: the composed steps of the row's key within this range, and the number of the range."""
    from pyspark import TaskContext

    piece, now, held = TaskContext.get().partitionId(), None, None
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            cols = [part.column(k) for k in range(keys)]
            fresh = np.append(True, np.zeros(len(part) - 1, bool))
            for c in cols:
                code = np.asarray(c.dictionary_encode(null_encoding="encode").indices)
                fresh[1:] |= code[1:] != code[:-1]
            steps = np.stack([np.asarray(part.column(part.num_columns - 4 + k).cast(pa.float64())) for k in range(4)], axis=1).astype(np.float64)
            out = compose(steps, fresh)
            first = tuple(c[0].as_py() for c in cols)
            if first == now:  # the key goes on
                same = int(np.argmax(fresh[1:])) + 1 if fresh[1:].any() else len(out)
                out[:same] = _then(out[:same], np.repeat(held[None], same, axis=0))
            now, held = tuple(c[len(part) - 1].as_py() for c in cols), out[-1].copy()
            rest = part.columns[: part.num_columns - 4]
            yield pa.RecordBatch.from_arrays([*rest, *[pa.array(c) for c in out.T], pa.array(np.full(len(part), piece))], [*part.schema.names, "__piece"])


def scan(df: DataFrame, keys: list[str], order: list[str], step: tuple[Column, Column, Column, Column], start: Column | float, out: str) -> DataFrame:
    """The columns of df and ``out``: x after each row's step x -> (a x + b) / (c x + d), from ``start`` within each key.

    Rows are dealt out by ranges of key and order, so a key with most of the rows lies in many ranges; ``order`` should tell
    its rows apart, as equal ones fall into one range. Only keys that lie in several ranges need what the earlier
    ranges did, at most one row a range, which is broadcast. A null or NaN step makes its key NaN from there on.
    """
    spark = df.sparkSession
    nan = F.lit(float("nan"))
    rows = df.select(*df.columns, *[F.coalesce(c.cast("double"), nan).alias(n) for c, n in zip(step, _STEP, strict=True)])
    names = [*keys, *[c for c in rows.columns if c not in keys]]
    ranged = rows.select(*names).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = StructType([*ranged.schema.fields, StructField("__piece", LongType())])
    k = len(keys)
    path = scratch_path(spark, "scan")
    ranged.mapInArrow(lambda batches: _local(batches, k), schema).write.parquet(path)
    held = spark.read.schema(schema).parquet(path)

    # of each key in each range: its last row, all of the range's steps composed; only keys in several ranges go on
    last = held.groupBy(*keys, "__piece").agg(F.max_by(F.array(*_STEP), F.struct(*order)).alias("m"))
    ranges = Window.partitionBy(*keys).orderBy("__piece")
    several = last.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1")
    before = several.withColumn("ms", F.collect_list("m").over(ranges.rowsBetween(Window.unboundedPreceding, -1))).where(F.size("ms") > 0)
    then = lambda e, m: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)), lambda i: F.get(m, F.floor(i / 2).cast("int") * 2) * F.get(e, (i % 2).cast("int")) + F.get(m, F.floor(i / 2).cast("int") * 2 + 1) * F.get(e, (i % 2).cast("int") + 2))
    scaled = lambda m: F.transform(m, lambda v: v / F.greatest(F.array_max(F.transform(m, lambda w: F.abs(w))), F.lit(1e-300)))
    one = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    before = before.select(*[F.col(c).alias(f"__k_{c}") for c in keys], F.col("__piece").alias("__k_piece"), F.aggregate("ms", one, lambda e, m: scaled(then(e, m))).alias("__m"))
    same = F.col("__piece") == F.col("__k_piece")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    joined = held.join(F.broadcast(before), same, "left")  # at most one row a range
    begin = F.lit(start).cast("double") if not isinstance(start, Column) else start
    m = F.coalesce(F.col("__m"), one)
    x0 = (m[0] * begin + m[1]) / (m[2] * begin + m[3])
    joined = joined.withColumn("__x", x0)
    value = (F.col("__a") * F.col("__x") + F.col("__b")) / (F.col("__c") * F.col("__x") + F.col("__d"))
    return joined.select(*df.columns, value.alias(out))


def linear(df: DataFrame, keys: list[str], order: list[str], a: Column | float, b: Column, start: Column | float, out: str) -> DataFrame:
    """x after each row's step x -> a x + b."""
    return scan(df, keys, order, (F.lit(a) if not isinstance(a, Column) else a, b, F.lit(0.0), F.lit(1.0)), start, out)


def kalman(df: DataFrame, keys: list[str], order: list[str], x: str, *, q: float, r: float, start: float, start_var: float, level: str = "level", var: str = "var") -> DataFrame:
    """A local level followed by a scalar Kalman filter: process noise q, measurement noise r; a null measurement only predicts.

    The variance follows P -> r (P + q) / (P + q + r) and the level x -> (1 - K) x + K y with K = P / r, so two scans do.
    """
    seen = F.col(x).isNotNull()
    step = tuple(F.when(seen, F.lit(v)).otherwise(F.lit(u)) for v, u in ((r, 1.0), (r * q, q), (1.0, 0.0), (q + r, 1.0)))
    df = scan(df, keys, order, step, start_var, var)
    gain = F.when(seen, F.col(var) / r).otherwise(F.lit(0.0))
    return linear(df, keys, order, 1 - gain, gain * F.coalesce(F.col(x).cast("double"), F.lit(0.0)), start, level)


def _pieces(df: DataFrame, order: list[str], x: str | None) -> tuple[DataFrame, list[str]]:
    """Rows of df in ranges of order, written: with their place in their range (and, of x, its running sum and its running excess over 0)."""
    spark = df.sparkSession
    extra = ["__piece", "__at", *([] if x is None else ["__sum", "__over"])]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = [StructField("__piece", LongType()), StructField("__at", LongType()), *[StructField(c, DoubleType()) for c in extra[2:]]]
    schema = StructType([*df.schema.fields, *kinds])
    names = df.columns
    column = names.index(x) if x is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece, at, total, low = TaskContext.get().partitionId(), 0, 0.0, 0.0
        for batch in batches:
            n = len(batch)
            cols = [pa.array(np.full(n, piece)), pa.array(np.arange(at + 1, at + n + 1))]
            if column is not None and n:
                s = total + np.cumsum(np.asarray(batch.column(column).cast(pa.float64()).fill_null(0.0)))
                lows = np.minimum(np.minimum.accumulate(s), low)
                cols += [pa.array(s), pa.array(s - lows)]
                total, low = float(s[-1]), float(lows[-1])
            elif column is not None:
                cols += [pa.array([], pa.float64())] * 2
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, *extra])

    path = scratch_path(spark, "pieces")
    ranged.mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path), extra


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds out, a row's number (from 1) in the order of all rows: counts of whole ranges are carried, so no task sees all rows."""
    held, extra = _pieces(df, order, None)
    sizes = held.groupBy("__piece").agg(F.count("*").alias("n"))  # one row a range
    before = sizes.select("__piece", (F.sum("n").over(Window.orderBy("__piece")) - F.col("n")).alias("__before"))
    return held.join(F.broadcast(before), "__piece").select(*df.columns, (F.col("__before") + F.col("__at")).alias(out))


def rising_sum(df: DataFrame, order: list[str], x: str, out: str) -> DataFrame:
    """Adds out, c = max(0, c + x) along all rows from 0 (a null x counts as 0): a range does max(m, c + s) to what comes before it, and such steps compose."""
    held, extra = _pieces(df, order, x)
    last = held.groupBy("__piece").agg(F.max_by(F.struct(F.col("__sum").alias("s"), F.col("__over").alias("m")), "__at").alias("v"))  # one row a range
    w = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.aggregate(F.collect_list("v").over(w), F.lit(0.0), lambda c, v: F.greatest(v["m"], c + v["s"]))
    begun = last.select("__piece", start.alias("__start"))
    return held.join(F.broadcast(begun), "__piece").select(*df.columns, F.greatest("__over", F.col("__start") + F.col("__sum")).alias(out))
