"""Joins, reshaping and ordering that data frames of other libraries offer, with their rules for nulls and names."""

from __future__ import annotations

import math

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(left: DataFrame, right: DataFrame, on: str | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), left_on: str | None = None, right_on: str | None = None) -> DataFrame:
    """Equi-join; columns that both sides have get suffixes. Null keys of an outer merge meet nothing.

    With ``on`` (or equal names) the key stays one column, with ``left_on`` and ``right_on`` both keys stay.
    """
    lkey, rkey = left_on or on, right_on or on
    if lkey is None or rkey is None:
        raise ValueError("a merge needs on, or left_on and right_on")
    clash = [c for c in left.columns if c in right.columns and not c == lkey == rkey]
    names = {c: c + suffixes[0] for c in clash}, {c: c + suffixes[1] for c in clash}
    a, b = left.withColumnsRenamed(names[0]), right.withColumnsRenamed(names[1])
    if lkey == rkey:
        return a.join(b, lkey, how)
    return a.join(b, a[names[0].get(lkey, lkey)] == b[names[1].get(rkey, rkey)], how)


def group_agg(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """Group without a group for the null key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max; NaN counts as missing."""
    x = F.when(~F.isnan(F.col(col).cast("double")), F.col(col).cast("double"))
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = df.agg(F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q.alias("q"), F.max(x).alias("max"))
    return one.select("count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def pivot_table(df: DataFrame, index: str, columns: str, values: list, value: str, agg: Callable[[Column], Column] = F.avg, fill: float | None = None, margins: str | None = None) -> DataFrame:
    """One column for each of the given values, aggregated in one pass; rows with other values or null keys take no part.

    ``margins`` names a last column and a row over all of them, aggregated from the rows themselves; the index is then a string.
    """
    kept = df.where(F.col(index).isNotNull() & F.col(columns).isin(values))
    cells = [agg(F.when(F.col(columns) == v, F.col(value))).alias(str(v)) for v in values]
    if margins is None:
        out = kept.groupBy(index).agg(*cells)
    else:
        rolled = kept.rollup(index).agg(F.grouping(index).alias("__all"), *cells, agg(F.col(value)).alias(margins))
        out = rolled.select(F.when(F.col("__all") == 1, margins).otherwise(F.col(index).cast("string")).alias(index), *[str(v) for v in values], margins)
    return out if fill is None else out.na.fill(fill, [c for c in out.columns if c != index])


def pivot_unique(df: DataFrame, index: str, columns: str, values: list, value: str) -> DataFrame:
    """Pivot without aggregation: more than one row for a cell is an error."""
    cell = F.when(F.count("*") > 1, F.raise_error(F.lit("index contains duplicate entries"))).otherwise(F.first(value))
    cells = df.groupBy(index, columns).agg(cell.alias("__v"))
    return cells.groupBy(index).pivot(columns, values).agg(F.first("__v"))


def tail(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The last n rows, in ascending order again."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def top_by_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def sync_plan(left: DataFrame, right: DataFrame, key: str, value: str, mode: str = "mirror") -> DataFrame:
    """What a synchronisation does to each path: copy, delete or keep.

    ``mirror`` makes the right side equal to the left, ``update`` never deletes, ``two-way`` copies what only one side has.
    """
    a, b = left.select(key, F.col(value).alias("l")), right.select(key, F.col(value).alias("r"))
    only_right = {"mirror": "delete", "update": "keep", "two-way": "copy left"}[mode]
    action = F.when(F.col("r").isNull(), "copy right").when(F.col("l").isNull(), only_right).when(F.col("l") != F.col("r"), "copy right").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in bins of equal width between minimum and maximum; the maximum falls into the last."""
    span = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    at = F.least(F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)).cast("int")
    return df.join(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # span is one row


def or_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def poisson_weight(row_id: Column, replicate: int) -> Column:
    """A Poisson count of mean 1, hashed from row and replicate: the inverse of its distribution function at 16 bits of an md5, eight replicates to a hash."""
    digest = F.md5(F.concat_ws(":", row_id.cast("string"), F.lit(replicate // 8)).cast("binary"))
    u = F.conv(F.substring(digest, 1 + 4 * (replicate % 8), 4), 16, 10).cast("long")
    total, term, out = 0.0, math.exp(-1), F.lit(0)
    for k in range(8):
        total += term
        out = out + (u >= round(total * 65536)).cast("int")
        term /= k + 1
    return out


def bootstrap_means(df: DataFrame, keys: list[str], row_id: str, x: str, replicates: int = 32) -> DataFrame:
    """keys, replicate and mean of each Poisson bootstrap replicate: every row counts as often as hashed from its id, in one pass, and no row is repeated.

    Sums are added up before anything moves. A replicate without rows has a null mean; rows with a null x play no part.
    """
    held = df.where(F.col(x).isNotNull())
    sums = []
    for b in range(replicates):
        w = poisson_weight(F.col(row_id), b)
        sums += [F.sum(w * F.col(x)).alias(f"s{b}"), F.sum(w).alias(f"w{b}")]
    wide = held.groupBy(*keys).agg(*sums)
    each = F.inline(F.array(*[F.struct(F.lit(b).alias("replicate"), F.when(F.col(f"w{b}") > 0, F.col(f"s{b}") / F.col(f"w{b}")).alias("mean")) for b in range(replicates)]))
    return wide.select(*keys, each)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, degrees of freedom and rows of the contingency table of two columns; pairs that don't occur count through the margins.

    The sum of n^2 / (row * column) over occurring pairs is enough, so the table is never filled up. Rows with a null in either play no part.
    """
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ra, rb = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    part = n.join(ra, "a").join(rb, "b").agg(F.sum(F.expr("n * (n / na) / nb")).alias("q"), F.sum("n").alias("n"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    return part.select((F.col("n") * (F.col("q") - 1)).alias("chi2"), F.expr("(ka - 1) * (kb - 1)").alias("dof"), "n")
