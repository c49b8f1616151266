"""Vector and matrix algebra on array columns, and tensors as coordinate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def rounded(x: Column, n: int = 0) -> Column:
    """x to n places as SQL's round of doubles does it: halves of x * 10^n away from zero, a zero keeps its sign.

    Spark's own round takes halves of the shortest decimal number that spells x, and loses the sign of a zero.
    """
    x = x.cast("double")
    y = F.round(x * float(10**n), 0) / float(10**n)
    return F.when(y == 0, x * 0.0).when(F.abs(y) == float("inf"), x).otherwise(y)


def quotient(x: Column, y: Column) -> Column:
    """x / y of doubles where a zero in y gives an infinity or NaN, as in IEEE arithmetic."""
    inf = F.when(y.cast("string") == "-0.0", F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(y != 0, x / y).when(y == 0, x * inf)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n != 0, dot(a, b) / n)


def cross(a: Column, b: Column) -> Column:
    g = lambda i, j: a[i] * b[j] - a[j] * b[i]
    return F.array(g(1, 2), g(2, 0), g(0, 1))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def matvec(m: Column, x: Column) -> Column:
    return F.transform(m, lambda row: dot(row, x))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / total(e))


def inverse_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Rows of the inverse of [[a, b], [c, d]]; null if it is singular."""
    det = a * d - b * c
    return F.when(det != 0, F.array(F.array(d / det, -b / det), F.array(-c / det, a / det)))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices of rows (i, j, v): a join on the inner index, then grouped sums."""
    x, y = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def reshape(t: DataFrame, cols: int, new_cols: int) -> DataFrame:
    """Row-major view of rows (i, j, v) with another number of columns."""
    flat = F.col("i") * cols + F.col("j")
    return t.select(F.floor(flat / new_cols).alias("i"), F.pmod(flat, F.lit(new_cols)).alias("j"), "v")
