"""Statistical process monitoring: charts, decompositions, distances between distributions, false-alarm control."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import vectors as V
from loomwork.operators import scan as S


def ewma(df: DataFrame, key: str, order: list[str], x: str, lam: float, start: float = 0.0) -> DataFrame:
    """z_t = lam * x_t + (1 - lam) * z_(t-1) within each key, from ``start``; null from a null x on.

    An associative scan: a key with most of the rows spreads over many tasks.
    """
    rows = df.select(key, *order, F.col(x).cast("double").alias("__x"))
    found = S.linear(rows, [key], order, 1 - lam, lam * F.col("__x"), start, "z")
    return found.select(key, *order, F.nanvl("z", F.lit(None).cast("double")).alias("z"))


def cusum(df: DataFrame, key: str | list[str], order: list[str], x: str, k: float) -> DataFrame:
    """c_up = max(0, c_up + x - k) and c_dn = min(0, c_dn + x + k), without recursion.

    With S the running sum of x - k, c_up is S less the lowest S so far (0 included); c_dn mirrors it.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("__u", F.sum(F.col(x) - k).over(w)).withColumn("__d", F.sum(F.col(x) + k).over(w))
    return s.withColumn("c_up", F.col("__u") - F.least(F.lit(0.0), F.min("__u").over(w))).withColumn("c_dn", F.col("__d") - F.greatest(F.lit(0.0), F.max("__d").over(w))).drop("__u", "__d")


def moments(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariances of a few columns: p * p numbers on the driver."""
    p = len(cols)
    one = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]).first()
    return np.array([one[f"m{i}"] for i in range(p)]), np.array([[one[f"c{i}_{j}"] for j in range(p)] for i in range(p)])


def centred(cols: list[str], mu: np.ndarray) -> Column:
    return F.array(*[F.col(c) - float(m) for c, m in zip(cols, mu, strict=True)])


def literal(m: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m])


def t2(d: Column, inv: np.ndarray) -> Column:
    """d' S^-1 d for a column of centred vectors."""
    return V.dot(d, V.matvec(literal(inv), d))


def contributions(d: Column, root: np.ndarray) -> Column:
    """Squares of root * d; they sum to T2 if root' root is the inverse covariance."""
    return F.transform(V.matvec(literal(root), d), lambda z: z * z)


def cholesky_root(inv: np.ndarray) -> np.ndarray:
    """L' with L L' = inv."""
    return np.linalg.cholesky(inv).T


def symmetric_root(inv: np.ndarray) -> np.ndarray:
    w, q = np.linalg.eigh(inv)
    return q @ np.diag(np.sqrt(w)) @ q.T


def principal(cov: np.ndarray, k: int) -> np.ndarray:
    """The k leading loadings as columns, each with its largest element positive."""
    w, q = np.linalg.eigh(cov)
    p = q[:, np.argsort(-w)[:k]]
    return p * np.sign(p[np.argmax(np.abs(p), axis=0), np.arange(k)])


def ecdf_pairs(df: DataFrame, x: str, is_new: Column) -> DataFrame:
    """Distinct values with both distribution functions at them and the next value; counts come first, so ties are one row."""
    by = df.groupBy(F.col(x).alias("x")).agg(F.count_if(is_new).alias("a"), F.count_if(~is_new).alias("b"))
    n = by.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    w = Window.orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    j = by.select("x", F.sum("a").over(run).alias("ca"), F.sum("b").over(run).alias("cb"), F.lead("x").over(w).alias("next"))
    return j.join(F.broadcast(n)).select("x", "next", (F.col("ca") / F.col("na")).alias("fa"), (F.col("cb") / F.col("nb")).alias("fb"))  # n is one row


def benjamini_hochberg(df: DataFrame, p: str, alpha: float) -> DataFrame:
    """Adds reject: p is at most the largest p_(i) with p_(i) <= i * alpha / m."""
    by = df.groupBy(F.col(p).alias("pv")).agg(F.count("*").alias("k"))
    ranked = by.withColumn("i", F.sum("k").over(Window.orderBy("pv").rowsBetween(Window.unboundedPreceding, 0)))
    m = df.agg(F.count("*").alias("m"))
    cut = ranked.join(F.broadcast(m)).where(F.col("pv") <= F.col("i") * alpha / F.col("m")).agg(F.max("pv").alias("cut"))
    return df.join(F.broadcast(cut)).withColumn("reject", F.coalesce(F.col(p) <= F.col("cut"), F.lit(False))).drop("cut")  # one row each


def protected_update(values: list[float], reference: float, limit: float, eta: float) -> list[tuple[float, float, bool]]:
    """Distance to the reference, the reference after it, and whether it was updated: only in-control values move it."""
    out = []
    for x in values:
        d = abs(x - reference)
        if d <= limit:
            reference = (1 - eta) * reference + eta * x
        out.append((d, reference, d <= limit))
    return out


def ridge_cusum(df: DataFrame, key: str, order: str, cols: list[str], *, alpha: float = 1.0, k: float = 0.25, h: float = 5.0) -> DataFrame:
    """key, order, worst and alarm: every column is predicted from the others and from all columns one row earlier of its key, by ridge
    regression with an intercept; standardised residuals go to two-sided CUSUMs, and a row alarms if any of them is beyond h.

    ``worst`` is the largest size of a CUSUM at the row. The first row of a key has nothing before it and is left out. Only second
    moments reach the driver; a residual that doesn't vary stays at 0. Rows with a null in cols play no part.
    """
    before = [f"__b_{c}" for c in cols]
    w = Window.partitionBy(key).orderBy(order)
    rows = df.na.drop(subset=cols).select(key, order, *[F.col(c).cast("double").alias(c) for c in cols])
    rows = rows.select("*", *[F.lag(c).over(w).alias(b) for c, b in zip(cols, before, strict=True)]).where(F.col(before[0]).isNotNull())
    every = [*cols, *before]
    got = rows.agg(F.count("*"), *[F.avg(c) for c in every], *[F.covar_pop(a, b) for i, a in enumerate(every) for b in every[: i + 1]]).first()
    n, mean = got[0], [x or 0.0 for x in got[1 : 1 + len(every)]]
    s = np.zeros((len(every), len(every)))
    for v, (i, j) in zip(got[1 + len(every) :], [(i, j) for i in range(len(every)) for j in range(i + 1)], strict=True):
        s[i, j] = s[j, i] = (v or 0.0) * n
    each = []
    for y in range(len(cols)):
        x = [i for i in range(len(every)) if i != y]
        beta = np.linalg.solve(s[np.ix_(x, x)] + alpha * np.eye(len(x)), s[x, y])
        sd = float(np.sqrt(max(s[y, y] - 2 * beta @ s[x, y] + beta @ s[np.ix_(x, x)] @ beta, 0.0) / max(n - 1, 1)))
        fit = sum((F.lit(float(b)) * (F.col(every[i]) - F.lit(float(mean[i]))) for b, i in zip(beta, x, strict=True)), F.lit(0.0))
        e = F.col(every[y]) - F.lit(float(mean[y])) - fit
        each.append(F.struct(F.lit(y).alias("y"), (e / sd if sd > 0 else F.lit(0.0)).alias("z")))
    z = rows.select(key, order, F.inline(F.array(*each)))
    c = cusum(z, [key, "y"], [order], "z", k)
    size = F.greatest(F.col("c_up"), -F.col("c_dn"))
    return c.groupBy(key, order).agg(F.max(size).alias("worst")).select(key, order, "worst", (F.col("worst") > h).alias("alarm"))


def kernel_means(hist: DataFrame, group: str, bin_: str, n: str, reach: int) -> DataFrame:
    """a, b and e: the mean of the kernel max(0, 1 - distance / reach) over all pairs of a value of group a and one of b, from counts of bins.

    Each bin meets only the bins within reach, so pairs are joined by equal bins and no bin meets all others. Groups that
    share no near bins have no row.
    """
    total = hist.groupBy(group).agg(F.sum(n).alias("__t"))
    p = hist.join(total, group).select(F.col(group).alias("a"), F.col(bin_).alias("bin"), (F.col(n) / F.col("__t")).alias("w"))
    near = p.select("a", "w", F.explode(F.sequence(F.lit(1 - reach), F.lit(reach - 1))).alias("d"), "bin").select("a", "w", (1 - F.abs("d") / reach).alias("k"), (F.col("bin") + F.col("d")).alias("bin"))
    other = p.select(F.col("a").alias("b"), "bin", F.col("w").alias("v"))
    return near.join(other, "bin").groupBy("a", "b").agg(F.sum(F.col("w") * F.col("v") * F.col("k")).alias("e"))
