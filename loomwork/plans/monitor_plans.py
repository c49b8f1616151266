"""Windows and process monitoring over events: user is the variable, ts the time, value the measurement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import vectors as V
from loomwork.operators import ensemble, scan, sparse, structure
from loomwork.operators import monitor as M
from loomwork.operators import relational as R
from loomwork.registry import query
from loomwork.sources import sinks
from loomwork.sources.tables import table
from loomwork.streaming.logs import tail_logs

r = lambda c, n=4: F.round(c, n)
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id {frame})"
_BY = lambda frame=None: (lambda w: w if frame is None else w.rowsBetween(*frame))(Window.partitionBy("user_id").orderBy("ts", "event_id"))


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query("win_monitor", f"SELECT event_id, m FROM (SELECT event_id, round(avg(value) {_W.format(frame='ROWS 9 PRECEDING')}, 4) AS m, count(*) {_W.format(frame='ROWS 9 PRECEDING')} AS n FROM events) WHERE n = 10")
def win_monitor(spark: SparkSession, sf: str) -> DataFrame:
    w = _BY((-9, 0))
    return _ev(spark, sf).select("event_id", r(F.avg("value").over(w)).alias("m"), F.count("*").over(w).alias("n")).where("n = 10").select("event_id", "m")


_EWMA = """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
z AS (SELECT user_id, event_id, i, 0.2 * value + 0.8 * 100 AS z FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, 0.2 * o.value + 0.8 * z.z FROM z JOIN o ON o.user_id = z.user_id AND o.i = z.i + 1) SELECT event_id, round(z, 4) AS z FROM z"""


@query("win_ewma", _EWMA)
def win_ewma(spark: SparkSession, sf: str) -> DataFrame:
    """The start value is ours: an in-control mean of 100."""
    return M.ewma(_ev(spark, sf), "user_id", ["ts", "event_id"], "value", 0.2, 100.0).select("event_id", r("z").alias("z"))


_CU = """WITH s AS (SELECT event_id, user_id, ts, sum((value - 100) / 50 - 0.25) {w} AS u, sum((value - 100) / 50 + 0.25) {w} AS d FROM events)
SELECT event_id, {c} FROM s"""


def _cusum(spark: SparkSession, sf: str) -> DataFrame:
    return M.cusum(_ev(spark, sf).withColumn("z", (F.col("value") - 100) / 50), "user_id", ["ts", "event_id"], "z", 0.25)


@query("win_cusum_up", _CU.format(w=_W.format(frame=""), c=f"round(u - least(0, min(u) {_W.format(frame='')}), 4) + 0.0 AS c_up"))
def win_cusum_up(spark: SparkSession, sf: str) -> DataFrame:
    return _cusum(spark, sf).select("event_id", (r("c_up") + 0.0).alias("c_up"))


@query("win_cusum_dn", _CU.format(w=_W.format(frame=""), c=f"round(d - greatest(0, max(d) {_W.format(frame='')}), 4) + 0.0 AS c_dn"))
def win_cusum_dn(spark: SparkSession, sf: str) -> DataFrame:
    return _cusum(spark, sf).select("event_id", (r("c_dn") + 0.0).alias("c_dn"))


@query("win_ma", f"SELECT event_id, round(avg(value) {_W.format(frame='ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING')}, 4) AS ma FROM events")
def win_ma(spark: SparkSession, sf: str) -> DataFrame:
    return _ev(spark, sf).select("event_id", r(F.avg("value").over(_BY((-2, 2)))).alias("ma"))


@query("win_median_filter", f"SELECT event_id, round(median(value) {_W.format(frame='ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING')}, 4) AS med FROM events")
def win_median_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _ev(spark, sf).select("event_id", r(F.percentile("value", F.lit(0.5)).over(_BY((-2, 2)))).alias("med"))


@query("win_causal", "SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS seen FROM conversations")
def win_causal(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.octet_length("text")).over(w).alias("seen"))


_TP = "WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM p), c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type) / sum(n) OVER (PARTITION BY user_id) AS cum FROM q)"


@query("win_topp_cum", _TP + " SELECT user_id, event_type, round(cum, 6) AS cum FROM c WHERE cum - p <= 0.6")
def win_topp_cum(spark: SparkSession, sf: str) -> DataFrame:
    """The token that crosses the bound stays, and one more on equality."""
    p = _ev(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    all_ = F.sum("n").over(Window.partitionBy("user_id"))
    c = p.select("user_id", "event_type", (F.col("n") / all_).alias("p"), (F.sum("n").over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")) / all_).alias("cum"))
    return c.where("cum - p <= 0.6").select("user_id", "event_type", r("cum", 6).alias("cum"))


@query("win_rank_residual", "SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value) - cume_dist() OVER (PARTITION BY user_id ORDER BY value), 6) + 0.0 AS r FROM events")
def win_rank_residual(spark: SparkSession, sf: str) -> DataFrame:
    u = lambda k: F.cume_dist().over(Window.partitionBy(k).orderBy("value"))
    return _ev(spark, sf).select("event_id", (r(u("event_type") - u("user_id"), 6) + 0.0).alias("r"))


_CP = "WITH cal AS (SELECT event_type, value FROM events WHERE event_id % 2 = 0), n AS (SELECT event_type, count(*) AS n FROM cal GROUP BY 1) SELECT event_id, round((1 + (SELECT count(*) FROM cal WHERE cal.event_type = e.event_type AND cal.value >= e.value)) / (n + 1), 6) AS p FROM events e JOIN n USING (event_type) WHERE event_id % 2 = 1"


def _conformal(e: DataFrame) -> DataFrame:
    """(1 + calibration scores at least as high) / (n + 1), by a running count of both kinds of rows."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"))
    above = F.count_if(F.col("event_id") % 2 == 0).over(w)
    n = F.count_if(F.col("event_id") % 2 == 0).over(Window.partitionBy("event_type"))
    return e.select("event_id", "user_id", "event_type", ((1 + above) / (n + 1)).alias("p")).where("event_id % 2 = 1")


@query("win_conformal_p", _CP)
def win_conformal_p(spark: SparkSession, sf: str) -> DataFrame:
    return _conformal(_ev(spark, sf)).select("event_id", r("p", 6).alias("p"))


@query("win_bh", "WITH p AS (SELECT event_id, round(1 - percent_rank() OVER (ORDER BY value), 9) * 0.2 + 0.0001 AS p FROM events), k AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p), c AS (SELECT max(p) AS cut FROM k WHERE p <= i * 0.1 / m) SELECT event_id, coalesce(p <= cut, false) AS reject FROM p, c")
def win_bh(spark: SparkSession, sf: str) -> DataFrame:
    by = _ev(spark, sf).groupBy("value").agg(F.count("*").alias("k"))
    below = F.coalesce(F.sum("k").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = _ev(spark, sf).agg(F.count("*").alias("n"))
    pv = by.withColumn("below", below).join(F.broadcast(n)).select("value", (F.round(1 - F.col("below") / (F.col("n") - 1), 9) * 0.2 + 0.0001).alias("p"))  # one row
    return M.benjamini_hochberg(_ev(spark, sf).select("event_id", "value").join(pv, "value"), "p", 0.1).select("event_id", "reject")


@query("win_time_gap", f"SELECT event_id, date_diff('microsecond', lag(ts) {_W.format(frame='')}, ts) AS gap, date_diff('microsecond', first(ts) {_W.format(frame='')}, ts) AS since FROM events")
def win_time_gap(spark: SparkSession, sf: str) -> DataFrame:
    micros = lambda a: F.timestamp_diff("MICROSECOND", a, F.col("ts"))
    return _ev(spark, sf).select("event_id", micros(F.lag("ts").over(_BY())).alias("gap"), micros(F.first("ts").over(_BY())).alias("since"))


@query("win_crowding", "WITH s AS (SELECT l_suppkey AS id, sum(l_quantity) AS a, count(DISTINCT l_partkey)::DOUBLE AS b FROM lineitem GROUP BY 1) SELECT id, coalesce(lead(a) OVER (ORDER BY a, id) - lag(a) OVER (ORDER BY a, id), 'inf'::DOUBLE) + coalesce(lead(b) OVER (ORDER BY b, id) - lag(b) OVER (ORDER BY b, id), 'inf'::DOUBLE) AS crowding FROM s")
def win_crowding(spark: SparkSession, sf: str) -> DataFrame:
    """Raw gaps between neighbours in each objective, summed; ends are infinite. One row for each solution."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("a"), F.count_distinct("l_partkey").cast("double").alias("b"))
    gap = lambda c: F.coalesce(F.lead(c).over(Window.orderBy(c, "id")) - F.lag(c).over(Window.orderBy(c, "id")), F.lit(float("inf")))
    return s.select("id", (gap("a") + gap("b")).alias("crowding"))


# wide samples: a user's day, one column for each event type
_TYPES = ["click", "error", "purchase", "signup", "view"]
_WIDE = "SELECT user_id AS u, ts::DATE AS d, " + ", ".join(f"coalesce(sum(value) FILTER (event_type = '{t}'), 0) AS x{i}" for i, t in enumerate(_TYPES)) + " FROM events GROUP BY ALL"
_X = [f"x{i}" for i in range(5)]


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return _ev(spark, sf).groupBy(F.col("user_id").alias("u"), F.to_date("ts").alias("d")).agg(*[F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0)).alias(f"x{i}") for i, t in enumerate(_TYPES)])


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    w = _wide(spark, sf)
    mu, cov = M.moments(w, _X)
    return w.withColumn("dev", M.centred(_X, mu)), mu, cov


_T2 = f"WITH w AS ({_WIDE}), m AS (SELECT avg(x0) AS a, avg(x1) AS b, var_samp(x0) AS va, var_samp(x1) AS vb, covar_samp(x0, x1) AS c FROM w) SELECT u, d, round(((x0 - a) * (x0 - a) * vb - 2 * (x0 - a) * (x1 - b) * c + (x1 - b) * (x1 - b) * va) / (va * vb - c * c), 4) AS t2 FROM w, m"


@query("spm_t2", _T2)
def spm_t2(spark: SparkSession, sf: str) -> DataFrame:
    w = _wide(spark, sf)
    mu, cov = M.moments(w, _X[:2])
    return w.select("u", "d", r(M.t2(M.centred(_X[:2], mu), np.linalg.inv(cov))).alias("t2"))


@query("spm_t2_script")
def spm_t2_script(spark: SparkSession, sf: str) -> DataFrame:
    """Squared norm of two principal scores, without scaling by eigenvalues."""
    w, _, cov = _two(spark, sf)
    p = M.principal(cov, 2)
    return w.select("u", "d", r(V.dot(V.matvec(M.literal(p.T), F.col("dev")), V.matvec(M.literal(p.T), F.col("dev")))).alias("t2"))


@query("spm_ucl_script", "SELECT 'nan'::DOUBLE AS ucl, 0::BIGINT AS flagged, quantile_cont(value, 0.99) AS empirical FROM events")
def spm_ucl_script(spark: SparkSession, sf: str) -> DataFrame:
    """The script's limit is the root of a negative number (n1 = 200, n2 = 3), so nothing is flagged; an empirical quantile serves."""
    ucl = F.sqrt(F.lit(200.0) * 3 / (3 - 200))
    return _ev(spark, sf).agg(F.first(ucl).alias("ucl"), F.count_if((F.col("value") > ucl) & ~F.isnan(ucl)).alias("flagged"), F.percentile("value", F.lit(0.99)).alias("empirical"))


@query("spm_myt", f"WITH w AS ({_WIDE}), m AS (SELECT " + ", ".join(f"avg({x}) AS m{x}, var_samp({x}) AS v{x}" for x in _X) + " FROM w) SELECT u, d, " + ", ".join(f"round(pow({x} - m{x}, 2) / v{x}, 5) AS c{x}" for x in _X) + " FROM w, m")
def spm_myt(spark: SparkSession, sf: str) -> DataFrame:
    w, _, cov = _two(spark, sf)
    return w.select("u", "d", *[r(F.pow(F.col("dev")[i], 2) / float(cov[i, i]), 5).alias(f"c{x}") for i, x in enumerate(_X)])


def _contrib(root) -> object:  # noqa: ANN001
    def run(spark: SparkSession, sf: str) -> DataFrame:
        w, _, cov = _two(spark, sf)
        inv = np.linalg.inv(cov)
        return w.select("u", "d", F.transform(M.contributions(F.col("dev"), root(inv)), lambda x: F.round(x, 4)).alias("parts"), r(M.t2(F.col("dev"), inv)).alias("t2"))

    return run


query("spm_hawkins")(_contrib(M.cholesky_root))
query("spm_runger")(_contrib(M.symmetric_root))


@query("spm_pca_load")
def spm_pca_load(spark: SparkSession, sf: str) -> DataFrame:
    """Sum over components of |score / sigma| * |loading| for each variable."""
    w, _, cov = _two(spark, sf)
    p = M.principal(cov, 2)
    s = np.sqrt(np.diag(p.T @ cov @ p))
    z = [F.abs(V.dot(F.col("dev"), F.array(*[F.lit(float(x)) for x in p[:, k]]))) / float(s[k]) for k in range(2)]
    return w.select("u", "d", *[r(z[0] * float(abs(p[j, 0])) + z[1] * float(abs(p[j, 1]))).alias(f"load_{x}") for j, x in enumerate(_X)])


@query("spm_spe")
def spm_spe(spark: SparkSession, sf: str) -> DataFrame:
    """Squared residual from the two-component subspace, and each variable's part."""
    w, _, cov = _two(spark, sf)
    p = M.principal(cov, 2)
    e = V.matvec(M.literal(np.eye(5) - p @ p.T), F.col("dev"))
    return w.select("u", "d", r(V.dot(e, e)).alias("q"), F.transform(F.zip_with(e, F.array(*[F.lit(float(v)) for v in np.diag(cov)]), lambda a, v: a * a / v), lambda x: F.round(x, 5)).alias("parts"))


@query("spm_pair_resid", f"SELECT u, d, unnest(['01','02','12']) AS pair, unnest([(x0 - x1) / 2, (x0 - x2) / 2, (x1 - x2) / 2]) AS r FROM ({_WIDE})")
def spm_pair_resid(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda i, j: F.struct(F.lit(f"{i}{j}").alias("pair"), ((F.col(f"x{i}") - F.col(f"x{j}")) / 2).alias("r"))
    return _wide(spark, sf).select("u", "d", F.inline(F.array(pair(0, 1), pair(0, 2), pair(1, 2))))


@query("spm_group_resid", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY ts::DATE, event_type), 7) + 0.0 AS by_mean, round(value - median(value) OVER (PARTITION BY ts::DATE, event_type), 7) + 0.0 AS by_median FROM events")
def spm_group_resid(spark: SparkSession, sf: str) -> DataFrame:
    e = _ev(spark, sf).select("event_id", F.to_date("ts").alias("d"), "event_type", "value")
    g = e.groupBy("d", "event_type").agg(F.avg("value").alias("m"), F.median("value").alias("med"))
    return e.join(g, ["d", "event_type"]).select("event_id", (r(F.expr("value - m"), 7) + 0.0).alias("by_mean"), (r(F.expr("value - med"), 7) + 0.0).alias("by_median"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of all pairs of the five variables: one row, then one for each ordered pair."""
    one = _wide(spark, sf).agg(*[F.corr(f"x{i}", f"x{j}").alias(f"r{i}{j}") for i in range(5) for j in range(5) if i < j])
    row = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{min(i, j)}{max(i, j)}").alias("rho"))
    return one.select(F.inline(F.array(*[row(i, j) for i in range(5) for j in range(5) if i != j])))


_RHO = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, corr(x{i}, x{j}) AS rho FROM w" for i in range(5) for j in range(5) if i != j) + ")"


@query("join_pairs", f"WITH w AS ({_WIDE}) SELECT i, j, round(rho, 5) AS rho FROM ({_RHO}) WHERE i < j AND abs(rho) >= 0.005")
def join_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).where("i < j AND abs(rho) >= 0.005").withColumn("rho", r("rho", 5))


_NB = f"SELECT i, j, rho, row_number() OVER (PARTITION BY i ORDER BY abs(rho) DESC, j) AS rk FROM ({_RHO})"


@query("ord_topk_neighbors", f"WITH w AS ({_WIDE}) SELECT i, j, rk::INT AS rank FROM ({_NB}) WHERE rk <= 2")
def ord_topk_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_by_group(_pairs(spark, sf), ["i"], [F.desc(F.abs("rho")), F.col("j")], 2).select("i", "j", "rank")


@query("spm_knn_resid", f"WITH w AS ({_WIDE}), nb AS ({_NB}), l AS (SELECT u, d, unnest(range(0, 5))::INT AS i, unnest([x0, x1, x2, x3, x4]) AS x FROM w) SELECT a.u, a.d, a.i, round(a.x - avg(b.x), 4) + 0.0 AS r FROM l a JOIN nb ON nb.i = a.i AND rk <= 2 JOIN l b ON b.u = a.u AND b.d = a.d AND b.i = nb.j GROUP BY a.u, a.d, a.i, a.x")
def spm_knn_resid(spark: SparkSession, sf: str) -> DataFrame:
    """A variable less the mean of its two most correlated ones; both come from the same wide row."""
    near = R.top_by_group(_pairs(spark, sf), ["i"], [F.desc(F.abs("rho")), F.col("j")], 2).groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("js"))
    l = _wide(spark, sf).withColumn("x", F.array(*_X)).select("u", "d", "x", F.posexplode("x").alias("i", "own"))  # noqa: E741
    j = l.join(F.broadcast(near), "i")  # five rows
    return j.select("u", "d", "i", (r(F.col("own") - (F.get("x", F.col("js")[0]) + F.get("x", F.col("js")[1])) / 2) + 0.0).alias("r"))


@query("spm_glasso_edges")
def spm_glasso_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of each user group: partial correlations that an L1 penalty on the inverse correlations leaves."""
    return sparse.edges(_wide(spark, sf).withColumn("g", F.col("u") % 10), "g", _X, 0.02).select("g", "i", "j", r("partial", 6).alias("partial"))


_EC = "WITH c AS (SELECT value AS x, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1), n AS (SELECT sum(a) AS na, sum(b) AS nb FROM c), f AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(a) OVER (ORDER BY x) / na AS fa, sum(b) OVER (ORDER BY x) / nb AS fb FROM c, n)"


@query("spm_ks", _EC + " SELECT round(max(abs(fa - fb)), 6) AS ks FROM f")
def spm_ks(spark: SparkSession, sf: str) -> DataFrame:
    return M.ecdf_pairs(_ev(spark, sf), "value", F.col("event_id") % 2 == 0).agg(r(F.max(F.abs(F.col("fa") - F.col("fb"))), 6).alias("ks"))


@query("spm_w1", _EC + " SELECT round(sum(abs(fa - fb) * (nx - x)), 5) AS w1 FROM f")
def spm_w1(spark: SparkSession, sf: str) -> DataFrame:
    return M.ecdf_pairs(_ev(spark, sf), "value", F.col("event_id") % 2 == 0).agg(r(F.sum(F.abs(F.col("fa") - F.col("fb")) * (F.col("next") - F.col("x"))), 5).alias("w1"))


_AD = "WITH o AS (SELECT user_id, least(greatest(1 - exp(-value / 50), 1e-9), 1 - 1e-9) AS f FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS i, row_number() OVER (PARTITION BY user_id ORDER BY f DESC) AS j, count(*) OVER (PARTITION BY user_id) AS n FROM o) SELECT user_id, round(-max(n) - sum((2 * i - 1) * ln(f) + (2 * j - 1) * ln(1 - f)) / max(n), 4) AS a2 FROM k GROUP BY 1"


@query("spm_ad", _AD)
def spm_ad(spark: SparkSession, sf: str) -> DataFrame:
    """Anderson-Darling of each user's values against an exponential distribution."""
    f = F.least(F.greatest(1 - F.exp(-F.col("value") / 50), F.lit(1e-9)), F.lit(1 - 1e-9))
    o = _ev(spark, sf).select("user_id", f.alias("f"))
    w = Window.partitionBy("user_id")
    k = o.select("user_id", "f", F.row_number().over(w.orderBy("f")).alias("i"), F.row_number().over(w.orderBy(F.desc("f"))).alias("j"), F.count("*").over(w).alias("n"))
    return k.groupBy("user_id").agg(r(-F.max("n") - F.sum(F.expr("(2 * i - 1) * ln(f) + (2 * j - 1) * ln(1 - f)")) / F.max("n")).alias("a2"))


_MMD = "WITH h AS (SELECT event_type, floor(value / 10) AS b, event_id % 2 AS side, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT event_type, side, sum(n) AS tot FROM h GROUP BY ALL), p AS (SELECT h.event_type, h.side, b, n / tot AS w FROM h JOIN t USING (event_type, side)) SELECT x.event_type, round(sum(CASE WHEN x.side = y.side THEN 1 ELSE -1 END * x.w * y.w * exp(-pow(x.b - y.b, 2) / 8)), 6) AS mmd2 FROM p x JOIN p y USING (event_type) GROUP BY 1"


def _mmd(spark: SparkSession, sf: str) -> DataFrame:
    """Squared MMD (biased form) with an RBF kernel between bins of width 10: pairs are of bins, not of rows."""
    h = _ev(spark, sf).groupBy("event_type", F.floor(F.col("value") / 10).alias("b"), (F.col("event_id") % 2).alias("side")).agg(F.count("*").alias("n"))
    p = h.select("event_type", "b", "side", (F.col("n") / F.sum("n").over(Window.partitionBy("event_type", "side"))).alias("w"))
    y = p.select("event_type", F.col("b").alias("b2"), F.col("side").alias("s2"), F.col("w").alias("w2"))
    sign = F.when(F.col("side") == F.col("s2"), 1).otherwise(-1)
    return p.join(y, "event_type").groupBy("event_type").agg((r(F.sum(sign * F.expr("w * w2 * exp(-pow(b - b2, 2) / 8)")), 6) + 0.0).alias("mmd2"))


query("spm_mmd", _MMD.replace(", 6) AS mmd2", ", 6) + 0.0 AS mmd2"))(_mmd)


@query("join_all_pairs_kernel", """WITH h AS (SELECT event_type AS t, floor(value / 5)::BIGINT AS b, count(*)::DOUBLE AS n FROM events GROUP BY ALL), p AS (SELECT t, b, n / sum(n) OVER (PARTITION BY t) AS w FROM h),
k AS (SELECT x.t AS a, y.t AS b, sum(x.w * y.w * (1 - abs(x.b - y.b) / 8.0::DOUBLE)) AS e FROM p x JOIN p y ON abs(x.b - y.b) < 8 GROUP BY ALL)
SELECT k.a, k.b, round(k.e, 8) AS kernel, round(aa.e + bb.e - 2 * k.e, 8) + 0.0 AS mmd2 FROM k JOIN k aa ON aa.a = k.a AND aa.b = k.a JOIN k bb ON bb.a = k.b AND bb.b = k.b WHERE k.a < k.b""")
def join_all_pairs_kernel(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of a triangular kernel over all pairs of values of two event types, and their squared mean discrepancy: a join of bins with the bins near them."""
    h = _ev(spark, sf).groupBy(F.col("event_type").alias("t"), F.floor(F.col("value") / 5).alias("bin")).agg(F.count("*").alias("n"))
    e = M.kernel_means(h, "t", "bin", "n", 8)
    own = e.where("a = b").select("a", F.col("e").alias("own"))
    both = e.where("a < b").join(own.withColumnRenamed("own", "ea"), "a").join(own.select(F.col("a").alias("b"), F.col("own").alias("eb")), "b")
    return both.select("a", "b", r("e", 8).alias("kernel"), (r(F.expr("ea + eb - 2 * e"), 8) + 0.0).alias("mmd2"))


@query("spm_quantile_shift", "SELECT event_type, round(quantile_cont(value, 0.95) FILTER (ts >= TIMESTAMP '2024-01-15') - quantile_cont(value, 0.95) FILTER (ts < TIMESTAMP '2024-01-15'), 4) AS shift FROM events GROUP BY 1")
def spm_quantile_shift(spark: SparkSession, sf: str) -> DataFrame:
    new = F.date_format("ts", "yyyy-MM-dd") >= "2024-01-15"
    q = lambda c: F.percentile(F.when(c, F.col("value")), F.lit(0.95))
    return _ev(spark, sf).groupBy("event_type").agg(r(q(new) - q(~new)).alias("shift"))


@query("join_ref_window", "WITH s AS (SELECT user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') AS ref, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS new FROM events GROUP BY 1) SELECT user_id, round(new - ref, 4) + 0.0 AS drift FROM s")
def join_ref_window(spark: SparkSession, sf: str) -> DataFrame:
    e = _ev(spark, sf).select("user_id", "value", (F.date_format("ts", "yyyy-MM-dd") >= "2024-01-15").alias("new"))
    mean = lambda c, n: e.where(c).groupBy("user_id").agg(F.avg("value").alias(n))
    return mean(~F.col("new"), "ref").join(mean(F.col("new"), "now"), "user_id", "full_outer").select("user_id", (r(F.expr("now - ref")) + 0.0).alias("drift"))


@query("join_context", "WITH b AS (SELECT event_type, (user_id % 4) AS bin, avg(value) AS m, stddev_samp(value) AS s FROM events WHERE event_id % 2 = 0 GROUP BY ALL) SELECT event_id, round((value - m) / s, 5) + 0.0 AS z FROM events e JOIN b ON b.event_type = e.event_type AND b.bin = e.user_id % 4 WHERE event_id % 2 = 1")
def join_context(spark: SparkSession, sf: str) -> DataFrame:
    e = _ev(spark, sf).select("event_id", "event_type", (F.col("user_id") % 4).alias("bin"), "value")
    b = e.where("event_id % 2 = 0").groupBy("event_type", "bin").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return e.where("event_id % 2 = 1").join(b, ["event_type", "bin"]).select("event_id", (r(F.expr("(value - m) / s"), 5) + 0.0).alias("z"))


@query("spm_regime", "SELECT event_type, least(floor(user_id / 40.0), 3)::INT AS bin, count(*) AS n, round(avg(value), 4) AS m, round(quantile_cont(value, 0.9), 4) AS q90 FROM events GROUP BY ALL")
def spm_regime(spark: SparkSession, sf: str) -> DataFrame:
    return _ev(spark, sf).groupBy("event_type", F.least(F.floor(F.col("user_id") / 40), F.lit(3)).cast("int").alias("bin")).agg(F.count("*").alias("n"), r(F.avg("value")).alias("m"), r(F.percentile("value", F.lit(0.9))).alias("q90"))


_M1 = "SELECT event_type, event_id % 2 AS side, avg(value) AS m, stddev_pop(value) AS s, median(value) AS med FROM events GROUP BY ALL"


@query("spm_shape_class", f"WITH m AS ({_M1}), a AS (SELECT * FROM m WHERE side = 0), b AS (SELECT * FROM m WHERE side = 1) SELECT event_type, abs(a.m - b.m) > 0.1 * a.s AS location, abs(a.s / b.s - 1) > 0.05 AS spread, abs((a.m - a.med) - (b.m - b.med)) > 0.05 * a.s AS asymmetry FROM a JOIN b USING (event_type)")
def spm_shape_class(spark: SparkSession, sf: str) -> DataFrame:
    """Which moments of new and reference values differ; multimodality has no test in the source."""
    e = _ev(spark, sf).withColumn("side", F.col("event_id") % 2)
    m = e.groupBy("event_type").pivot("side", [0, 1]).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.median("value").alias("med"))
    return m.select("event_type", F.expr("abs(`0_m` - `1_m`) > 0.1 * `0_s`").alias("location"), F.expr("abs(`0_s` / `1_s` - 1) > 0.05").alias("spread"), F.expr("abs((`0_m` - `0_med`) - (`1_m` - `1_med`)) > 0.05 * `0_s`").alias("asymmetry"))


_EDGE = "SELECT user_id % 20 AS i, event_id % 20 AS j, avg(value) / 100 AS dist FROM events WHERE user_id % 20 <> event_id % 20 GROUP BY ALL"


def _edge(spark: SparkSession, sf: str) -> DataFrame:
    return _ev(spark, sf).where("user_id % 20 <> event_id % 20").groupBy(F.expr("user_id % 20").alias("i"), F.expr("event_id % 20").alias("j")).agg((F.avg("value") / 100).alias("dist"))


@query("spm_alarm_score", f"SELECT v, round(sum(dist), 4) AS score FROM (SELECT unnest([i, j]) AS v, dist FROM ({_EDGE})) GROUP BY 1")
def spm_alarm_score(spark: SparkSession, sf: str) -> DataFrame:
    return _edge(spark, sf).select(F.explode(F.array("i", "j")).alias("v"), "dist").groupBy("v").agg(r(F.sum("dist")).alias("score"))


@query("spm_global_alarm", f"SELECT i, round(max(dist), 4) AS worst, round(sum(dist), 4) AS total, count(*) FILTER (dist > 1) AS over FROM ({_EDGE}) GROUP BY 1 HAVING max(dist) > 1")
def spm_global_alarm(spark: SparkSession, sf: str) -> DataFrame:
    g = _edge(spark, sf).groupBy("i").agg(F.max("dist").alias("w"), r(F.sum("dist")).alias("total"), F.count_if(F.col("dist") > 1).alias("over"))
    return g.where("w > 1").select("i", r("w").alias("worst"), "total", "over")


@query("spm_protected_update")
def spm_protected_update(spark: SparkSession, sf: str) -> DataFrame:
    """References that only in-control values move, in each user's time order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        got = M.protected_update(pdf["value"].tolist(), 100.0, 60.0, 0.1)
        return pd.DataFrame({"event_id": pdf["event_id"], "dist": [g[0] for g in got], "reference": [g[1] for g in got], "updated": [g[2] for g in got]})

    return _ev(spark, sf).select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandas(run, "event_id long, dist double, reference double, updated boolean")


@query("spm_dual_ref", f"SELECT event_id, round(avg(value) {_W.format(frame='ROWS 4 PRECEDING')} - avg(value) {_W.format(frame='ROWS 49 PRECEDING')}, 7) + 0.0 AS gap FROM events")
def spm_dual_ref(spark: SparkSession, sf: str) -> DataFrame:
    return _ev(spark, sf).select("event_id", (r(F.avg("value").over(_BY((-4, 0))) - F.avg("value").over(_BY((-49, 0))), 7) + 0.0).alias("gap"))


@query("spm_ridge_cusum")
def spm_ridge_cusum(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge residuals of each of five variables on the others and on all of the day before, two-sided CUSUMs, an alarm if any of the five is out."""
    return M.ridge_cusum(_wide(spark, sf), "u", "d", _X).select("u", "d", r("worst").alias("worst"), "alarm")


_OFF = [(i, j) for i in range(5) for j in range(i + 1, 5)]
_DRIFT = (
    f"WITH w AS (SELECT *, (row_number() OVER (ORDER BY d, u) - 1) // 100 AS block FROM ({_WIDE})), k AS (SELECT block, " + ", ".join(f"rank() OVER (PARTITION BY block ORDER BY {x}) + (count(*) OVER (PARTITION BY block, {x}) - 1) / 2.0::DOUBLE AS {x}" for x in _X) + " FROM w), "
    "v AS (SELECT block, " + ", ".join(f"CASE WHEN min({_X[i]}) < max({_X[i]}) AND min({_X[j]}) < max({_X[j]}) THEN corr({_X[i]}, {_X[j]}) ELSE 0 END AS c{i}_{j}" for i, j in _OFF) + " FROM k GROUP BY block HAVING count(*) = 100), "
    "m AS (SELECT " + ", ".join(f"avg(c{i}_{j}) AS m{i}_{j}" for i, j in _OFF) + " FROM v), "
    "d AS (SELECT block, sqrt(" + " + ".join(f"2 * pow(c{i}_{j} - m{i}_{j}, 2)" for i, j in _OFF) + ") AS dist FROM v, m), "
    "s AS (SELECT block, dist, sum(dist - 0.4) OVER o AS t FROM d WINDOW o AS (ORDER BY block ROWS UNBOUNDED PRECEDING)) "
    "SELECT block, round(dist, 4) AS dist, round(t - least(0, min(t) OVER (ORDER BY block ROWS UNBOUNDED PRECEDING)), 4) + 0.0::DOUBLE AS c_up FROM s"
)


@query("spm_structure_drift", _DRIFT)
def spm_structure_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of 100 user days in order: how far their rank correlations are from the mean block's, and a CUSUM over blocks."""
    blocks = structure.block_structure(_wide(spark, sf), ["d", "u"], _X, 100)
    return structure.drift(blocks, len(_OFF), 0.4).select("block", r("rank_dist").alias("dist"), (r("c_up") + 0.0).alias("c_up"))


@query("spm_fdp_cusum")
def spm_fdp_cusum(spark: SparkSession, sf: str) -> DataFrame:
    """Projection on the Fisher direction of a class shifted by 0.3 sigma, then a CUSUM."""
    w, _, cov = _two(spark, sf)
    delta = 0.3 * np.sqrt(np.diag(cov))
    g = np.linalg.solve(cov, delta)
    g = g / np.sqrt(g @ cov @ g)
    p = w.select("u", "d", V.dot(F.col("dev"), F.array(*[F.lit(float(x)) for x in g])).alias("z"))
    return M.cusum(p, "u", ["d"], "z", 0.25).select("u", "d", r("z").alias("z"), r("c_up").alias("c_up"))


@query("spm_conformal_ens")
def spm_conformal_ens(spark: SparkSession, sf: str) -> DataFrame:
    """Four scores of each user's days against reference days, conformal p-values, Fisher's combination and its EWMA."""
    days = _wide(spark, sf)
    kind = F.pmod(F.xxhash64("u", "d"), F.lit(4))
    found = ensemble.conformal(days, ["u", "d"], _X, kind == 0, kind == 1)
    done = ensemble.monitored(found, "u", ["d"])
    return done.select("u", "d", *[r(f"p_{s}", 6).alias(f"p_{s}") for s in ensemble.SCORES], r("fisher").alias("fisher"), r("ewma").alias("ewma"))


_SG = f"(SELECT event_id, (-3 * coalesce(lag(value, 2) {_W.format(frame='')}, value) + 12 * coalesce(lag(value) {_W.format(frame='')}, value) + 17 * value + 12 * coalesce(lead(value) {_W.format(frame='')}, value) - 3 * coalesce(lead(value, 2) {_W.format(frame='')}, value)) / 35 AS sg, lag(value) {_W.format(frame='')} AS lag1 FROM events)"
_KALMAN = """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
k AS (SELECT user_id, event_id, i, 100 + 404.0::DOUBLE / 504 * (value - 100) AS x, 404.0::DOUBLE * 100 / 504 AS p FROM o WHERE i = 1
      UNION ALL SELECT o.user_id, o.event_id, o.i, k.x + (k.p + 4) / (k.p + 104) * (o.value - k.x), (k.p + 4) * 100 / (k.p + 104) FROM k JOIN o ON o.user_id = k.user_id AND o.i = k.i + 1)"""


@query("spm_filters", f"{_KALMAN} SELECT event_id, round(sg, 4) AS sg, lag1, round(x, 4) AS level, round(p, 4) AS var FROM k JOIN {_SG} USING (event_id)")
def spm_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Savitzky-Golay of five points (the value itself beyond the ends), the lag columns of dynamic PCA, and a scalar Kalman filter of each user's level."""
    at = lambda k: F.coalesce((F.lag if k > 0 else F.lead)("value", abs(k)).over(_BY()), F.col("value"))
    sg = (-3 * at(2) + 12 * at(1) + 17 * F.col("value") + 12 * at(-1) - 3 * at(-2)) / 35
    smooth = _ev(spark, sf).select("event_id", r(sg).alias("sg"), F.lag("value").over(_BY()).alias("lag1"))
    level = scan.kalman(_ev(spark, sf).select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value", q=4.0, r=100.0, start=100.0, start_var=400.0)
    return smooth.join(level.select("event_id", r("level").alias("level"), r("var").alias("var")), "event_id")


# streams: polls and logs run as streams to their end, windows by their batch twins; tests hold the streams against these
@query("src_metric_poll", "SELECT time_bucket(INTERVAL '10 seconds', ts) AS start, count(*) AS n, round(avg(value), 4) AS m FROM events GROUP BY 1")
def src_metric_poll(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics polled as a stream of files into a table, up to what is there now, and summed by interval."""
    from loomwork.streaming import charts

    polled, schema = sinks.scratch_path(spark, "polled"), _ev(spark, sf).schema
    found = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").select("ts", "value")  # a stream takes one file by a pattern only
    found.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{polled}-state").format("parquet").start(polled).awaitTermination()
    return charts.tumbling(spark.read.schema(found.schema).parquet(polled), "10 seconds")


@query("stm_poll_window", "SELECT time_bucket(INTERVAL '10 seconds', ts) AS start, count(*) AS n, round(avg(value), 4) AS m FROM events GROUP BY 1")
def stm_poll_window(spark: SparkSession, sf: str) -> DataFrame:
    from loomwork.streaming import charts

    return charts.tumbling(_ev(spark, sf), "10 seconds")


_SES = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"


@query("stm_debounce", _SES)
def stm_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts end when nothing changes for a while (six hours at this table's pace)."""
    from loomwork.streaming import charts

    return charts.bursts(_ev(spark, sf), "6 hours")


_SLIDE = """WITH o AS (SELECT user_id, event_id, value, row_number() OVER w AS i, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT user_id, avg(value) AS ref FROM o WHERE i <= 20 GROUP BY 1)
SELECT user_id, event_id, round(m, 6) AS m, round(m - ref, 6) + 0.0 AS gap FROM o JOIN f USING (user_id) WHERE i >= 30 AND (i - 30) % 5 = 0"""


@query("stm_slide_monitor", _SLIDE)
def stm_slide_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """Each sliding window of ten values less the user's reference, the first twenty: what the stream streaming.state.monitor_stream emits."""
    o = _ev(spark, sf).select("user_id", "event_id", "value", F.row_number().over(_BY()).alias("i"), F.avg("value").over(_BY((-9, 0))).alias("m"))
    ref = o.where("i <= 20").groupBy("user_id").agg(F.avg("value").alias("ref"))
    return o.where("i >= 30 AND (i - 30) % 5 = 0").join(ref, "user_id").select("user_id", "event_id", r("m", 6).alias("m"), (r(F.expr("m - ref"), 6) + 0.0).alias("gap"))


_LAST_CU = f"""s AS (SELECT user_id, ts, event_id, sum((value - 100) / 50 - 0.25) {_W.format(frame='')} AS u, sum((value - 100) / 50 + 0.25) {_W.format(frame='')} AS d FROM events),
cu AS (SELECT user_id, ts, event_id, u - least(0, min(u) {_W.format(frame='')}) AS c_up, d - greatest(0, max(d) {_W.format(frame='')}) AS c_dn FROM s),
l AS (SELECT user_id, round(arg_max(c_up, (ts, event_id)), 4) + 0.0 AS c_up, round(arg_max(c_dn, (ts, event_id)), 4) + 0.0 AS c_dn FROM cu GROUP BY 1)"""


@query("stm_ewma_cusum", _EWMA.replace(" SELECT event_id, round(z, 4) AS z FROM z", f", {_LAST_CU}, e AS (SELECT user_id, round(arg_max(z, i), 4) AS z, count(*) AS n FROM z GROUP BY 1) SELECT user_id, z, c_up, c_dn, n FROM e JOIN l USING (user_id)"))
def stm_ewma_cusum(spark: SparkSession, sf: str) -> DataFrame:
    """The charts' last state for each key: what the stateful stream (streaming.charts.chart_stream) holds after all events."""
    last = lambda c: r(F.max_by(c, F.struct("ts", "event_id")))
    z = M.ewma(_ev(spark, sf), "user_id", ["ts", "event_id"], "value", 0.2, 100.0)
    z = z.groupBy("user_id").agg(last("z").alias("z"), F.count("*").alias("n"))
    c = _cusum(spark, sf).groupBy("user_id").agg((last("c_up") + 0.0).alias("c_up"), (last("c_dn") + 0.0).alias("c_dn"))
    return z.join(c, "user_id").select("user_id", "z", "c_up", "c_dn", "n")


@query("src_log_glob", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def src_log_glob(spark: SparkSession, sf: str) -> DataFrame:
    """Log files in folders, found by a glob and read as a stream up to their end."""
    logs, lines = sinks.scratch_path(spark, "logs"), sinks.scratch_path(spark, "lines")
    _ev(spark, sf).select(F.col("event_type").alias("value"), F.expr("event_id % 3").alias("host")).write.partitionBy("host").text(logs)
    found = tail_logs(spark, f"{logs}/host=*/part-*").select("value")
    found.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{lines}-state").format("parquet").start(lines).awaitTermination()
    return spark.read.schema("value string").parquet(lines).groupBy(F.col("value").alias("event_type")).agg(F.count("*").alias("n"))
