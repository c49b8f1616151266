"""Projection, filters, joins, aggregates, windows, order, sets and reshaping over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import relational as R
from loomwork.registry import query
from loomwork.sources.tables import FILES_SQL, files, table

r = lambda c, n=4: F.round(c, n)


@query("prj_loc", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def prj_loc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")


@query("prj_iloc", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey BETWEEN 10 AND 19")
def prj_iloc(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.where(F.col(c.columns[0]).between(10, 19)).select(c.columns[0], c.columns[3])


@query("prj_drop", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey <> 3")
def prj_drop(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").drop("c_acctbal").where("c_custkey <> 3")


@query("prj_apply", "SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS l_quantity, l_discount + 1 AS l_discount FROM lineitem")
def prj_apply(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_quantity")).alias("l_quantity"), (F.col("l_discount") + 1).alias("l_discount"))


@query("prj_map", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 2, 5) + 0.0) AS doubled FROM embeddings")
def prj_map(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 2, 5)).alias("doubled"))


@query("flt_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def flt_between(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_totalprice").between(1000, 50000)).select("o_orderkey", "o_totalprice")


@query("flt_pred", "SELECT vec_id, list_transform(list_filter(embedding, lambda x: x > 0.1), lambda x: x::DOUBLE) AS high FROM embeddings WHERE label % 2 = 0")
def flt_pred(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("label % 2 = 0").select("vec_id", F.filter("embedding", lambda x: x > F.lit(0.1).cast("float")).cast("array<double>").alias("high"))


@query("flt_where", "SELECT event_id, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS level FROM events")
def flt_where(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.when(F.col("value") > 100, "high").otherwise("low").alias("level"))


@query("flt_nonempty", "SELECT doc_id FROM documents WHERE length(trim(text)) > 0")
def flt_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.length(F.trim("text")) > 0).select("doc_id")


@query("flt_quant", """SELECT vec_id, len(list_filter(embedding, lambda x: x > -1)) = len(embedding) AS every_, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS some_, list_contains(list_transform(embedding, lambda x: floor(x * 10)), 2) AS includes_,
list_filter(embedding, lambda x: x > 0.2)[1]::DOUBLE AS found, coalesce(list_position(list_transform(embedding, lambda x: x > 0.2), true), 0)::BIGINT - 1 AS found_at FROM embeddings""")
def flt_quant(spark: SparkSession, sf: str) -> DataFrame:
    high = lambda v: lambda x: x > F.lit(v).cast("float")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.forall("embedding", lambda x: x > -1).alias("every_"), F.exists("embedding", high(0.3)).alias("some_"), F.array_contains(F.transform("embedding", lambda x: F.floor(x * 10)), 2).alias("includes_"),
        F.get(F.filter("embedding", high(0.2)), 0).cast("double").alias("found"), (F.array_position(F.transform("embedding", high(0.2)), True) - 1).alias("found_at"),
    )


@query("flt_control_limit", "SELECT event_id, value FROM events WHERE value > 200")
def flt_control_limit(spark: SparkSession, sf: str) -> DataFrame:
    """A NaN limit flags nothing, as values above it are below NaN in Spark's order."""
    return table(spark, sf, "events").where(F.col("value") > F.lit(200.0)).select("event_id", "value")


@query("flt_shewhart", "SELECT event_id, value FROM events, (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events) WHERE abs(value - mu) > 3 * sd")
def flt_shewhart(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    stats = e.agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    return e.join(F.broadcast(stats)).where("abs(value - mu) > 3 * sd").select("event_id", "value")  # stats is one row


@query("flt_noise_components", "SELECT p_partkey, p_name FROM part WHERE p_type NOT IN ('PROMO', 'STANDARD') AND p_size > 5")
def flt_noise_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components whose role is business: cross-cutting and boilerplate types go."""
    return table(spark, sf, "part").where(~F.col("p_type").isin("PROMO", "STANDARD") & (F.col("p_size") > 5)).select("p_partkey", "p_name")


_C = "SELECT c_custkey AS key, c_nationkey AS grp, c_acctbal AS v FROM customer"
_O = "SELECT o_custkey AS key, max(o_totalprice) AS v FROM orders GROUP BY 1"
# every second customer under another key: rows of both sides find no partner
_MOVED = "SELECT c_custkey + CASE WHEN c_custkey % 2 = 1 THEN 1000000000 ELSE 0 END AS key, c_nationkey AS grp, c_acctbal AS v FROM customer"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("v"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("v"))
    return c, o


@query("join_inner", f"SELECT key, grp, c.v AS v_x, o.v AS v_y FROM ({_C}) c JOIN ({_O}) o USING (key)")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return R.merge(*_sides(spark, sf), "key")


@query("join_outer", f"SELECT key, grp, c.v AS v_x, o.v AS v_y FROM ({_MOVED}) c FULL JOIN ({_O}) o USING (key)")
def join_outer(spark: SparkSession, sf: str) -> DataFrame:
    c, o = _sides(spark, sf)
    return R.merge(c.withColumn("key", F.expr("key + CASE WHEN key % 2 = 1 THEN 1000000000 ELSE 0 END")), o, "key", "full_outer")


@query("join_params", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_params(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "c_name", "n_name")


@query("join_tag_override", "SELECT p_partkey, coalesce(o.tag, p_type) AS tag FROM part LEFT JOIN (SELECT s_suppkey AS k, 'human' AS tag FROM supplier) o ON p_partkey = k")
def join_tag_override(spark: SparkSession, sf: str) -> DataFrame:
    human = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.lit("human").alias("tag"))
    return table(spark, sf, "part").join(human, "p_partkey", "left").select("p_partkey", F.coalesce("tag", "p_type").alias("tag"))


@query("join_semi_orphans", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def join_semi_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Components that no assignment names: documents without a label."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "source")


# aggregation
@query("agg_group_sum", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def agg_group_sum(spark: SparkSession, sf: str) -> DataFrame:
    return R.group_agg(table(spark, sf, "lineitem"), "l_returnflag", r(F.sum("l_extendedprice"), 2).alias("total"), F.sum("l_quantity").alias("qty"))


@query("agg_group_mean", "SELECT l_linestatus, round(avg(l_discount), 6) AS mean FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1")
def agg_group_mean(spark: SparkSession, sf: str) -> DataFrame:
    return R.group_agg(table(spark, sf, "lineitem"), "l_linestatus", r(F.avg("l_discount"), 6).alias("mean"))


@query("agg_group_by_expr", "SELECT left(p_name, 1) AS letter, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY 1")
def agg_group_by_expr(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.left("p_name", F.lit(1)).alias("letter")).agg(F.sort_array(F.collect_set("p_name")).alias("names"))


for _name, _f in (("mean", "avg"), ("max", "max"), ("min", "min")):
    query(f"agg_{_name}", f"SELECT round({_f}(l_quantity), 6) AS quantity, round({_f}(l_tax), 6) + 0.0 AS tax FROM lineitem")(
        lambda spark, sf, f=_f: table(spark, sf, "lineitem").agg(r(getattr(F, f)("l_quantity"), 6).alias("quantity"), (r(getattr(F, f)("l_tax"), 6) + 0.0).alias("tax"))
    )
for _name, _f in (("std_pop", "stddev_pop"), ("var_pop", "var_pop")):
    query(f"agg_{_name}", f"SELECT l_returnflag, round({_f}(l_quantity), 5) AS spread FROM lineitem GROUP BY 1")(
        lambda spark, sf, f=_f: table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r(getattr(F, f)("l_quantity"), 5).alias("spread"))
    )


@query("agg_describe", "SELECT count(o_totalprice)::DOUBLE AS count, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, max(o_totalprice) AS max FROM orders")
def agg_describe(spark: SparkSession, sf: str) -> DataFrame:
    d = R.describe(table(spark, sf, "orders"), "o_totalprice")
    return d.withColumns({"mean": r("mean", 3), "std": r("std", 3)} | {c: r(c) for c in ("p25", "p50", "p75")})


@query("agg_info", "SELECT 'event_id' AS name, count(event_id) AS non_null, 'bigint' AS dtype FROM events UNION ALL SELECT 'ts', count(ts), 'timestamp' FROM events UNION ALL SELECT 'user_id', count(user_id), 'bigint' FROM events UNION ALL SELECT 'event_type', count(event_type), 'string' FROM events UNION ALL SELECT 'value', count(value), 'double' FROM events UNION ALL SELECT 'props', count(props), 'string' FROM events")
def agg_info(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    one = e.agg(*[F.count(c).alias(c) for c in e.columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("non_null"), F.lit(kind.replace("timestamp_ntz", "timestamp")).alias("dtype")) for c, kind in e.dtypes])))


_PIVOT = "SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'All' ELSE l_returnflag END AS l_returnflag, coalesce(round({f}(l_quantity) FILTER (l_linestatus = 'F'), 4), 0) AS \"F\", coalesce(round({f}(l_quantity) FILTER (l_linestatus = 'O'), 4), 0) AS \"O\", round({f}(l_quantity), 4) AS \"All\" FROM lineitem GROUP BY ROLLUP (l_returnflag)"


@query("agg_pivot_sum", _PIVOT.format(f="sum"))
def agg_pivot_sum(spark: SparkSession, sf: str) -> DataFrame:
    return R.pivot_table(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity", lambda x: r(F.sum(x)), 0.0, "All")


@query("agg_pivot_mean", _PIVOT.format(f="avg"))
def agg_pivot_mean(spark: SparkSession, sf: str) -> DataFrame:
    return R.pivot_table(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity", lambda x: r(F.avg(x)), 0.0, "All")


@query("agg_reduce", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def agg_reduce(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", r(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("agg_median", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1")
def agg_median(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(r(F.median("value"), 6).alias("median"))


@query("agg_mode", "SELECT event_type, first(u ORDER BY n DESC, u) AS mode FROM (SELECT event_type, user_id AS u, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def agg_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Of equally frequent values the lowest."""
    n = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.max_by("user_id", F.struct("n", -F.col("user_id"))).alias("mode"))



@query("agg_moments", "SELECT event_type, round(avg(pow(value - mu, 3)) / pow(var_pop(value), 1.5), 5) AS skew, round(avg(pow(value - mu, 4)) / pow(var_pop(value), 2) - 3, 5) AS kurt, round(var_samp(value), 4) AS var FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS mu FROM events) GROUP BY 1")
def agg_moments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(r(F.skewness("value"), 5).alias("skew"), r(F.kurtosis("value"), 5).alias("kurt"), r(F.var_samp("value")).alias("var"))


@query("agg_corr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS rho FROM lineitem GROUP BY 1")
def agg_corr(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r(F.corr("l_quantity", "l_extendedprice"), 6).alias("rho"))


@query("agg_cov", "SELECT round(var_samp(l_quantity), 4) AS qq, round(covar_samp(l_quantity, l_discount), 6) AS qd, round(covar_samp(l_quantity, l_tax), 6) AS qt, round(var_samp(l_discount), 8) AS dd, round(covar_samp(l_discount, l_tax), 8) AS dt, round(var_samp(l_tax), 8) AS tt FROM lineitem")
def agg_cov(spark: SparkSession, sf: str) -> DataFrame:
    q, d, t = "l_quantity", "l_discount", "l_tax"
    pairs = {"qq": (q, q, 4), "qd": (q, d, 6), "qt": (q, t, 6), "dd": (d, d, 8), "dt": (d, t, 8), "tt": (t, t, 8)}
    return table(spark, sf, "lineitem").agg(*[r(F.covar_samp(a, b), n).alias(k) for k, (a, b, n) in pairs.items()])


@query("agg_occurrences", "SELECT doc_id, ((strlen(text) - strlen(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents")
def agg_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences that don't overlap."""
    cut = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("the"), F.lit("")))
    return table(spark, sf, "documents").select("doc_id", (cut / 3).cast("long").alias("n"))


@query("agg_distinct_threshold", "SELECT l_suppkey, count(DISTINCT l_returnflag) AS n1, count(DISTINCT l_linenumber) AS n2 FROM lineitem GROUP BY 1 HAVING n1 > 2 OR n2 > 6")
def agg_distinct_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_returnflag").alias("n1"), F.count_distinct("l_linenumber").alias("n2")).where("n1 > 2 or n2 > 6")


@query("agg_vocab_stats", "WITH t AS (SELECT event_type AS term, user_id % 7 AS run, count(*) AS n FROM events GROUP BY ALL) SELECT run, count(*) FILTER (n > 20) AS created, count(*) FILTER (n <= 20) AS reused, count(*) FILTER (n < 10) AS low_confidence FROM t GROUP BY run")
def agg_vocab_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("term"), F.expr("user_id % 7").alias("run")).agg(F.count("*").alias("n"))
    return t.groupBy("run").agg(F.count_if(F.col("n") > 20).alias("created"), F.count_if(F.col("n") <= 20).alias("reused"), F.count_if(F.col("n") < 10).alias("low_confidence"))


@query("agg_perplexity", "SELECT user_id, round(avg(value / 50), 6) AS loss, round(exp(least(avg(value / 50), 20)), 4) AS perplexity FROM events GROUP BY 1")
def agg_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    loss = F.avg(F.col("value") / 50)
    return table(spark, sf, "events").groupBy("user_id").agg(r(loss, 6).alias("loss"), r(F.exp(F.least(loss, F.lit(20.0)))).alias("perplexity"))


@query("agg_class_metrics", """WITH s AS (SELECT quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p, n_chars AS score FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM s),
k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s),
a AS (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM k)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(auc, 6) AS auc FROM c, a""")
def agg_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The ranks behind the AUC come from counts of each score, so no window spans the table."""
    s = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 800).cast("int").alias("p"), F.col("n_chars").alias("score"))
    by = s.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"))
    below = F.sum("neg").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    c = by.withColumn("below", F.coalesce(below, F.lit(0))).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), (F.sum("pos") - F.sum("tp")).alias("fn"), (F.sum("neg") - F.sum("fp")).alias("tn"), (F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return c.select("tp", "fp", "fn", "tn", r(F.expr("(tp + tn) / (tp + fp + fn + tn)"), 6).alias("accuracy"), r(F.expr("tp / (tp + fp)"), 6).alias("precision"), r(F.expr("tp / (tp + fn)"), 6).alias("recall"), r(F.expr("2 * tp / (2 * tp + fp + fn)"), 6).alias("f1"), r("auc", 6).alias("auc"))


@query("agg_detection_metrics", """WITH e AS (SELECT user_id AS run, event_id AS t, value > 150 AS alarm, event_type = 'error' AS fault FROM events)
SELECT run, round(count(*) FILTER (fault AND alarm) / nullif(count(*) FILTER (fault), 0), 6) AS fdr, round(count(*) FILTER (NOT fault AND alarm) / nullif(count(*) FILTER (NOT fault), 0), 6) AS far, min(t) FILTER (alarm) - min(t) FILTER (fault) AS delay FROM e GROUP BY run""")
def agg_detection_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("t"), (F.col("value") > 150).alias("alarm"), (F.col("event_type") == "error").alias("fault"))
    share = lambda x, y: r(F.count_if(x) / F.nullif(F.count_if(y), F.lit(0)), 6)
    fault, alarm = F.col("fault"), F.col("alarm")
    return e.groupBy("run").agg(share(fault & alarm, fault).alias("fdr"), share(~fault & alarm, ~fault).alias("far"), (F.min(F.when(alarm, F.col("t"))) - F.min(F.when(fault, F.col("t")))).alias("delay"))


@query("agg_hist", "SELECT least(floor((value - lo) / (hi - lo) * 20) + 1, 20)::INT AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def agg_hist(spark: SparkSession, sf: str) -> DataFrame:
    return R.histogram(table(spark, sf, "events"), "value", 20)


@query("agg_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def agg_regression(spark: SparkSession, sf: str) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r(F.regr_slope(y, x), 3).alias("slope"), r(F.regr_intercept(y, x), 1).alias("intercept"), r(F.regr_r2(y, x), 6).alias("r2"))


def _weight_sql(b: int) -> str:
    """The Poisson weight of a row in a replicate: how many steps of the distribution function its 16 bits reach."""
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        steps.append(str(round(total * 65536)))
        term /= k + 1
    u = f"('0x' || substr(md5(concat(event_id, ':{b // 8}')), {1 + 4 * (b % 8)}, 4))::BIGINT"
    return f"len(list_filter([{', '.join(steps)}], lambda x: {u} >= x))"


_BOOT = ", ".join(f"sum({_weight_sql(b)} * value) / sum({_weight_sql(b)})" for b in range(16))


@query("agg_inference", f"""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), t AS (SELECT sum(n) AS nn, sum(n * m) / sum(n) AS mm, count(*) AS k, sum((n - 1) * v) AS within FROM g),
b AS (SELECT sum(n * pow(m - mm, 2)) AS between_ FROM g, t), bt AS (SELECT event_type, unnest([{_BOOT}]) AS mean FROM events GROUP BY 1), bs AS (SELECT event_type, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM bt GROUP BY 1),
c AS (SELECT event_type, user_id % 7 AS u, count(*)::DOUBLE AS n FROM events GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY event_type) * sum(n) OVER (PARTITION BY u) / sum(n) OVER () AS x FROM c), h AS (SELECT sum(pow(n - x, 2) / x) AS chi2, (count(DISTINCT event_type) - 1) * (count(DISTINCT u) - 1) AS dof FROM e)
SELECT event_type, round((m - mm) / sqrt(v / n), 5) AS t, round(m - 1.96 * sqrt(v / n), 4) AS ci_low, round(m + 1.96 * sqrt(v / n), 4) AS ci_high, round((between_ / (k - 1)) / (within / (nn - k)), 5) AS f, round(lo, 4) AS boot_low, round(hi, 4) AS boot_high, round(chi2, 5) AS chi2, dof FROM g JOIN bs USING (event_type), t, b, h""")
def agg_inference(spark: SparkSession, sf: str) -> DataFrame:
    """t against the overall mean, a 95 % interval by the normal and by a Poisson bootstrap, the F of a one-way analysis, chi-square of type and user group; no p-values."""
    e = table(spark, sf, "events")
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    t = g.agg(F.sum("n").alias("nn"), F.expr("sum(n * m) / sum(n)").alias("mm"), F.count("*").alias("k"), F.expr("sum((n - 1) * v)").alias("within"), F.expr("sum(n * m * m)").alias("sq"))
    h = R.chi_square(e.withColumn("u", F.expr("user_id % 7")), "event_type", "u").select("chi2", "dof")
    boot = R.bootstrap_means(e, ["event_type"], "event_id", "value", 16).groupBy("event_type").agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))
    j = g.join(boot, "event_type").join(F.broadcast(t)).join(F.broadcast(h))  # one row each
    se = F.sqrt(F.expr("v / n"))
    kept = [r(F.col("lo")).alias("boot_low"), r(F.col("hi")).alias("boot_high"), r(F.col("chi2"), 5).alias("chi2"), "dof"]
    return j.select("event_type", r((F.col("m") - F.col("mm")) / se, 5).alias("t"), r(F.col("m") - 1.96 * se).alias("ci_low"), r(F.col("m") + 1.96 * se).alias("ci_high"), r(F.expr("((sq - nn * mm * mm) / (k - 1)) / (within / (nn - k))"), 5).alias("f"), *kept)


@query("agg_clean_prep", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS scaled FROM orders, q WHERE o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def agg_clean_prep(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values and outliers beyond 1.5 interquartile ranges go, the rest is scaled to 0..1."""
    o = table(spark, sf, "orders").na.drop(subset=["o_totalprice"])
    q = o.agg(F.percentile("o_totalprice", F.lit(0.25)).alias("a"), F.percentile("o_totalprice", F.lit(0.75)).alias("b"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    j = o.join(F.broadcast(q)).where("o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")  # one row
    return j.select("o_orderkey", r(F.expr("(o_totalprice - lo) / (hi - lo)"), 6).alias("scaled"))


# sort, limit, top-k
@query("ord_sort", "SELECT vec_id, list_transform(list_sort(embedding), lambda x: x::DOUBLE) AS sorted FROM embeddings")
def ord_sort(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.array_sort("embedding").cast("array<double>").alias("sorted"))


@query("ord_reverse", "SELECT vec_id, list_transform(list_reverse(embedding), lambda x: x::DOUBLE) AS reversed FROM embeddings")
def ord_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.reverse("embedding").cast("array<double>").alias("reversed"))


@query("ord_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def ord_head(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@query("ord_tail", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def ord_tail(spark: SparkSession, sf: str) -> DataFrame:
    return R.tail(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("ord_match_cap", "WITH m AS (SELECT doc_id FROM documents WHERE text LIKE '%the%' ORDER BY doc_id LIMIT 500) SELECT count(*) AS n, count(*) >= 500 AS truncated, max(doc_id) AS last FROM m")
def ord_match_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The flag is set at exactly 500 matches too, as in the reference."""
    m = table(spark, sf, "documents").where(F.col("text").contains("the")).select("doc_id").orderBy("doc_id").limit(500)
    return m.agg(F.count("*").alias("n"), (F.count("*") >= 500).alias("truncated"), F.max("doc_id").alias("last"))


@query("ord_topk_prob", """WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rk FROM p)
SELECT user_id, event_type, rk::INT AS rank, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS p FROM k WHERE rk <= 3""")
def ord_topk_prob(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    k = R.top_by_group(p, ["user_id"], [F.desc("n"), F.col("event_type")], 3)
    return k.select("user_id", "event_type", "rank", r(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6).alias("p"))


@query("ord_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS at FROM embeddings")
def ord_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("at"))


# sets
@query("set_concat_rows", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def set_concat_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("set_concat_cols", "SELECT c_custkey AS at, c_name AS name, p_name AS name_2 FROM customer FULL JOIN part ON c_custkey = p_partkey WHERE c_custkey IS NOT NULL")
def set_concat_cols(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("at"), F.col("c_name").alias("name"))
    return c.join(table(spark, sf, "part").select(F.col("p_partkey").alias("at"), F.col("p_name").alias("name_2")), "at", "left")


@query("set_hstack", "SELECT vec_id, len(embedding || embedding)::INT AS n, (embedding || [label::FLOAT])[65]::DOUBLE AS last FROM embeddings")
def set_hstack(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.size(F.concat("embedding", "embedding")).alias("n"), F.get(F.concat("embedding", F.array(F.col("label").cast("float"))), 64).cast("double").alias("last"))


@query("set_js_concat", "SELECT l_orderkey, list_sort(list(l_linenumber)) || list_sort(list(l_partkey))::BIGINT[] AS both FROM lineitem GROUP BY 1")
def set_js_concat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat(F.sort_array(F.collect_list(F.col("l_linenumber").cast("long"))), F.sort_array(F.collect_list("l_partkey"))).alias("both"))


@query("set_merge_pool", "SELECT 'parent' AS gen, s_suppkey AS id FROM supplier UNION ALL SELECT 'child', s_suppkey + 100000 FROM supplier")
def set_merge_pool(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.lit("parent").alias("gen"), F.col("s_suppkey").alias("id")).unionAll(s.select(F.lit("child"), F.col("s_suppkey") + 100000))


# all documents are on both sides, some of them under a path of one side only
_PATHS = {"left": "doc_id + CASE WHEN doc_id % 4 = 0 THEN 1000000000 ELSE 0 END", "right": "doc_id + CASE WHEN doc_id % 3 = 0 THEN 2000000000 ELSE 0 END"}
_LEFT, _RIGHT = f"SELECT {_PATHS['left']} AS path, n_chars AS size FROM documents", f"SELECT {_PATHS['right']} AS path, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM documents"
for _mode, _act in (("mirror", "delete"), ("update", "keep"), ("two-way", "copy left")):
    _n = {"mirror": "set_sync_mirror", "update": "set_sync_update", "two-way": "set_sync_two_way"}[_mode]

    def _sync(spark: SparkSession, sf: str, mode: str = _mode) -> DataFrame:
        d = table(spark, sf, "documents")
        left = d.select(F.expr(_PATHS["left"]).alias("path"), F.col("n_chars").alias("size"))
        right = d.select(F.expr(_PATHS["right"]).alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"))
        return R.sync_plan(left, right, "path", "size", mode)

    query(_n, f"SELECT path, CASE WHEN r.size IS NULL THEN 'copy right' WHEN l.size IS NULL THEN '{_act}' WHEN l.size <> r.size THEN 'copy right' ELSE 'keep' END AS action FROM ({_LEFT}) l FULL JOIN ({_RIGHT}) r USING (path)")(_sync)


@query("set_cluster_overlap", "WITH a AS (SELECT l_suppkey % 10 AS a, l_partkey % 8 AS b, count(*) AS n FROM lineitem GROUP BY ALL) SELECT a, b, n, round(n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n), 6) AS jaccard FROM a")
def set_cluster_overlap(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").groupBy(F.expr("l_suppkey % 10").alias("a"), F.expr("l_partkey % 8").alias("b")).agg(F.count("*").alias("n"))
    total = lambda k: F.sum("n").over(Window.partitionBy(k))
    return a.select("a", "b", "n", r(F.col("n") / (total("a") + total("b") - F.col("n")), 6).alias("jaccard"))


# reshaping
_SLOTS = ", ".join(f'max(n_name) FILTER (n_nationkey % 5 = {k}) AS "{k}"' for k in range(5))


@query("rsh_pivot", f"SELECT n_regionkey, {_SLOTS} FROM (SELECT n_regionkey, min(n_nationkey) AS n_nationkey, min_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey, n_nationkey % 5) GROUP BY 1")
def rsh_pivot(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey", F.expr("n_nationkey % 5").alias("slot")).agg(F.min_by("n_name", "n_nationkey").alias("n_name"))
    return R.pivot_unique(n, "n_regionkey", "slot", [0, 1, 2, 3, 4], "n_name")


@query("rsh_melt_vars", "SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS var, unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem")
def rsh_melt_vars(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "var", "x")


_IDS = "list_transform(string_split(left(text, 1000000000), ' '), lambda w: strlen(w)::INT)"


@query("rsh_batch_pad", f"SELECT doc_id, {_IDS}[1:16] || list_transform(range(0, greatest(16 - len({_IDS}), 0)), lambda i: 0) AS ids, least(len({_IDS}), 16)::INT AS n_mask FROM documents")
def rsh_batch_pad(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids cut or padded to 16, and how many are real."""
    d = table(spark, sf, "documents").select("doc_id", F.inline(F.array(F.struct(F.transform(F.split("text", " "), lambda w: F.octet_length(w)).alias("i")))))
    pad = F.array_repeat(F.lit(0), F.greatest(16 - F.size("i"), F.lit(0)))
    return d.select("doc_id", F.concat(F.slice("i", 1, 16), pad).alias("ids"), F.least(F.size("i"), F.lit(16)).alias("n_mask"))


@query("rsh_split_xy", f"SELECT doc_id, list_transform(range(0, len({_IDS}) // 8), lambda i: {_IDS}[i * 8 + 1 : i * 8 + 8]) AS blocks FROM documents")
def rsh_split_xy(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.inline(F.array(F.struct(F.transform(F.split("text", " "), lambda w: F.octet_length(w)).alias("i")))))
    n = F.floor(F.size("i") / 8).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice("i", k * 8 + 1, 8))
    return d.select("doc_id", F.when(n > 0, blocks).otherwise(F.array().cast("array<array<int>>")).alias("blocks"))


@query("rsh_train_test", "SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM documents")
def rsh_train_test(spark: SparkSession, sf: str) -> DataFrame:
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return table(spark, sf, "documents").select("doc_id", F.when(u < 20, "test").otherwise("train").alias("split"))


@query("agg_dir_size", f"WITH f AS ({FILES_SQL}), p AS (SELECT path, size, string_split(path, '/') AS s FROM f), d AS (SELECT DISTINCT array_to_string(s[1:k], '/') AS dir FROM (SELECT s, unnest(range(1, len(s))) AS k FROM p)) SELECT (SELECT sum(size)::BIGINT FROM f) AS bytes, (SELECT count(*) FROM f) AS n_files, (SELECT count(*) FROM d) AS n_dirs")
def agg_dir_size(spark: SparkSession, sf: str) -> DataFrame:
    """Folders are those that files name; empty ones can't be seen."""
    f = files(spark, sf).select("path", "size")
    folders = f.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))).alias("dir"))
    return f.agg(F.sum("size").cast("long").alias("bytes"), F.count("*").alias("n_files")).join(folders.agg(F.count_distinct("dir").alias("n_dirs")))
