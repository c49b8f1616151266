"""Decomposition scores over a call graph that suppliers and parts stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import vectors as V
from loomwork.operators import community as C
from loomwork.operators import graph as G
from loomwork.operators import mojo as J
from loomwork.operators import pareto as P
from loomwork.operators import relational as R
from loomwork.operators import similar as N
from loomwork.registry import query
from loomwork.sources.tables import table

r = lambda c, n=6: F.round(c, n)
_KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'data' ELSE 'event' END"
_E = f"(SELECT l_suppkey % 97 AS src, l_partkey % 89 AS dst, {_KIND} AS kind, count(*) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"
_A = "(SELECT i AS node, i % 9 AS bucket FROM range(0, 97) t(i))"
_EA = f"(SELECT e.*, src % 9 AS bs, dst % 9 AS bd FROM {_E} e)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Typed edges between 97 units, counted."""
    return table(spark, sf, "lineitem").groupBy(F.expr("l_suppkey % 97").alias("src"), F.expr("l_partkey % 89").alias("dst"), F.expr(_KIND).alias("kind")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("w"))


def assignment(spark: SparkSession) -> DataFrame:
    return spark.range(97).select(F.col("id").alias("node"), (F.col("id") % 9).alias("bucket"))


def _ea(spark: SparkSession, sf: str) -> DataFrame:
    return G.assigned(edges(spark, sf), assignment(spark))


@query("join_call_assign", f"SELECT src, dst, kind, n, bs, bd FROM {_EA}")
def join_call_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _ea(spark, sf).select("src", "dst", "kind", "n", "bs", "bd")


_HOP = "(SELECT DISTINCT l_suppkey % 97 AS src, l_partkey % 89 AS dst FROM lineitem)"


@query("gra_closure", f"WITH RECURSIVE h AS (SELECT * FROM {_HOP}), c AS (SELECT i AS seed, i AS node FROM range(0, 97) t(i) UNION SELECT c.seed, h.dst FROM c JOIN h ON h.src = c.node) SELECT seed, node FROM c")
def gra_closure(spark: SparkSession, sf: str) -> DataFrame:
    """The closure of every unit over all edges."""
    hop = table(spark, sf, "lineitem").select(F.expr("l_suppkey % 97").alias("src"), F.expr("l_partkey % 89").alias("dst"))
    return G.closure(hop, spark.range(97).select(F.col("id").alias("node"))).select("seed", "node")


@query("gra_coupling", f"SELECT count(*) FILTER (bs <> bd) AS across, count(*) AS total FROM {_EA}")
def gra_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return _ea(spark, sf).agg(F.count_if(F.col("bs") != F.col("bd")).alias("across"), F.count("*").alias("total"))


_COH = f"SELECT bucket, n, round(CASE WHEN n > 1 THEN coalesce(c, 0) / (n * (n - 1)) ELSE 0 END, 6) AS cohesion FROM (SELECT bucket, count(*) AS n FROM {_A} GROUP BY 1) LEFT JOIN (SELECT bs AS bucket, count(*) AS c FROM (SELECT DISTINCT src, dst, bs, bd FROM {_EA}) WHERE bs = bd AND src <> dst GROUP BY 1) USING (bucket)"


@query("gra_cohesion", _COH)
def gra_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    return G.cohesion(edges(spark, sf), assignment(spark)).select("bucket", "n", r("cohesion").alias("cohesion"))


#: Edges between two units, in either direction, are one pair.
_PAIR = f"(SELECT bs AS bucket, least(src, dst) AS x, greatest(src, dst) AS y, sum(w) AS w, sum(n) AS n FROM {_EA} WHERE bs = bd AND src <> dst GROUP BY ALL)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = _ea(spark, sf).where("bs = bd AND src <> dst")
    return e.groupBy(F.col("bs").alias("bucket"), F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.sum("w").alias("w"), F.sum("n").alias("n"))


@query("gra_similarity_cohesion", f"SELECT bucket, round(avg(w / n), 6) AS similarity FROM {_PAIR} GROUP BY 1")
def gra_similarity_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).groupBy("bucket").agg(r(F.avg(F.col("w") / F.col("n"))).alias("similarity"))


@query("gra_service_count", f"SELECT count(DISTINCT bucket) AS n, abs(count(DISTINCT bucket) - 7) AS off FROM {_A}")
def gra_service_count(spark: SparkSession, sf: str) -> DataFrame:
    return assignment(spark).agg(F.count_distinct("bucket").alias("n")).select("n", F.abs(F.col("n") - 7).alias("off"))


_S = "(SELECT p_partkey % 23 AS service, p_brand AS l1, p_type AS l2, p_name AS l3, p_partkey AS id, p_size FROM part)"


def _services(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.expr("p_partkey % 23").alias("service"), F.col("p_brand").alias("l1"), F.col("p_type").alias("l2"), F.col("p_name").alias("l3"), F.col("p_partkey").alias("id"), "p_size")


@query("gra_security", f"SELECT round(count(*) FILTER (s = 0 OR s = n) / count(*), 6) AS pure_share FROM (SELECT service, l1, count(*) FILTER (p_size > 45) AS s, count(*) AS n FROM {_S} GROUP BY ALL)")
def gra_security(spark: SparkSession, sf: str) -> DataFrame:
    """Share of buckets where sensitive parts don't mix with others; the score is ours, as none is given."""
    b = _services(spark, sf).groupBy("service", "l1").agg(F.count_if(F.col("p_size") > 45).alias("s"), F.count("*").alias("n"))
    return b.agg(r(F.count_if((F.col("s") == 0) | (F.col("s") == F.col("n"))) / F.count("*")).alias("pure_share"))


_CONT = f"SELECT service, id, (CASE WHEN l1 <> m1 THEN 9 ELSE 0 END + CASE WHEN l2 <> m2 THEN 3 ELSE 0 END + CASE WHEN l3 <> m3 THEN 1 ELSE 0 END)::INT AS d FROM {_S} JOIN (SELECT service, max(l1) AS m1, max(l2) AS m2, max(l3) AS m3 FROM {_S} GROUP BY 1) USING (service)"


def _contaminated(spark: SparkSession, sf: str) -> DataFrame:
    s = _services(spark, sf)
    path = s.groupBy("service").agg(F.array(F.max("l1"), F.max("l2"), F.max("l3")).alias("path"))
    return s.join(path, "service").select("service", "id", G.contamination(F.array("l1", "l2", "l3"), F.col("path")).alias("d"))


@query("gra_contamination", f"SELECT service, sum(d)::BIGINT AS total, round(avg(d), 6) AS mean, max(d) AS worst, round(max(d) / sum(d), 6) AS concentration FROM ({_CONT}) GROUP BY 1")
def gra_contamination(spark: SparkSession, sf: str) -> DataFrame:
    return _contaminated(spark, sf).groupBy("service").agg(F.sum("d").cast("long").alias("total"), r(F.avg("d")).alias("mean"), F.max("d").alias("worst"), r(F.max("d") / F.sum("d")).alias("concentration"))


@query("ord_topk_contam", f"WITH c AS ({_CONT}), s AS (SELECT service, sum(d) AS total, row_number() OVER (ORDER BY sum(d) DESC, service) AS rk FROM c GROUP BY 1) SELECT service, id, d, i::INT AS rank FROM (SELECT c.*, row_number() OVER (PARTITION BY service ORDER BY d DESC, id) AS i FROM c JOIN s USING (service) WHERE rk <= 5) WHERE i <= 3")
def ord_topk_contam(spark: SparkSession, sf: str) -> DataFrame:
    c = _contaminated(spark, sf)
    top = c.groupBy("service").agg(F.sum("d").alias("total")).orderBy(F.desc("total"), "service").limit(5)
    return R.top_by_group(c.join(F.broadcast(top.select("service")), "service"), ["service"], [F.desc("d"), F.col("id")], 3)  # five rows


@query("agg_majority_share", f"SELECT service, round(max(n) / sum(n), 6) AS share FROM (SELECT service, l2, count(*) AS n FROM {_S} GROUP BY ALL) GROUP BY 1")
def agg_majority_share(spark: SparkSession, sf: str) -> DataFrame:
    return G.agreement(_services(spark, sf), "service", "l2").select("service", r("share").alias("share"))


_AG = "(SELECT service, max(n) / sum(n) AS s{i} FROM (SELECT service, l{i}, count(*) AS n FROM " + _S + " GROUP BY ALL) GROUP BY 1)"


@query("gra_coherence", f"SELECT service, round(s1 + 1.5 * s2 + 2 * s3, 6) AS coherence FROM {_AG.format(i=1)} JOIN {_AG.format(i=2)} USING (service) JOIN {_AG.format(i=3)} USING (service)")
def gra_coherence(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted agreement of the three tag levels; without chains and data sources that is the whole formula."""
    s = _services(spark, sf)
    a = [G.agreement(s, "service", f"l{i}").withColumnRenamed("share", f"s{i}") for i in (1, 2, 3)]
    return a[0].join(a[1], "service").join(a[2], "service").select("service", r(F.expr("s1 + 1.5 * s2 + 2 * s3")).alias("coherence"))


@query("gra_chain_penalty", "SELECT l_orderkey AS chain, count(DISTINCT l_suppkey % 9) - 1 AS penalty FROM lineitem GROUP BY 1")
def gra_chain_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("chain")).agg((F.count_distinct(F.expr("l_suppkey % 9")) - 1).alias("penalty"))


@query("agg_dup_having", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def agg_dup_having(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n")).where("n > 1")


query("gra_redundancy_1", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")(agg_dup_having)


@query("agg_redundancy", "SELECT sum(n - 1)::BIGINT AS redundancy FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1)")
def agg_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    return agg_dup_having(spark, sf).agg(F.sum(F.col("n") - 1).alias("redundancy"))


@query("gra_redundancy_2", f"SELECT l2, l3, count(DISTINCT service) AS n FROM {_S} GROUP BY ALL HAVING count(DISTINCT service) > 1")
def gra_redundancy_2(spark: SparkSession, sf: str) -> DataFrame:
    return _services(spark, sf).groupBy("l2", "l3").agg(F.count_distinct("service").alias("n")).where("n > 1")


_V = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query("gra_redundancy_3", f"WITH v AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM {_V}), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT a, b, round(s, 5) AS cosine FROM p WHERE s > 0.75")
def gra_redundancy_3(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions (vectors) within a label whose cosine is above 0.75; the optional third stage, after the cheap ones."""
    p = N.cosine_pairs(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0.75)
    return p.select("a", "b", V.rounded(F.col("s"), 5).alias("cosine"))


@query("gra_objective", f"SELECT service, round(0.5::DOUBLE * total - 0.3::DOUBLE * n + 0.2::DOUBLE * worst, 6) AS objective FROM (SELECT service, sum(d) AS total, count(*) AS n, max(d) AS worst FROM ({_CONT}) GROUP BY 1)")
def gra_objective(spark: SparkSession, sf: str) -> DataFrame:
    c = _contaminated(spark, sf).groupBy("service").agg(F.sum("d").alias("total"), F.count("*").alias("n"), F.max("d").alias("worst"))
    return c.select("service", r(F.expr("0.5D * total - 0.3D * n + 0.2D * worst")).alias("objective"))


#: What links two units, and how much each kind counts: calls in the code, calls seen at run time, shared tables, changes made together, like names.
_ALPHA = {"static": 0.3, "trace": 0.25, "db": 0.2, "change": 0.15, "semantic": 0.1}
_FIVE = "CASE l_linenumber % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_ALPHA)) + " END"
_E5 = f"(SELECT l_suppkey % 97 AS src, l_partkey % 89 AS dst, {_FIVE} AS kind, count(*) AS n FROM lineitem GROUP BY ALL)"
_W5 = "CASE kind " + " ".join(f"WHEN '{k}' THEN {a}" for k, a in _ALPHA.items()) + " END"


@query("gra_affinity", f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum({_W5} * n / m), 6) AS w FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, kind, sum(n) AS n FROM {_E5} WHERE src <> dst GROUP BY ALL) JOIN (SELECT kind, max(n) AS m FROM (SELECT kind, sum(n) AS n FROM {_E5} WHERE src <> dst GROUP BY kind, least(src, dst), greatest(src, dst)) GROUP BY 1) USING (kind) GROUP BY ALL")
def gra_affinity(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of units with the weights of five kinds of links, each over the highest of its kind, summed with shares that sum to one."""
    e = table(spark, sf, "lineitem").select(F.expr("l_suppkey % 97").alias("src"), F.expr("l_partkey % 89").alias("dst"), F.expr(_FIVE).alias("kind"))
    e = e.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind").agg(F.count("*").alias("n"))
    top = e.groupBy("kind").agg(F.max("n").alias("m"))
    return e.join(F.broadcast(top), "kind").groupBy("a", "b").agg(r(F.sum(F.expr(_W5).cast("double") * F.col("n") / F.col("m"))).alias("w"))  # five rows


_COHW = f"(SELECT bucket, CASE WHEN n > 1 THEN coalesce(w, 0) / (n * (n - 1) / 2.0) ELSE 0 END AS coh FROM (SELECT bucket, count(*) AS n FROM {_A} GROUP BY 1) LEFT JOIN (SELECT bucket, sum(w) AS w FROM {_PAIR} GROUP BY 1) USING (bucket))"


@query("gra_coh_weighted", f"SELECT bucket, round(coh, 5) AS coh, round((SELECT avg(coh) FROM {_COHW}), 5) AS mean FROM {_COHW}")
def gra_coh_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Weight inside each service over its C(n, 2) pairs, and the mean over services."""
    c = G.weighted_cohesion(edges(spark, sf), assignment(spark))
    return c.join(F.broadcast(c.agg(r(F.avg("coh"), 5).alias("mean")))).select("bucket", r("coh", 5).alias("coh"), "mean")  # one row


@query("gra_coup_weighted", f"SELECT round(sum(w) FILTER (bs <> bd) / sum(w), 6) AS coup FROM {_EA}")
def gra_coup_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _ea(spark, sf).agg(r(F.sum(F.when(F.col("bs") != F.col("bd"), F.col("w"))) / F.sum("w")).alias("coup"))


@query("gra_purity", f"WITH c AS (SELECT service, l2, count(*) AS n FROM {_S} GROUP BY ALL), p AS (SELECT service, n / sum(n) OVER (PARTITION BY service) AS p FROM c) SELECT service, round(1 + sum(p * ln(p)) / ln((SELECT count(DISTINCT l2) FROM c)), 6) AS purity FROM p GROUP BY 1")
def gra_purity(spark: SparkSession, sf: str) -> DataFrame:
    c = _services(spark, sf).groupBy("service", "l2").agg(F.count("*").alias("n"))
    t = c.groupBy("service").agg(F.sum("n").alias("t"))
    k = c.agg(F.count_distinct("l2").alias("k"))
    p = c.join(t, "service").select("service", (F.col("n") / F.col("t")).alias("p"))
    return p.groupBy("service").agg(F.sum(F.expr("p * ln(p)")).alias("h")).join(F.broadcast(k)).select("service", r(1 + F.col("h") / F.ln("k")).alias("purity"))  # one row


@query("gra_role_violations", f"SELECT service, round(1 - 0.01::DOUBLE * count(*) FILTER (l2 = 'PROMO' AND p_size > 40) - 0.02::DOUBLE * count(*) FILTER (l2 = 'ECONOMY' AND p_size < 5), 6) AS fb FROM {_S} GROUP BY 1")
def gra_role_violations(spark: SparkSession, sf: str) -> DataFrame:
    v = lambda c: F.count_if(F.expr(c))
    return _services(spark, sf).groupBy("service").agg(r(1 - 0.01 * v("l2 = 'PROMO' AND p_size > 40") - 0.02 * v("l2 = 'ECONOMY' AND p_size < 5")).alias("fb"))


@query("gra_db_ownership", "SELECT count(*) FILTER (n > 1) AS multi, round(1 - 0.001::DOUBLE * count(*) FILTER (n > 1), 6) AS db FROM (SELECT l_partkey, count(DISTINCT l_suppkey % 9) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)")
def gra_db_ownership(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count_distinct(F.expr("l_suppkey % 9")).alias("n"))
    return t.agg(F.count_if(F.col("n") > 1).alias("multi")).select("multi", r(1 - 0.001 * F.col("multi")).alias("db"))


@query("gra_size_balance", f"SELECT round(avg(greatest(0, 1 - abs(n - 80) / 40.0)), 6) AS balance FROM (SELECT service, count(*) AS n FROM {_S} GROUP BY 1)")
def gra_size_balance(spark: SparkSession, sf: str) -> DataFrame:
    n = _services(spark, sf).groupBy("service").agg(F.count("*").alias("n"))
    return n.agg(r(F.avg(F.greatest(F.lit(0.0), 1 - F.abs(F.col("n") - 80) / 40.0))).alias("balance"))


@query("gra_api_stability", f"SELECT round(1 - sum(n * (w % 7) / 7) / sum(n), 6) AS api FROM {_E}")
def gra_api_stability(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).agg(r(1 - F.sum(F.expr("n * (w % 7) / 7")) / F.sum("n")).alias("api"))


@query("gra_penalty", f"""WITH RECURSIVE b AS (SELECT DISTINCT bs, bd FROM {_EA} WHERE bs <> bd AND n > 3), r AS (SELECT bs, bd FROM b UNION SELECT r.bs, b.bd FROM r JOIN b ON b.bs = r.bd),
m AS (SELECT x.bs AS node, least(x.bs, min(x.bd)) AS lead FROM r x JOIN r y ON x.bs = y.bd AND x.bd = y.bs WHERE x.bs <> x.bd GROUP BY 1, x.bs)
SELECT (SELECT count(DISTINCT lead) FROM m) AS cycles, (SELECT count(*) FROM m) AS in_cycles, (SELECT count(*) FROM (SELECT service FROM {_S} WHERE l2 LIKE 'PROMO%' OR l2 LIKE 'ECONOMY%' GROUP BY 1 HAVING count(DISTINCT left(l2, 2)) > 1)) AS mixed,
(SELECT count(*) FROM {_A} a WHERE node NOT IN (SELECT src FROM {_E}) AND node NOT IN (SELECT dst FROM {_E})) AS orphans, (SELECT abs(count(DISTINCT bucket) - 7) FROM {_A}) AS drift""")
def gra_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of services (of any length) and services in them, services that mix kinds which must not meet, units without edges, distance from seven services."""
    b = _ea(spark, sf).where("bs <> bd AND n > 3").select(F.col("bs").alias("src"), F.col("bd").alias("dst")).distinct()
    cyc = G.cycles(b).agg(F.count_distinct("lead").alias("cycles"), F.count("*").alias("in_cycles"))
    bad = _services(spark, sf).where("l2 LIKE 'PROMO%' OR l2 LIKE 'ECONOMY%'").groupBy("service").agg(F.count_distinct(F.left("l2", F.lit(2))).alias("k"))
    e = edges(spark, sf)
    orphans = assignment(spark).join(e.select(F.col("src").alias("node")).union(e.select("dst")), "node", "left_anti").agg(F.count("*").alias("orphans"))
    drift = assignment(spark).agg(F.abs(F.count_distinct("bucket") - 7).alias("drift"))
    one = cyc.join(F.broadcast(bad.agg(F.count_if(F.col("k") > 1).alias("mixed")))).join(F.broadcast(orphans)).join(F.broadcast(drift))  # one row each
    return one.select("cycles", "in_cycles", "mixed", "orphans", "drift")


_F = f"(SELECT service AS id, sum(d)::DOUBLE AS a, count(*)::DOUBLE AS b, avg(d) AS c FROM ({_CONT}) GROUP BY 1)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return _contaminated(spark, sf).groupBy(F.col("service").alias("id")).agg(F.sum("d").cast("double").alias("a"), F.count("*").cast("double").alias("b"), F.avg("d").alias("c"))


@query("gra_clip_norm", f"SELECT id, round(least(greatest((a - q1) / (q2 - q1), 0), 1), 6) AS norm FROM {_F}, (SELECT quantile_cont(a, 0.05) AS q1, quantile_cont(a, 0.95) AS q2 FROM {_F})")
def gra_clip_norm(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf)
    q = p.agg(F.percentile("a", F.lit(0.05)).alias("q1"), F.percentile("a", F.lit(0.95)).alias("q2"))
    return p.join(F.broadcast(q)).select("id", r(F.least(F.greatest(F.expr("(a - q1) / (q2 - q1)"), F.lit(0.0)), F.lit(1.0))).alias("norm"))  # one row


@query("gra_scalar_fitness", f"SELECT id, round(0.4 * a - 0.35 * b + 0.25 * c, 5) AS fitness FROM {_F}")
def gra_scalar_fitness(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).select("id", r(F.expr("0.4D * a - 0.35D * b + 0.25D * c"), 5).alias("fitness"))


@query("gra_agg_score", f"SELECT id, round(2 * a + 2 * b - 2 * c - 2 * (a / b) - b / 10 + c / 5, 5) AS score FROM {_F}")
def gra_agg_score(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).select("id", r(F.expr("2 * a + 2 * b - 2 * c - 2 * (a / b) - b / 10 + c / 5"), 5).alias("score"))


_DOM = f"SELECT x.id AS winner, y.id AS loser FROM {_F} x JOIN {_F} y ON x.a <= y.a AND x.b >= y.b AND (x.a < y.a OR x.b > y.b)"
_WAY = {"a": "min", "b": "max"}


def gra_dominate(spark: SparkSession, sf: str) -> DataFrame:
    return G.domination(_points(spark, sf), _WAY)


query("join_dominance", _DOM)(gra_dominate)
query("gra_dominate", _DOM)(gra_dominate)
_FR = f"WITH RECURSIVE d AS ({_DOM}), c AS (SELECT id, 1 AS front FROM {_F} UNION SELECT d.loser, c.front + 1 FROM c JOIN d ON d.winner = c.id)"


@query("gra_fronts", _FR + " SELECT id, max(front)::INT AS front FROM c GROUP BY 1")
def gra_fronts(spark: SparkSession, sf: str) -> DataFrame:
    return P.fronts(_points(spark, sf), _WAY).select("id", F.col("front").cast("int").alias("front"))


_GAP = " + ".join(f"coalesce(lead({c}) OVER (PARTITION BY front ORDER BY {c}, id) - lag({c}) OVER (PARTITION BY front ORDER BY {c}, id), 'inf'::DOUBLE)" for c in "ab")


@query("gra_trim", _FR + f", f AS (SELECT id, max(front)::INT AS front FROM c GROUP BY 1), w AS (SELECT id, front, {_GAP} AS crowding FROM f JOIN {_F} USING (id)) SELECT id, front, round(crowding, 6) AS crowding FROM w ORDER BY front, crowding DESC, id LIMIT 8")
def gra_trim(spark: SparkSession, sf: str) -> DataFrame:
    """The best eight: by front, then by the room around them."""
    return P.trim(_points(spark, sf), _WAY, 8).select("id", F.col("front").cast("int").alias("front"), r("crowding").alias("crowding"))


@query("gra_knee", f"WITH i AS (SELECT min(a) AS a0, max(b) AS b0 FROM {_F}) SELECT id, round(sqrt(pow(a - a0, 2) + pow(b - b0, 2)), 5) AS dist FROM {_F}, i ORDER BY sqrt(pow(a - a0, 2) + pow(b - b0, 2)), id LIMIT 1")
def gra_knee(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf)
    i = p.agg(F.min("a").alias("a0"), F.max("b").alias("b0"))
    return p.join(F.broadcast(i)).select("id", F.sqrt(F.expr("pow(a - a0, 2) + pow(b - b0, 2)")).alias("d")).orderBy("d", "id").limit(1).select("id", r("d", 5).alias("dist"))  # one row


def _genes(spark: SparkSession, sf: str) -> list[int]:
    return [row["bucket"] for row in assignment(spark).orderBy("node").collect()]  # 97 genes


@query("gra_crossover")
def gra_crossover(spark: SparkSession, sf: str) -> DataFrame:
    g = _genes(spark, sf)
    return spark.createDataFrame(list(enumerate(G.crossover(g, g[::-1], 7))), "node int, bucket long")


@query("gra_mutation")
def gra_mutation(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(int(x) for x in G.mutate(_genes(spark, sf), 9, 0.05, 7))), "node int, bucket long")


@query("gra_mutations_typed")
def gra_mutations_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Move, swap, split and merge of buckets, seeded."""
    g = _genes(spark, sf)
    move = G.mutate(g, 9, 0.02, 11)
    swap = [g[1], g[0], *g[2:]]
    split = [9 if b == 3 and i % 2 else b for i, b in enumerate(g)]
    merge = [0 if b == 8 else b for b in g]
    return spark.createDataFrame([(n, i, int(b)) for n, x in (("move", move), ("swap", swap), ("split", split), ("merge", merge)) for i, b in enumerate(x)], "mutation string, node int, bucket long")


@query("gra_tournament", f"SELECT x.id, CASE WHEN x.a < y.a OR (x.a = y.a AND x.id < y.id) THEN x.id ELSE y.id END AS winner FROM {_F} x JOIN {_F} y ON y.id = (x.id * 7 + 3) % 23")
def gra_tournament(spark: SparkSession, sf: str) -> DataFrame:
    """One against one, opponents by a fixed permutation."""
    x = _points(spark, sf).select("id", "a")
    y = x.select(F.col("id").alias("opp"), F.col("a").alias("b"))
    return x.withColumn("opp", (F.col("id") * 7 + 3) % 23).join(y, "opp").select("id", F.when(F.expr("a < b OR (a = b AND id < opp)"), F.col("id")).otherwise(F.col("opp")).alias("winner"))


#: Suppliers have even node numbers, parts odd ones.
_BIP = "SELECT 2 * l_suppkey AS node, 2 * l_partkey + 1 AS other, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL"
_LPA = [f"k AS MATERIALIZED ({_BIP}), links AS MATERIALIZED (SELECT * FROM k UNION ALL SELECT other, node, w FROM k)", "l0 AS MATERIALIZED (SELECT DISTINCT node, node AS label FROM links)"]
for _i in range(6):
    _best = f"SELECT node, label AS new FROM (SELECT links.node, p.label, row_number() OVER (PARTITION BY links.node ORDER BY sum(w) DESC, p.label) AS rk FROM links JOIN l{_i} p ON p.node = other GROUP BY links.node, p.label) WHERE rk = 1"
    _LPA.append(f"l{_i + 1} AS MATERIALIZED (SELECT node, CASE WHEN node % 2 = {_i % 2} THEN new ELSE label END AS label FROM l{_i} JOIN ({_best}) USING (node))")


@query("gra_cluster_baselines", f"WITH {', '.join(_LPA)} SELECT node, label FROM l6")
def gra_cluster_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of the whole graph of suppliers and parts after three rounds of label propagation."""
    e = table(spark, sf, "lineitem").select((2 * F.col("l_suppkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst"), F.lit(1.0).alias("w"))
    return C.label_propagation(e, 3, F.col("node") % 2, most=e.count())  # of Parquet's footers


_P = "CASE WHEN x.l1 <> y.l1 THEN 0 WHEN x.l2 <> y.l2 THEN 1 WHEN x.l3 <> y.l3 THEN 2 ELSE 3 END"
_TOPS = f"(SELECT service, max(l1) AS l1, max(l2) AS l2, max(l3) AS l3 FROM {_S} GROUP BY 1)"


@query("gra_lca_search", f"SELECT a, b, depth FROM (SELECT x.service AS a, y.service AS b, {_P} AS depth, row_number() OVER (PARTITION BY x.service ORDER BY {_P} DESC, y.service) AS rk FROM {_TOPS} x JOIN {_TOPS} y ON x.service <> y.service) WHERE rk <= 2")
def gra_lca_search(spark: SparkSession, sf: str) -> DataFrame:
    """The two services (of 23) that share the longest path prefix with each."""
    t = _services(spark, sf).groupBy("service").agg(F.max("l1").alias("l1"), F.max("l2").alias("l2"), F.max("l3").alias("l3"))
    y = t.select(F.col("service").alias("b"), *[F.col(f"l{i}").alias(f"m{i}") for i in (1, 2, 3)])
    j = t.join(y, F.col("service") != F.col("b")).select(F.col("service").alias("a"), "b", F.expr("CASE WHEN l1 <> m1 THEN 0 WHEN l2 <> m2 THEN 1 WHEN l3 <> m3 THEN 2 ELSE 3 END").alias("depth"))
    return R.top_by_group(j, ["a"], [F.desc("depth"), F.col("b")], 2).select("a", "b", "depth")


@query("gra_cascade", f"""WITH n AS (SELECT s.id, arg_min(m.service, (CASE WHEN l1 <> m1 THEN 9 ELSE 0 END + CASE WHEN l2 <> m2 THEN 3 ELSE 0 END + CASE WHEN l3 <> m3 THEN 1 ELSE 0 END) * 1000 + m.service) AS near
FROM {_S} s, (SELECT service, max(l1) AS m1, max(l2) AS m2, max(l3) AS m3 FROM {_S} GROUP BY 1) m GROUP BY 1)
SELECT id, CASE WHEN p_size > 40 THEN concat('package ', l1) WHEN p_size > 30 THEN concat('tag ', l2) WHEN p_size > 20 THEN concat('data ', l3) ELSE concat('node ', near) END AS home FROM {_S} JOIN n USING (id)""")
def gra_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The first of four steps that names a home: package, service tags, data-source tags, the service that a part contaminates least (ties: the lowest)."""
    s = _services(spark, sf)
    paths = s.groupBy("service").agg(F.array(F.max("l1"), F.max("l2"), F.max("l3")).alias("path"))
    every = paths.agg(F.collect_list(F.struct("service", "path")).alias("nodes"))  # as many as there are services
    own = F.array("l1", "l2", "l3")
    near = F.array_min(F.transform("nodes", lambda x: F.struct(G.contamination(own, x["path"]).alias("d"), x["service"].alias("service"))))["service"]
    named = lambda kind, c: F.concat(F.lit(kind + " "), c.cast("string"))
    home = F.when(F.col("p_size") > 40, named("package", F.col("l1"))).when(F.col("p_size") > 30, named("tag", F.col("l2"))).when(F.col("p_size") > 20, named("data", F.col("l3"))).otherwise(named("node", near))
    return s.join(F.broadcast(every)).select("id", home.alias("home"))  # one row


@query("gra_move_loop")
def gra_move_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Move the unit with the best gain while coupling falls, at most 20 times; one audit row a move. The graph has 97 units."""
    w: dict[int, dict[int, int]] = {}
    for x in edges(spark, sf).where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n")).collect():
        for a, b in ((x["src"], x["dst"]), (x["dst"], x["src"])):
            w.setdefault(a, {})[b] = w.get(a, {}).get(b, 0) + x["n"]
    at, audit = {i: i % 9 for i in range(97)}, []
    for step in range(20):
        best = (0, 0, 0)
        for n, near in sorted(w.items()):
            pull: dict[int, int] = {}
            for m, k in near.items():
                pull[at[m]] = pull.get(at[m], 0) + k
            to = max(sorted(pull), key=lambda b: pull[b])
            best = max(best, (pull[to] - pull.get(at[n], 0), -n, to))
        if best[0] <= 0:
            break
        audit.append((step, -best[1], at[-best[1]], best[2], best[0]))
        at[-best[1]] = best[2]
    return spark.createDataFrame(audit, "step int, component int, from_ms int, to_ms int, gain int")


@query("gra_constraints", f"SELECT node, bucket FROM {_A} WHERE NOT (node IN (3, 12) AND bucket <> 3) AND node % 31 <> 5")
def gra_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals that no hard rule forbids: units forced together keep their bucket, frozen ones don't move."""
    rules = spark.createDataFrame([(3, 3), (12, 3)], "node long, forced long")
    a = assignment(spark).where("node % 31 <> 5")
    return a.join(F.broadcast(rules), "node", "left").where("forced is null or forced = bucket").select("node", "bucket")


_CM = """WITH n AS (SELECT l_suppkey % 5 AS a, l_partkey % 4 AS b, count(*) AS n FROM lineitem GROUP BY ALL), ra AS (SELECT a, sum(n) AS na FROM n GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM n GROUP BY 1),
tg AS (SELECT a, max(n) AS m, arg_max(b, n) AS tag FROM n GROUP BY 1),
s AS (SELECT (SELECT sum(n)::DOUBLE FROM n) AS t, (SELECT sum(n * (n - 1) / 2)::DOUBLE FROM n) AS both_, (SELECT sum(na * (na - 1) / 2)::DOUBLE FROM ra) AS pa, (SELECT sum(nb * (nb - 1) / 2)::DOUBLE FROM rb) AS pb),
i AS (SELECT sum(n / t * ln(n * t / (na::DOUBLE * nb))) AS mi FROM n JOIN ra USING (a) JOIN rb USING (b), s), h AS (SELECT (SELECT -sum(na / t * ln(na / t)) FROM ra, s) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM rb, s) AS hb)
SELECT round(100 * (1 - ((SELECT sum(n) - (SELECT sum(m) FROM tg) FROM n) + (SELECT count(*) - count(DISTINCT tag) FROM tg)) / (t - (SELECT list_reduce(list_prepend(0, list_sort(list(nb::BIGINT))), lambda g, s: CASE WHEN s > g THEN g + 1 ELSE g END) FROM rb))), 6) AS mojofm, round(both_ / pa, 6) AS precision, round(both_ / pb, 6) AS recall, round((both_ - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 8) AS ari, round(2 * mi / (ha + hb), 8) AS nmi FROM s, i, h"""


@query("gra_cluster_metrics", _CM)
def gra_cluster_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.expr("l_suppkey % 5").alias("a"), F.expr("l_partkey % 4").alias("b"))
    both = G.pair_scores(d, "a", "b").join(F.broadcast(J.mojofm(d, "a", "b")))  # one row each
    return both.select(r("mojofm").alias("mojofm"), r("precision").alias("precision"), r("recall").alias("recall"), r("ari", 8).alias("ari"), r("nmi", 8).alias("nmi"))


_ABL = f"SELECT alpha, id, round(alpha * a - (1 - alpha) * b, 5) AS score FROM {_F}, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS alpha)"


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    alpha = F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("alpha")
    return _points(spark, sf).select("id", "a", "b", alpha).select("alpha", "id", r(F.expr("alpha * a - (1 - alpha) * b"), 5).alias("score"))


query("gra_ablation", _ABL)(_grid)


@query("gra_sensitivity", f"SELECT id, round(max(score) - min(score), 4) AS span FROM ({_ABL}) GROUP BY 1")
def gra_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf).groupBy("id").agg(r(F.max("score") - F.min("score"), 4).alias("span"))
