"""Worked examples with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.functions import vectors as V
from loomwork.operators import graph as G
from loomwork.operators import memory as M
from loomwork.operators import monitor as P
from loomwork.operators import pareto
from loomwork.operators import relational as R
from loomwork.operators import search as S
from loomwork.operators import tokens as K
from loomwork.streaming import charts

SIGMA = np.array([[1, 0.8, 0.3, 0.1], [0.8, 1, 0.2, 0.1], [0.3, 0.2, 1, 0.6], [0.1, 0.1, 0.6, 1]])


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_hawkins(spark):
    inv = np.linalg.inv(SIGMA)
    d = vec(0.5, 0.5, 3, 2.5)
    t2, z = one(spark, P.t2(d, inv).alias("t"), P.contributions(d, P.cholesky_root(inv)).alias("z"))
    assert t2 == pytest.approx(9.963, abs=1e-3)
    assert z == pytest.approx([0.191, 0.006, 3.516, 6.250], abs=1e-3)
    assert sum(one(spark, P.contributions(d, P.symmetric_root(inv)).alias("z"))[0]) == pytest.approx(t2)


def test_t2_of_two(spark):
    assert one(spark, P.t2(vec(2, 2), np.linalg.inv(np.array([[1, 0.8], [0.8, 1]]))).alias("t"))[0] == pytest.approx(4.444, abs=1e-3)


def test_vectors(spark):
    assert one(spark, V.dot(vec(1, 2, 3), vec(4, 5, 6)).alias("d"))[0] == 32
    assert one(spark, V.matvec(F.array(vec(4, 5, 6), vec(7, 8, 9)), vec(1, 2, 3)).alias("d"))[0] == [32, 50]
    assert one(spark, V.cross(vec(1, 0, 0), vec(0, 1, 0)).alias("c"))[0] == [0, 0, 1]
    assert one(spark, V.cosine(vec(0, 0), vec(1, 1)).alias("c"))[0] is None
    assert one(spark, V.inverse_2x2(*[F.lit(x) for x in (1.0, 2.0, 2.0, 4.0)]).alias("i"))[0] is None


def test_dissect(spark):
    parts = X.dissect(F.lit("2025-03-06 12:00:00 ERROR [AuthService] - User login failed"), "%{timestamp} %{+timestamp} %{level} [%{logger}] - %{message}")
    assert list(one(spark, *[c.alias(k) for k, c in parts.items()])) == ["2025-03-06 12:00:00", "ERROR", "AuthService", "User login failed"]


def test_latex_lines(spark):
    fix = lambda s: one(spark, X.fix_latex(F.lit(s)).alias("f"))[0]
    assert fix("\\( a + b \\)\n") == "$a + b$\n"
    assert fix("\\( a + b \\)") == "$a + b$ "  # no line end: the closing dollar gets a space, as in the reference
    assert fix("no math") == "no math"


def test_glob_and_names(spark):
    assert X.glob_regex("**/f?.py") == r"^(?:.*/)?f[^/]\.py$"
    assert one(spark, X.safe_name(F.lit('a/b:c*"d')).alias("n"))[0] == "a b c  d"
    assert one(spark, X.replace_n(F.lit("a.b.c"), ".", "-", 1).alias("n"))[0] == "a-b.c"
    assert one(spark, X.numbered_list(F.lit("1. one\nx\n 2) two")).alias("n"))[0] == ["one", "two"]


def test_cohesion_and_coupling(spark):
    edges = spark.createDataFrame([("O", "P"), ("O", "I"), ("P", "F")], "src string, dst string")
    for groups, across, mean in (("OI|P|F", 2, 1 / 6), ("OP|IF", 2, 0.25), ("O|PI|F", 3, 0), ("OF|PI", 3, 0)):
        a = spark.createDataFrame([(n, b) for b, g in enumerate(groups.split("|")) for n in g], "node string, bucket int")
        assert G.assigned(edges, a).where("bs <> bd").count() == across
        assert G.cohesion(edges, a).agg(F.avg("cohesion")).first()[0] == pytest.approx(mean)


def test_closure_of_a_long_chain(spark):
    """A chain of more than 50 hops that ends in a circle is followed to its end."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(53)] + [(53, 51)], "src int, dst int")
    got = G.closure(edges, spark.createDataFrame([(0,), (50,)], "node int")).collect()
    assert sorted(map(tuple, got)) == [(0, i, i) for i in range(54)] + [(50, 50 + i, i) for i in range(4)]


def test_fronts(spark):
    s = spark.createDataFrame([(1, 2.0, 0.17, 0.0), (2, 3.0, 0.5, 1.0), (3, 2.0, 0.25, 0.0), (4, 3.0, 0.4, 1.0)], "id int, a double, b double, c double")
    got = {r.id: r.front for r in pareto.fronts(s, {"a": "min", "b": "max", "c": "min"}).collect()}
    assert got == {2: 1, 3: 1, 1: 2, 4: 2}


def test_contamination(spark):
    tag = lambda *p: F.array(*[F.lit(x) for x in p])
    assert one(spark, G.contamination(tag("trading", "order", "x"), tag("account", "profile", "x")).alias("d"))[0] == 12


def test_merge_and_groups(spark):
    a = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "k string, v int")
    b = spark.createDataFrame([("A", 4), ("B", 5), ("D", 6)], "k string, v int")
    assert R.merge(a, b, "k").count() == 2 and R.merge(a, b, "k", "full_outer").count() == 4
    assert R.merge(a, b, "k").columns == ["k", "v_x", "v_y"]
    g = spark.createDataFrame([("foo", 1), ("bar", 2), ("foo", 3), ("bar", 4), (None, 9)], "k string, v int")
    assert {tuple(r) for r in R.group_agg(g, "k", F.sum("v")).collect()} == {("foo", 4), ("bar", 6)}
    d = R.describe(spark.range(1, 6).toDF("x"), "x").first()
    assert (d["mean"], d["p25"], d["p50"], d["p75"]) == (3, 2, 3, 4) and d["std"] == pytest.approx(1.581139, abs=1e-6)


def test_memory_trace(spark):
    """Create, merge, search, list by tag, forget: whole words match, parts of words don't."""
    store = spark.createDataFrame([], "key string, entity_type string, attributes map<string,string>, content string, tags array<string>, updated_at string")
    step = lambda seq, notes, tags: (seq, "OrderRequest", "class", {"pkg": f"p{seq}"}, notes, tags)
    batch = spark.createDataFrame([step(1, "checkout flow", ["a"]), step(2, "more", ["a", "b"])], "seq int, key string, entity_type string, attributes map<string,string>, notes string, tags array<string>")
    done = M.upsert_entities(store, batch, "T").collect()
    assert len(done) == 1 and done[0].attributes == {"pkg": "p2"} and done[0].tags == ["a", "b"]
    assert done[0].content == "checkout flow\n\n---[T]---\nmore"
    docs = spark.createDataFrame([(1, "OrderRequest checkout flow"), (2, "PCA fault note"), (3, "a fault")], "doc_id int, text string")
    assert [r.id for r in S.bm25(docs, "checkout order").collect()] == [1]
    assert {r.id for r in S.bm25(docs, "PCA fault").collect()} == {2, 3}
    assert S.bm25(docs, "").count() == 0
    assert S.like_any(docs, "order", ["text"]).count() == 1
    with pytest.raises(M.InvalidMemory):
        M.validate(kind="thing")


def test_cusum_matches_recursion(spark):
    xs = [float(x) for x in np.random.default_rng(1).normal(0.2, 1, 60)]
    df = spark.createDataFrame(list(enumerate(xs)), "t int, x double").withColumn("k", F.lit(1))
    got = P.cusum(df, "k", ["t"], "x", 0.25).orderBy("t").collect()
    up = dn = 0.0
    for x, r in zip(xs, got, strict=True):
        up, dn = max(0.0, up + x - 0.25), min(0.0, dn + x + 0.25)
        assert r.c_up == pytest.approx(up) and r.c_dn == pytest.approx(dn)


def test_bpe_merges(spark):
    docs = spark.createDataFrame([("aaab aaab ab",)], "text string")
    first = K.bpe_merges(docs, "text", 2).orderBy("rank").collect()
    assert (first[0].left, first[0].right, first[0]["count"]) == ("a", "a", 4)


def test_bpe_merges_count_every_word(spark):
    """Rare words count too, however many words there are: against a plain count over all of them."""
    counts = {f"x{i}": 2 for i in range(20_500)} | {f"zq{i}zqzq": 1 for i in range(9_000)} | {"aaaaa": 3, "\U0001d4b3\U0001d4b3y": 4}
    docs = spark.createDataFrame([(" ".join([w] * k),) for w, k in counts.items()], "text string")
    held, want = {tuple(w): k for w, k in counts.items()}, []
    for rank in range(6):
        pairs = {}
        for w, k in held.items():
            for p in zip(w, w[1:]):  # noqa: B905
                pairs[p] = pairs.get(p, 0) + k
        (a, b), k = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        want.append((rank, a, b, k))
        merged = {}
        for w, c in held.items():
            out = []
            for s in w:
                if out and not out[-1][1] and (out[-1][0], s) == (a, b):
                    out[-1] = (a + b, True)
                else:
                    out.append((s, False))
            merged[tuple(s for s, _ in out)] = c
        held = merged
    assert sorted(map(tuple, K.bpe_merges(docs, "text", 6).collect())) == want
    few = spark.createDataFrame([("aaaaa aaaaa \U0001d4b3\U0001d4b3y",)], "text string")
    assert [tuple(r) for r in K.bpe_merges(few, "text", 9).orderBy("rank").collect()] == [(0, "a", "a", 8), (1, "aa", "a", 2), (2, "aa", "aaa", 2), (3, "\U0001d4b3", "y", 1), (4, "\U0001d4b3", "\U0001d4b3y", 1)]


def test_stream_equals_batch(spark, tmp_path):
    """A stateful EWMA and windows over a stream of files end where the batch does."""
    rows = [(i, i % 3, float(i % 7), f"2024-01-01 00:00:{i:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double, s string").withColumn("ts", F.to_timestamp("s")).drop("s")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = charts.ewma_stream(stream, 0.2, 1.0).writeStream.outputMode("update").format("memory").queryName("ewma").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: (round(r.z, 6), r.n) for r in spark.table("ewma").collect()}
    z = P.ewma(df, "user_id", ["ts", "event_id"], "value", 0.2, 1.0)
    want = {r.user_id: (round(r.z, 6), r.n) for r in z.groupBy("user_id").agg(F.max_by("z", "event_id").alias("z"), F.count("*").alias("n")).collect()}
    assert got == want
    q = charts.tumbling(stream, "10 seconds").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, charts.tumbling(df, "10 seconds").collect()))


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_encode_by_table_or_join(spark, monkeypatch, most):
    monkeypatch.setattr(K, "MOST_SENT", most)
    docs = spark.createDataFrame([(1, "The cat, the dog"), (2, ""), (3, None), (1, "The cat, the dog"), (None, "owl")], "k int, text string")
    vocab = spark.createDataFrame([(0, "<pad>"), (1, "<unk>"), (2, "the"), (3, "dog")], "id long, piece string")
    got = sorted(((r.k or 0, r.ids) for r in K.encode(docs, ["k"], "text", vocab).collect()), key=str)
    assert got == sorted([(1, [2, 1, 2, 3]), (1, [2, 1, 2, 3]), (2, []), (3, []), (0, [1])], key=str)
    assert K.encode(docs.limit(0), ["k"], "text", vocab).count() == 0
