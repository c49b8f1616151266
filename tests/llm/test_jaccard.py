"""What the n-gram join moves: sets and texts without candidates stay where they lie."""

from pyspark.sql import functions as F

from loomwork.llm import jaccard as J


def test_only_candidates_move(spark):
    docs = spark.range(3000).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"w{k} "), F.col("id")) for k in range(6)]).alias("text"), F.lit(1).cast("long").alias("named"))
    docs = docs.unionByName(docs.where("id = 7").withColumn("id", F.lit(-3).cast("long")))
    nodes = spark.createDataFrame([(7,), (-3,), (9,)], "id long")
    sets = J._token_table(docs, nodes)
    ids = [r.id for r in sets.collect()]
    assert {7, -3, 9} <= set(ids) and len(ids) < 30  # few others share a bit
    assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
    every = J._token_table(docs, docs.select("id"))
    pairs = spark.createDataFrame([(-3, 7), (7, 9)], "a long, b long")
    for f in (J._may_link, J._verify):
        found = f(pairs, every)
        assert [tuple(r) for r in found.collect()] == [(-3, 7)]
        # sets are told apart before they are shuffled
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 5


def test_no_candidates(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1)], "id long, text string, named long")
    none = spark.createDataFrame([], "a long, b long")
    sets = J._token_table(docs, none.select(F.col("a").alias("id")))
    assert sets.count() == 0 and J._verify(none, sets).count() == 0
