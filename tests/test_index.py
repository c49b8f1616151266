"""The maintained index against a rebuild."""

import random

from pyspark.sql import functions as F

from loomwork.operators import index, search

VOCAB = ["lake", "river", "mit", "license", "the", "of", "and", "stone", "größe", "x1"]
CHANGE = "op string, id long, seq long, text string"


def batches(rng):
    say = lambda: " ".join(rng.choice(VOCAB) for _ in range(rng.randint(0, 30)))
    first = [("I", i, 0, say() if i else None) for i in range(60)] + [("I", 5, 1, "the river of stone"), ("I", None, 0, "lost")]
    second = [("U", i, 0, say()) for i in range(0, 60, 7)] + [("U", 100, 0, "mit license"), ("D", 3, 0, None), ("I", 3, 1, "back again"), ("D", 999, 0, None)]
    third = [("D", i, 0, None) for i in range(0, 60, 5)] + [("I", 10, 2, "the mit license of the lake"), ("U", 11, 0, "")]
    return [first, second, third]


def rebuilt(done):
    held = {}
    for b in done:
        for op, i, _, text in sorted((c for c in b if c[1] is not None), key=lambda c: c[2]):
            if op == "D":
                held.pop(i, None)
            else:
                held[i] = text
    return held


def same(spark, ix, held):
    docs = spark.createDataFrame(list(held.items()), "doc_id long, text string")
    key = lambda df: sorted((r.term, r.id, r.tf, tuple(r.positions), r.doc_len) for r in df.collect())
    assert key(ix.postings()) == key(search.postings(docs, "doc_id", "text"))
    for q in ("lake", "MIT-license the", "nothing", "größe of-the x1"):
        assert ix.search(q).collect() == search.bm25(docs, q).collect()
    assert ix.search("of", limit=None).count() == search.bm25(docs, "of", limit=None).count()


def test_stream_of_batches_equals_a_rebuild(spark, tmp_path):
    rng, folder, done = random.Random(8), tmp_path / "changes", []
    folder.mkdir()
    ix = index.TextIndex(spark, str(tmp_path / "index"), buckets=4, most_segments=2)
    changes = spark.readStream.schema(CHANGE).parquet(str(folder))
    for k, b in enumerate(batches(rng)):
        spark.createDataFrame(b, CHANGE).coalesce(1).write.mode("append").parquet(str(folder))
        ix.stream(changes, str(tmp_path / "state")).awaitTermination()  # every round is a restart from the checkpoint
        done.append(b)
        held = rebuilt(done)
        same(spark, ix, held)
        assert ix.state()[2] == k
    assert len(ix.state()[1]) == 1  # a third segment made it merge


def test_unchanged_segments_are_not_read_again(spark, tmp_path):
    ix = index.TextIndex(spark, str(tmp_path / "index"), buckets=2)
    rows = lambda ids: spark.createDataFrame([("I", i, 0, f"lake word{i}") for i in ids], CHANGE)
    ix.apply(rows(range(200)), 0)
    ix.apply(rows([300]), 1)
    ix.apply(rows([0]), 2)
    files = lambda s: {p: p.stat().st_mtime_ns for p in (tmp_path / "index" / s).rglob("*.parquet")}
    large = ix.state()[1][0]
    before = files(large)
    ix.merge(2)  # the two small ones
    assert ix.state()[1][0] == large and files(large) == before and len(ix.state()[1]) == 2
    assert ix.search("lake", None).count() == 201 and ix.postings(["word0"]).count() == 1
    plan = ix.postings(["word0"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    ix.apply(rows(range(400, 500)), 2)  # a batch that is sent again
    assert ix.search("lake", None).count() == 201
    ix.merge(1)
    assert len(ix.state()[1]) == 1 and ix.postings().count() == 402


def test_empty_index(spark, tmp_path):
    ix = index.TextIndex(spark, str(tmp_path / "index"))
    assert ix.postings().count() == 0 and ix.search("lake").count() == 0
    ix.apply(spark.createDataFrame([], CHANGE), 0)
    assert ix.postings().count() == 0 and ix.documents().where(F.lit(True)).count() == 0
