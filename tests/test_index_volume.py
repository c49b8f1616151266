"""What the maintained index shuffles, and its results against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomwork.operators import index, search

CHANGE = "op string, id {}, seq long, text string"


def shuffled(spark):
    """Bytes that all shuffles of the session have written."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    execs = sc.statusStore().executorList(False)
    return sum(execs.apply(i).totalShuffleWrite() for i in range(execs.size()))


def test_a_batch_shuffles_its_words_once(spark, tmp_path):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 10))) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(500)) for _ in range(400)]
    folder = str(tmp_path / "changes")
    spark.createDataFrame([("I", i, 0, t) for i, t in enumerate(texts)], CHANGE.format("long")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    before = shuffled(spark)
    index.TextIndex(spark, str(tmp_path / "index")).apply(rows, 0)
    assert 0 < shuffled(spark) - before < 2.2 * sum(map(len, texts))


def test_postings_are_read_without_a_shuffle(spark, tmp_path):
    ix = index.TextIndex(spark, str(tmp_path / "index"), buckets=2)
    rows = lambda op, ids: spark.createDataFrame([(op, i, 0, f"lake w{i}") for i in ids], CHANGE.format("long"))
    ix.apply(rows("I", range(500)), 0)
    ix.apply(rows("D", range(0, 500, 5)), 1)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the log were large
        before = shuffled(spark)
        found = ix.postings()
        joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        assert len(joins) == 1 and "BroadcastHashJoin" in joins[0]
        assert sorted(r.id for r in found.where("term = 'lake'").collect()) == [i for i in range(500) if i % 5]
        assert shuffled(spark) > before  # of the log only
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def posted(held):
    out = []
    for i, text in held.items():
        words = re.findall(r"\w+", (text or "").lower())
        out += [(t, i, words.count(t), tuple(k for k, x in enumerate(words) if x == t), len(words)) for t in set(words)]
    return sorted(out)


@pytest.mark.parametrize(("kind", "sent", "piece"), [("long", 500_000, 40), ("long", 0, 2_000_000), ("string", 500_000, 2_000_000)])
def test_batches_against_plain_python(spark, tmp_path, monkeypatch, kind, sent, piece):
    monkeypatch.setattr(index, "MOST_SENT", sent)
    monkeypatch.setattr(index, "PIECE", piece)
    rng, held = random.Random(sent), {}
    of = (lambda i: i) if kind == "long" else (lambda i: f"d{i}")
    ix = index.TextIndex(spark, str(tmp_path / "index"), id_type=kind, buckets=2, most_segments=2)
    ids = [-(2**63), -65, -64, -1, 0, 1, 63, 64, 65, 127, 128, 2**40, 2**63 - 1]
    for batch in range(3):
        rows = [(rng.choice("IUD"), of(i), 0, " ".join(rng.choice(["lake", "größe", "x1", "Sea", "a_b", "日本", "-"]) for _ in range(rng.randint(0, 40)))) for i in rng.sample(ids, 9)]
        rows += [(rng.choice("ID"), r[1], k + 1, "again lake") for r in rng.sample(rows, 4) for k in range(2)] if batch else []
        ix.apply(spark.createDataFrame(rows, CHANGE.format(kind)).repartition(3), batch)
        for op, i, _, text in sorted(rows, key=lambda r: r[2]):
            held.pop(i, None) if op == "D" else held.update({i: text})
        found = sorted((r.term, r.id, r.tf, tuple(r.positions), r.doc_len) for r in ix.postings().collect())
        assert found == posted(held)
        assert sorted((r.id, r.doc_len) for r in ix.documents().collect()) == sorted((i, len(re.findall(r"\w+", t))) for i, t in held.items())


def test_equal_changes_of_an_id_give_one_text(spark, tmp_path):
    ix = index.TextIndex(spark, str(tmp_path / "index"), buckets=2)
    ix.apply(spark.createDataFrame([("I", 1, 0, "b c"), ("I", 1, 0, "d e f"), ("D", 1, 0, None), ("I", 2, 0, None)], CHANGE.format("long")), 0)
    assert sorted((r.term, r.doc_len) for r in ix.postings().collect()) == [("d", 3), ("e", 3), ("f", 3)]
    assert sorted((r.id, r.doc_len) for r in ix.documents().collect()) == [(1, 3), (2, 0)]


def test_postings_of_texts(spark):
    held = {1: "The lake, the LAKE the", 2: None, 3: "", 4: "größe " * 300, 5: "--"}
    docs = spark.createDataFrame(list(held.items()), "doc_id long, text string")
    found = search.postings(docs, "doc_id", "text")
    assert sorted((r.term, r.id, r.tf, tuple(r.positions), r.doc_len) for r in found.collect()) == posted(held)
    assert found.where(F.col("tf") > 1).count() == 3
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
