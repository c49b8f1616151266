"""Readers, streams of files and data-frame operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import relational as R
from loomwork.sources import sinks
from loomwork.streaming import charts, logs


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.txt": "one\n", "src/b.py": "x = 1\n", "src/deep/c d.md": "# t\n\nend", "node_modules/m.js": "no", "src/build": "a file of that name", "empty.txt": ""}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path / "root")


def listed(df):
    return sorted((r.path, r.type, r.size) for r in df.collect())


def test_list_files(spark, tree):
    files = [("a.txt", "file", 4), ("src/b.py", "file", 6), ("src/build", "file", 19), ("src/deep/c d.md", "file", 8)]
    dirs = [("src", "dir", None), ("src/deep", "dir", None)]
    assert listed(sinks.list_files(spark, tree)) == sorted(files + dirs)
    assert listed(sinks.list_files(spark, f"file://{tree}/")) == sorted(files + dirs)
    assert listed(sinks.list_files(spark, tree, recursive=False)) == sorted(files[:1] + dirs[:1])
    assert sinks.list_files(spark, tree).where("type = 'file' AND modificationTime IS NULL").count() == 0


def test_read_text(spark, tree, monkeypatch):
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in sinks.read_text(spark, f"{tree}/*.txt").collect()}
    assert got["a.txt"] == "one\n"
    monkeypatch.setattr(sinks, "MOST_BYTES", 3)
    assert "a.txt" not in {r.path.rsplit("/", 1)[-1] for r in sinks.read_text(spark, f"{tree}/*.txt").collect()}


def test_tail_logs_reads_what_is_new(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()

    def poll():
        q = logs.tail_logs(spark, f"{folder}/*.log").writeStream.trigger(availableNow=True).option("checkpointLocation", out + "-state").format("parquet").start(out)
        q.awaitTermination()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    (folder / "a.log").write_text("one\ntwo\n")
    (folder / "a.txt").write_text("never\n")
    assert poll() == ["one", "two"]
    (folder / "b.log").write_text("three\n")
    assert poll() == ["one", "three", "two"]


def test_bursts_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(i, i % 2, f"2024-01-01 00:{i * i % 60:02d}:00") for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s string").withColumn("ts", F.to_timestamp("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    charts.bursts(stream, "4 minutes").writeStream.outputMode("complete").format("memory").queryName("bursts").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("bursts").collect())) == sorted(map(tuple, charts.bursts(df, "4 minutes").collect()))


def test_pivot_margins(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 6.0), (None, "x", 50.0), ("b", "z", 70.0)], "k string, c string, v double")
    assert {tuple(r) for r in R.pivot_table(df, "k", "c", ["x", "y"], "v").collect()} == {("a", 1.0, 2.0), ("b", 6.0, None)}
    got = R.pivot_table(df, "k", "c", ["x", "y"], "v", F.avg, 0.0, "All")
    assert {tuple(r) for r in got.collect()} == {("a", 1.0, 2.0, 1.5), ("b", 6.0, 0.0, 6.0), ("All", 3.5, 2.0, 3.0)}
    assert R.pivot_table(df.limit(0), "k", "c", ["x", "y"], "v").count() == 0


def test_merge_of_two_names(spark):
    a = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    b = spark.createDataFrame([("B", 5), ("D", 6)], "id string, v int")
    got = R.merge(a, b, how="full_outer", left_on="k", right_on="id")
    assert got.columns == ["k", "v_x", "id", "v_y"]
    assert {tuple(r) for r in got.collect()} == {("A", 1, None, None), ("B", 2, "B", 5), (None, None, "D", 6)}
    with pytest.raises(ValueError):
        R.merge(a, b)
