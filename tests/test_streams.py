"""Stateful streams against their batch forms, over restarts and inputs cut anywhere."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomwork.operators import monitor
from loomwork.streaming import logs, state

LINES = "log string, line long, line_text string"
EVENTS = "user_id long, ts timestamp, event_id long, value double"


@pytest.fixture(autouse=True)
def store(spark):
    state.with_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rounds(spark, tmp_path, schema, batches, make):
    """Each batch is a file and a restart of the stream from its checkpoint."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q = make(spark.readStream.schema(schema).parquet(str(folder))).writeStream
        q.trigger(availableNow=True).option("checkpointLocation", out + "-state").foreachBatch(lambda df, k: df.withColumn("k", F.lit(k)).write.mode("append").parquet(out)).outputMode("update").start().awaitTermination()
    return spark.read.parquet(out)


def test_multiline_stream(spark, tmp_path):
    rng = random.Random(3)
    text = {k: [rng.choice(["2024-01-01 open", "  at frame", "cause", "2024-02-02 x"]) for _ in range(n)] for k, n in (("a", 40), ("b", 7), ("c", 1))}
    batch = logs.multiline(spark.createDataFrame([(k, "\n".join(v)) for k, v in text.items()], "log string, text string"), "log", r"^\d{4}-")
    want = {(r.log, r.event): r.text for r in batch.collect()}
    flat = [(k, i, line) for k, v in text.items() for i, line in enumerate(v, 1)]
    folder, out, held = tmp_path / "in", [], str(tmp_path / "state")
    folder.mkdir()
    cuts = {k: sorted(rng.sample(range(1, len(v)), min(2, len(v) - 1))) for k, v in text.items()}
    part = lambda k, i: 2 - sum(i <= c for c in cuts[k])
    keep = lambda df, _: out.extend(map(tuple, df.collect()))
    for p, idle in ((0, 600_000), (1, 600_000), (2, 2000)):
        rows = [r for r in flat if part(r[0], r[1]) == p]
        rng.shuffle(rows)
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(str(folder))
        stream = state.multiline_stream(spark.readStream.schema(LINES).parquet(str(folder)), "log", r"^\d{4}-", idle_ms=idle)
        q = stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", held).trigger(processingTime="200 milliseconds").start()
        until = time.time() + 60
        while time.time() < until and (len(out) < len(want) if p == 2 else not sum(x["numInputRows"] for x in q.recentProgress)):
            time.sleep(0.2)
        q.stop()  # the next round goes on from the checkpoint
    assert len(out) == len(want) and {(a, b): c for a, b, c in out} == want


def events(n=90):
    rng = random.Random(5)
    rows = [(i % 3, i, rng.gauss(100, 40)) for i in range(n)]
    at = __import__("datetime").datetime(2024, 1, 1)
    return [(u, at.replace(minute=i // 2), i, v) for u, i, v in rows]


def test_chart_stream(spark, tmp_path):
    rows = events()
    got = rounds(spark, tmp_path, EVENTS, [rows[:10], rows[10:11], rows[11:60], rows[60:]], state.chart_stream)
    last = {r.user_id: r for r in got.groupBy("user_id").agg(F.max_by(F.struct("z", "c_up", "c_dn", "n"), "n").alias("s")).select("user_id", "s.*").collect()}
    df = spark.createDataFrame(rows, EVENTS)
    z = monitor.ewma(df, "user_id", ["ts", "event_id"], "value", 0.2, 100.0)
    c = monitor.cusum(df.withColumn("x", (F.col("value") - 100) / 50), "user_id", ["ts", "event_id"], "x", 0.25)
    for r in z.join(c.select("event_id", "c_up", "c_dn"), "event_id").groupBy("user_id").agg(F.max_by(F.struct("z", "c_up", "c_dn"), "event_id").alias("s"), F.count("*").alias("n")).collect():
        seen = last[r.user_id]
        assert seen.n == r.n and all(abs(seen[k] - r.s[k]) < 1e-9 for k in ("z", "c_up", "c_dn"))


def test_monitor_stream(spark, tmp_path):
    rows = events()
    got = rounds(spark, tmp_path, EVENTS, [rows[:25], rows[25:26], rows[26:]], lambda s: state.monitor_stream(s, reference=6, size=4, step=3))
    seen = sorted((r.user_id, r.event_id, round(r.gap, 9)) for r in got.collect())
    want = []
    for u in range(3):
        mine = sorted((t, i, v) for uu, t, i, v in rows if uu == u)
        ref = sum(v for _, _, v in mine[:6]) / 6
        rest = mine[6:]
        want += [(u, rest[e - 1][1], round(sum(v for _, _, v in rest[e - 4 : e]) / 4 - ref, 9)) for e in range(4, len(rest) + 1, 3)]
    assert seen == sorted(want)
