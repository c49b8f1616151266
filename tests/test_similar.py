"""Pairs above a cosine against the SQL, over several blocks and odd vectors."""

import math
import random

import duckdb
import pytest
from pyspark.sql import types as T

from loomwork import registry
from loomwork.operators import similar

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


@pytest.mark.parametrize("block", [8192, 37])
def test_pairs_equal_sql(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "STRIP", 16)
    rng = random.Random(4)
    say = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, say(), rng.choice([0, 1, 1, 1, None])) for i in range(200)]
    rows += [(200 + i, rows[0][1], 1) for i in range(6)] + [(3, say(), 1), (None, say(), 1), (300, None, 1), (301, [], 1)]
    rows += [(302, [0.0] * 6, 1), (303, [1.0, None, 2.0], 1), (304, [1.0, 0.5, 2.0, None], 1), (305, [None, 0.0], 0), (306, [3.0], 0), (307, [2.0, None, 4.0, 1.0], 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    plain = lambda rows: sorted(repr((a, b, "nan" if math.isnan(s) else s)) for a, b, s in rows)
    want = con.execute(f"SELECT a, b, cosine FROM ({registry.oracle_sql()['gra_redundancy_3']})").fetchall()
    got = registry.queries()["gra_redundancy_3"](spark, str(tmp_path)).select("a", "b", "cosine").collect()
    assert len(want) > 300 and plain(map(tuple, got)) == plain(want)
