"""Rounding and division of doubles as SQL does them, to the sign of a zero."""

import duckdb
from pyspark.sql import types as T

from loomwork import registry
from loomwork.functions import vectors as V

ODD = [0.0, -0.0, -0.0001, 0.0005, -0.0005, 1.0005, -1.0005, 2.0015, 0.49999999999999994, 389819.3525, -123456789012.12345, 1e300, -1e308, float("inf"), float("-inf"), None]


def text(rows):
    return [repr(r) for r in rows]


def test_rounded(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x double").orderBy("i")
    got = df.select(V.rounded(df.x, 3).alias("y"), V.rounded(df.x, 6).alias("z")).collect()
    want = [duckdb.execute("SELECT round(?::DOUBLE, 3), round(?::DOUBLE, 6)", [x, x]).fetchone() for x in ODD]
    assert text(map(tuple, got)) == text(want)


def test_inverse_2x2_on_odd_vectors(spark, tmp_path):
    rows = [[0.0, 0.0, 0.0, 0.0], [1.0, 2.0, 2.0, 4.0], [-1.0, 2.0, 2.0, -4.0], [1.0, 0.0, 0.0, 1.0], [1.0, 1e-7, 0.0, 1.0], [0.001, 0.5, 0.5, 249.9999], [1e-6, 1.0, 1e-12, 1.0], [1.0, 2.0], None]
    # quotients whose shortest decimal number is a half at the fourth place, though the double isn't one
    rows += [[1.0, -(k + 0.0005), 0.0, 1.0] for k in range(1, 40)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], schema).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT vec_id, det, top FROM ({registry.oracle_sql()['vec_inverse_2x2']}) ORDER BY vec_id").fetchall()
    got = registry.queries()["vec_inverse_2x2"](spark, str(tmp_path)).orderBy("vec_id").select("vec_id", "det", "top").collect()
    assert text((r[0], r[1], list(r[2])) for r in got) == text(want)
