"""Written tables that cut lineage, in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, one of our own, but only if all runs on one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("/tmp/checkpoints")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    The files outlive executors, so later stages never recompute what stands before them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._lw_path = path
    return held


def drop(*tables: DataFrame) -> None:
    """Delete tables that table() wrote, once all that was made from them has been written too."""
    for held in tables:
        jvm = held.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(held._lw_path)
        path.getFileSystem(held.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
