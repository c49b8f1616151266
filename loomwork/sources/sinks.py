"""Readers of text and CSV, and sinks that can be read again."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as X

#: Texts above this size are refused, as in a workspace tool.
MOST_BYTES = 5 * 1024 * 1024


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


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/sinks/{name}-{uuid.uuid4().hex}"


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path below the root, type, size and time of files, and the folders that hold them; contents aren't read.

    Folders that are never searched are left out with all below them. Spark's readers don't see empty files, empty folders and
    names that start with a dot or an underscore. Without ``recursive``, only what lies in the root itself.
    """
    root = re.sub("^file:/*", "/", path).rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.substr(F.col("path"), F.locate(root, "path") + F.lit(len(root) + 1))
    files = found.select(below.alias("path"), F.lit("file").alias("type"), F.col("length").alias("size"), "modificationTime").where(~X.ignored(F.col("path")))
    dirs = X.folders(files).select("path", F.lit("dir").alias("type"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modificationTime"))
    both = files.unionByName(dirs)
    return both if recursive else both.where(~F.contains("path", F.lit("/")))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files up to MOST_BYTES."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.octet_length("text") <= MOST_BYTES)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def with_split(df: DataFrame, test: F.Column) -> DataFrame:
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def write_text(df: DataFrame, path: str, col: str = "text") -> None:
    df.select(F.col(col).alias("value")).write.mode("overwrite").option("lineSep", "\u0000").text(path)


def save_markdown(df: DataFrame, path: str, name: str, col: str = "text") -> None:
    """Texts in folders named after them, with characters replaced that file names can't have."""
    df.select(X.safe_name(F.col(name)).alias("name"), F.col(col).alias("value")).write.mode("overwrite").partitionBy("name").option("lineSep", "\u0000").text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
