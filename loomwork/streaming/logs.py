"""Log lines: events of several lines, and streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import text as X


def multiline(texts: DataFrame, key: str, opens: str) -> DataFrame:
    """key, event (from 1) and text: a line that matches ``opens`` starts an event, the others append."""
    each = X.lines(texts)
    starts = F.when((F.col("line") == 1) | F.col("line_text").rlike(opens), 1).otherwise(0)
    held = each.withColumn("event", F.sum(starts).over(Window.partitionBy(key).orderBy("line")))
    rows = F.sort_array(F.collect_list(F.struct("line", "line_text")))
    return held.groupBy(key, "event").agg(rows.alias("r")).select(key, "event", F.array_join(F.col("r.line_text"), "\n").alias("text"))


def tail_logs(spark: SparkSession, glob: str) -> DataFrame:
    """A stream of the lines of files that match a glob."""
    return spark.readStream.text(glob)
