"""Unified diffs as rows: files, hunks and line numbers by window sums over hunk openings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as X

_OPEN = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunk_lines(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """key, file, hunk (from 1), kind ('+', '-' or ' '), old_line, new_line and text of every line in a hunk of unified diffs.

    A line that opens a hunk says how many old and new lines follow; so a removed line that reads like a file header is
    told from a header. old_line is null for added lines, new_line for removed ones. The file is the new name, or the old one
    where the new is /dev/null, without a/ or b/. A diff is ordered within its own text only; a null one has no lines.
    """
    rows = X.lines(diffs.select(key, F.col(diff).alias("text")).where("text is not null")).withColumnRenamed("line_text", "l")
    number = lambda i, other: F.coalesce(F.nullif(F.regexp_extract("l", _OPEN, i), F.lit("")).cast("int"), F.lit(other))
    opens = F.col("l").rlike(_OPEN)
    whole = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk", F.sum(opens.cast("int")).over(whole))
    first = rows.where(opens).select(key, "hunk", number(1, 0).alias("a"), number(2, 1).alias("an"), number(3, 0).alias("b"), number(4, 1).alias("bn"))
    rows = rows.join(first, [key, "hunk"], "left")
    # lines of the old and of the new text since the opening, before this one
    sign = F.when(opens | (F.col("hunk") == 0), F.lit(None)).otherwise(F.when(F.col("l") == "", " ").otherwise(F.substring("l", 1, 1)))
    rows = rows.withColumn("kind", sign)
    before = Window.partitionBy(key, "hunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda kinds: F.coalesce(F.sum(F.col("kind").isin(kinds).cast("int")).over(before), F.lit(0))
    rows = rows.withColumn("o", seen([" ", "-"])).withColumn("n", seen([" ", "+"]))
    more_old, more_new = F.col("o") < F.col("an"), F.col("n") < F.col("bn")
    inside = F.coalesce((F.col("kind").isin(" ", "-") & more_old) | (F.col("kind").isin(" ", "+") & more_new), F.lit(False))
    rows = rows.withColumn("inside", inside)
    name = lambda mark: F.when(~F.col("inside") & F.startswith("l", F.lit(mark)), F.regexp_extract("l", r"^(?:---|\+\+\+) (?:[ab]/)?([^\t]*)", 1))
    last = lambda c: F.last(c, ignorenulls=True).over(whole)
    rows = rows.withColumn("old", last(name("--- "))).withColumn("new", last(name("+++ ")))
    kept = rows.where("inside")
    return kept.select(
        key, F.when(F.col("new") == "/dev/null", F.col("old")).otherwise(F.coalesce("new", "old")).alias("file"), "hunk", "kind",
        F.when(F.col("kind") != "+", F.col("a") + F.col("o")).alias("old_line"), F.when(F.col("kind") != "-", F.col("b") + F.col("n")).alias("new_line"), F.expr("substring(l, 2)").alias("text"),
    )
