"""Windows and memory charts that run alike on tables and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str) -> DataFrame:
    """start, n and mean of each interval; give a stream a watermark first."""
    kind = events.schema["ts"].dataType
    w = events.groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("m"))
    return w.select(F.col("w.start").cast(kind).alias("start"), "n", "m")


def bursts(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start and n of runs of events without a gap of that length."""
    kind = events.schema["ts"].dataType
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast(kind).alias("start"), "n")


def ewma_stream(events: DataFrame, lam: float, start: float) -> DataFrame:
    """user_id, z and n after each batch of a stream: an EWMA that keeps one number a key as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        z, n = state.get if state.exists else (start, 0)
        for x in pd.concat(batches).sort_values(["ts", "event_id"])["value"]:
            z, n = lam * x + (1 - lam) * z, n + 1
        state.update((z, n))
        yield pd.DataFrame({"user_id": [key[0]], "z": [z], "n": [n]})

    keyed = events.select("user_id", "ts", "event_id", "value").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, z double, n long", "z double, n long", "update", "NoTimeout")
