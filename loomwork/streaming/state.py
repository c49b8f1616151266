"""Stateful streams: events of several lines with a timer, memory charts, windows against a reference that the stream keeps.

All use transformWithStateInPandas, whose state lives in RocksDB and in the checkpoint: set
spark.sql.streaming.stateStore.providerClass with with_state_store() before a stream starts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, which the operators here need."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    held = pd.concat(list(rows))
    return held.sort_values(order, kind="stable")


class _Lines(StatefulProcessor):
    """State of a log: the number of its open event and the event's lines so far."""

    def __init__(self, key: str, opens: str, idle_ms: int) -> None:
        self.key, self.opens, self.idle_ms = key, opens, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "event long, line long")
        self.open = handle.getListState("open", "text string")

    def _out(self, key: object, event: int, lines: list[str]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key], "event": [event], "text": ["\n".join(lines)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        event, last = self.number.get() if self.number.exists() else (0, 0)
        lines = [x[0] for x in self.open.get()] if self.open.exists() else []
        fresh, done = [], []
        for line, text in _in_order(rows, ["line"])[["line", "line_text"]].itertuples(index=False):
            if event == 0 or not lines and not fresh or re.search(self.opens, text):
                if lines or fresh:
                    done.append(self._out(key[0], event, lines + fresh))
                event, lines, fresh = event + 1, [], []
                self.open.clear()
            fresh.append(text)
            last = line
        self.number.update((event, int(last)))
        if fresh:
            self.open.appendList([(x,) for x in fresh])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from done

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.open.exists():
            yield self._out(key[0], self.number.get()[0], [x[0] for x in self.open.get()])
            self.open.clear()

    def close(self) -> None:
        pass


def multiline_stream(lines: DataFrame, key: str, opens: str, *, idle_ms: int = 10_000) -> DataFrame:
    """key, event (from 1) and text of the events of each log, from a stream of key, line (its number) and line_text.

    A line that matches ``opens`` ends the event before it; a log's last event comes when nothing was added for ``idle_ms``.
    What is appended after that starts an event of its own. Lines of a log arrive in the order of their numbers from batch to batch.
    As timers wait for the clock, the stream needs a trigger that repeats: availableNow wouldn't end.
    """
    kind = lines.schema[key].dataType.simpleString()
    keyed = lines.select(key, "line", "line_text").groupBy(key)
    return keyed.transformWithStateInPandas(_Lines(key, opens, idle_ms), f"`{key}` {kind}, event long, text string", "Append", "ProcessingTime")


class _Charts(StatefulProcessor):
    """State of a key: EWMA, both CUSUMs and the number of values."""

    def __init__(self, lam: float, start: float, mean: float, sd: float, k: float) -> None:
        self.lam, self.start, self.mean, self.sd, self.k = lam, start, mean, sd, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "z double, c_up double, c_dn double, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        z, up, dn, n = self.held.get() if self.held.exists() else (self.start, 0.0, 0.0, 0)
        for x in _in_order(rows, ["ts", "event_id"])["value"].tolist():
            if x != x:  # a missing value moves nothing
                continue
            z = self.lam * x + (1 - self.lam) * z
            s = (x - self.mean) / self.sd
            up, dn, n = max(0.0, up + s - self.k), min(0.0, dn + s + self.k), n + 1
        self.held.update((z, up, dn, n))
        yield pd.DataFrame({"user_id": [key[0]], "z": [z], "c_up": [up], "c_dn": [dn], "n": [n]})

    def close(self) -> None:
        pass


def chart_stream(events: DataFrame, *, lam: float = 0.2, start: float = 100.0, mean: float = 100.0, sd: float = 50.0, k: float = 0.25) -> DataFrame:
    """user_id, z (EWMA), c_up, c_dn (two-sided CUSUM of standardised values) and n after each batch of a stream of user_id, ts, event_id, value."""
    keyed = events.select("user_id", "ts", "event_id", "value").groupBy("user_id")
    return keyed.transformWithStateInPandas(_Charts(lam, start, mean, sd, k), "user_id long, z double, c_up double, c_dn double, n long", "Update", "None")


class _AgainstReference(StatefulProcessor):
    """State of a key: the first values, whose mean is the reference, and the last ``size`` values."""

    def __init__(self, reference: int, size: int, step: int) -> None:
        self.reference, self.size, self.step = reference, size, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "n long, total double")
        self.recent = handle.getListState("recent", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total = self.known.get() if self.known.exists() else (0, 0.0)
        recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        out = []
        for event_id, x in _in_order(rows, ["ts", "event_id"])[["event_id", "value"]].itertuples(index=False):
            if x != x:
                continue
            n += 1
            if n <= self.reference:
                total += x
                continue
            recent = [*recent[-self.size + 1 :], x] if self.size > 1 else [x]
            seen = n - self.reference
            if seen >= self.size and (seen - self.size) % self.step == 0:
                mean = sum(recent) / self.size
                out.append((key[0], event_id, mean, total / self.reference, mean - total / self.reference))
        self.known.update((n, total))
        if recent:
            self.recent.put([(x,) for x in recent])
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "m", "reference", "gap"])

    def close(self) -> None:
        pass


def monitor_stream(events: DataFrame, *, reference: int = 20, size: int = 10, step: int = 5) -> DataFrame:
    """user_id, event_id, m, reference and gap: the mean of each sliding window of ``size`` values, every ``step`` values, less the reference.

    The reference is the mean of a key's first ``reference`` values; windows start after them. State is a sum and one window for each key.
    """
    keyed = events.select("user_id", "ts", "event_id", "value").groupBy("user_id")
    return keyed.transformWithStateInPandas(_AgainstReference(reference, size, step), "user_id long, event_id long, m double, reference double, gap double", "Append", "None")
