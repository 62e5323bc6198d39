"""Lifecycles as a stream: the rules of tideline.operators.lifecycle, one poll of a line at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, generation int, first_seen long, last_seen long, state string, omissions int, confirmed_at long"
LINE = "generation int, first_seen long, last_seen long, state string, omissions int, confirmed_at long"
#: What the RocksDB state store is named in the session's configuration.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Lifecycle(StatefulProcessor):
    """Three state variables of a line: its open generation, the latest poll it has been through, and how many
    generations it has closed. A processing-time timer drops all of them `idle` milliseconds after the event's start,
    when nothing is taken away any more; an appearance puts the timer off."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", LINE)
        self.latest = handle.getValueState("latest", "poll long")
        self.closed = handle.getValueState("closed", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        line = list(self.line.get()) if self.line.exists() else None
        latest = self.latest.get()[0] if self.latest.exists() else None
        out, started = [], False
        got = pd.concat(list(rows)).sort_values("poll", kind="stable")
        for r in got.itertuples():
            if latest is not None and r.poll <= latest:
                continue  # older than what has been seen: a correction, not a poll
            latest, started = int(r.poll), bool(r.started)
            ok = bool(r.succeeded) and not bool(r.unavailable)
            if r.present:
                if line is None:
                    line = [1, latest, latest, "present", 0, None]
                elif ok and line[3] == "confirmed_removed":
                    out.append((key[0], *line))
                    self.closed.update((line[0],))
                    line = [line[0] + 1, latest, latest, "present", 0, None]
                else:
                    line[2] = latest
                    if ok:
                        line[3:5] = ["present", 0]
            elif line is not None and ok and not started and line[4] < 2:
                line[4] += 1
                line[3] = "single_omission" if line[4] == 1 else "confirmed_removed"
                line[5] = latest if line[4] == 2 else None
        if latest is not None:
            self.latest.update((latest,))
        if line is not None:
            self.line.update(tuple(line))
            out.append((key[0], *line))
            if started and self.idle:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(int(t[0] if isinstance(t, tuple) else t))
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)
        frame = pd.DataFrame(out, columns=["key", "generation", "first_seen", "last_seen", "state", "omissions", "confirmed_at"])
        yield frame.astype({"generation": "int32", "omissions": "int32", "first_seen": "int64", "last_seen": "int64", "confirmed_at": "Int64"})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.line.clear()
        self.latest.clear()
        yield pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("key", "object"), ("generation", "int32"), ("first_seen", "int64"), ("last_seen", "int64"), ("state", "object"), ("omissions", "int32"), ("confirmed_at", "Int64"))})

    def close(self) -> None:
        pass


def lifecycle_stream(polls: DataFrame, idle: int = 86_400_000) -> DataFrame:
    """polls(key, poll, present, succeeded, unavailable, started), streaming: after each batch the open generation of each
    line that was polled, and those that it closed; the last row of a (key, generation) is its state. The session's state
    store must be RocksDB (PROVIDER). idle: milliseconds after the start that a line is remembered (0: for good)."""
    return polls.groupBy("key").transformWithStateInPandas(Lifecycle(idle), OUT, "Update", "ProcessingTime")
