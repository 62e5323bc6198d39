"""Presence as a stream: the state of each quote between polls, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, poll long, state string, generation int"


def step(state: str, omissions: int, generation: int, present: bool) -> tuple[str, int, int]:
    """One poll's transition, the same as in tideline.operators.presence.line_presence."""
    if present:
        return "present", 0, generation + (state == "confirmed_removed")
    omissions = min(2, omissions + 1)
    return ("single_omission" if omissions == 1 else "confirmed_removed"), omissions, generation


def presence_stream(polls: DataFrame) -> DataFrame:
    """polls(key, poll, present), streaming: one row for each poll of a key (T-01, T-02). Polls that come out of
    order within a batch are sorted; one older than the key's latest is a correction and is skipped."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, omissions, generation, last = state.get if state.exists else ("present", 0, 1, -1)
        rows = []
        got = pd.concat(list(frames)).sort_values("poll")
        for poll, present in zip(got.poll, got.present, strict=True):
            if poll <= last:
                continue
            name, omissions, generation = step(name, omissions, generation, bool(present))
            last = int(poll)
            rows.append((key[0], last, name, generation))
        state.update((name, omissions, generation, last))
        yield pd.DataFrame(rows, columns=["key", "poll", "state", "generation"])

    return polls.groupBy("key").applyInPandasWithState(run, OUT, "state string, omissions int, generation int, last long", "append", GroupStateTimeout.NoTimeout)


def counts_by_window(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling windows; later than `late` they are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).count().select(F.col("w.start").alias("start"), kind, F.col("count").alias("n"))
