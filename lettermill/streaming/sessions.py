"""The session budget over a stream of calls: a watermark for late calls and state for each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lettermill.operators.session import COUNTED

OUT = "session_id string, used long, exhausted boolean"


def budget_stream(calls: DataFrame, budget: int, late: str = "1 hour", idle_days: int = 30) -> DataFrame:
    """Running use of each session's budget. ``calls`` streams (session_id, seq, tool, at); calls recorded twice within the watermark count once.

    A session keeps its count through pauses; only after ``idle_days`` without a call, by event time, is it over and its state dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        for b in batches:
            used += int(b["tool"].isin(COUNTED).sum())
        state.update((used,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + idle_days * 86_400_000)
        yield pd.DataFrame({"session_id": [key[0]], "used": [used], "exhausted": [used >= budget]})

    once = calls.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["session_id", "seq"])
    return once.groupBy("session_id").applyInPandasWithState(step, OUT, "used long", "update", GroupStateTimeout.EventTimeTimeout)


def windowed_calls(calls: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Calls a tool and window."""
    c = calls.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return c.groupBy(F.window("at", size), "tool").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "tool", "n")
