"""Streams: windows and sessions with watermarks, and runs above a threshold as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and window; rows later than ``late`` are left out by the watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def user_sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


RUN = "user_id long, first_event long, apex_event long, apex double, length long"
_STATE = "first_event long, apex_event long, apex double, length long"


def runs_above(events: DataFrame, threshold: float) -> DataFrame:
    """A row for each run of a user's events above ``threshold`` once it has ended: its first event, its maximum and length.

    The open run of a user is the only state; a run that is open at the end stays open.  Events
    of a user come in order of ts within and between batches.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        run, done = list(state.get) if state.exists else None, []
        for event, value in zip(rows["event_id"], rows["value"], strict=True):
            if value > threshold:
                if run is None:
                    run = [int(event), int(event), float(value), 1]
                else:
                    run[3] += 1
                    if value > run[2]:
                        run[1], run[2] = int(event), float(value)
            elif run is not None:
                done.append((key[0], *run))
                run = None
        if run is None:
            state.remove() if state.exists else None
        else:
            state.update(tuple(run))
        yield pd.DataFrame(done, columns=[c.split()[0] for c in RUN.split(", ")])

    return events.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(step, RUN, _STATE, "append", GroupStateTimeout.NoTimeout)
