"""Bridged sessions over a stream: keyed state with event-time timers.

Rows of a film can come in any order within the watermark's delay.  They wait in
state until the watermark has passed them, are then taken in their order, and
leave state as soon as they are taken; a session is given out when the next
selected row does not join it, or when nothing has come for ``idle`` seconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SESSIONS = "movie_key long, event long, members long, first_shot long, last_shot long, span double, weighted_mean double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_timers(spark: SparkSession):
    """The state store that timers need, for the queries started within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class Bridge(StatefulProcessor):
    """State of a film: rows that wait, the last row taken, the last selected one, and the open session."""

    def __init__(self, bridge: float, idle: float):
        self.bridge, self.idle = bridge, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "shot long", "scene long, selected boolean, start double, end double")
        # shot, scene and length of the last row taken; shot and scene of the last selected one (0 before the first)
        self.last = handle.getValueState("last", "shot long, scene long, length double, selected_shot long, selected_scene long")
        self.open = handle.getValueState("open", "event long, members long, first_shot long, last_shot long, start double, end double, weighted double, seconds double")
        self.number = handle.getValueState("number", "event long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = []
        for batch in rows:
            for r in batch.itertuples():
                self.waiting.updateValue((int(r.shot),), (int(r.scene), bool(r.selected), float(r.start), float(r.end)))
                ends.append(float(r.end))
        if ends:  # one timer for the first row to be taken: what still waits then sets the next
            self.handle.registerTimer(int(min(ends) * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        waiting = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator())
        ready, later = [w for w in waiting if w[1][3] <= now], [w[1][3] for w in waiting if w[1][3] > now]
        out = []
        open_ = tuple(self.open.get()) if self.open.exists() else None
        last = tuple(self.last.get()) if self.last.exists() else None
        number = int(self.number.get()[0]) if self.number.exists() else 0
        for shot, (scene, selected, start, end) in ready:
            if selected:
                step = shot - last[3] if last and last[3] else 0
                joined = open_ is not None and step > 0 and last[4] == scene and (step == 1 or step == 2 and last[0] == shot - 1 and last[1] == scene and last[2] <= self.bridge)
                if open_ is not None and not joined:
                    out.append(self.closed(key, open_))
                if joined:
                    event, members, first, _, begun, until, weighted, seconds = open_
                    open_ = (event, members + 1, first, shot, min(begun, start), max(until, end), weighted + shot * (end - start), seconds + end - start)
                else:
                    number += 1
                    open_ = (number, 1, shot, shot, start, end, shot * (end - start), end - start)
            last = (shot, scene, end - start, shot if selected else (last[3] if last else 0), scene if selected else (last[4] if last else 0))
            self.waiting.removeKey((shot,))
        if later:
            self.handle.registerTimer(int(min(later) * 1000) + 1)
        if ready:
            self.last.update(last)
            self.number.update((number,))
        if open_ is not None and not later:
            until = open_[5] + self.idle
            if now >= until:
                out.append(self.closed(key, open_))
                open_ = None
            else:
                self.handle.registerTimer(int(until * 1000) + 1)
        self.open.update(open_) if open_ is not None else self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSIONS.split(", ")])

    def closed(self, key, session: tuple) -> tuple:
        event, members, first, last, start, end, weighted, seconds = session
        return (key[0], event, members, first, last, round(end - start, 3), round(weighted / seconds, 5) if seconds else None)

    def close(self) -> None:
        pass


def stream_bridges(rows: DataFrame, bridge: float, idle: float, delay: str) -> DataFrame:
    """A row for each session of a stream of movie_key, shot, scene, selected, start, end (seconds), once it has ended.

    Rows that come more than ``delay`` of event time after later ones are dropped by the watermark.  A row
    with no selected shot only matters as a bridge.  A shot that comes again before it is taken replaces the first.
    """
    timed = rows.withColumn("at", F.timestamp_millis((F.col("end") * 1000).cast("long"))).withWatermark("at", delay)
    return timed.groupBy("movie_key").transformWithStateInPandas(statefulProcessor=Bridge(bridge, idle), outputStructType=SESSIONS, outputMode="append", timeMode="eventTime")
