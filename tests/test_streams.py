"""Keyed state with timers: late and repeated rows, order within the delay, restarts."""

import random

from sceneline.operators import sequences as sq
from sceneline.streaming.bridges import SESSIONS, keyed_timers, stream_bridges

ROW = "movie_key long, shot long, scene long, selected boolean, start double, end double"


def streamed(spark, folder, parts, idle=1000.0, delay="10 seconds"):
    """One run for each part, from the same checkpoint."""
    with keyed_timers(spark):
        for part in parts:
            spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = stream_bridges(spark.readStream.schema(ROW).parquet(f"{folder}/in"), 2.0, idle, delay)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return sorted((r["movie_key"], r["event"], r["members"], r["first_shot"], r["last_shot"]) for r in spark.read.schema(SESSIONS).parquet(f"{folder}/out").collect())


def batch(spark, rows):
    found = sq.bridged_sessions(spark.createDataFrame(rows, ROW), "movie_key", "shot", "selected", "scene", "start", "end", 2.0)
    groups = {}
    for r in found.collect():
        groups.setdefault((r["movie_key"], r["event"]), []).append(r["shot"])
    return sorted((*k, len(v), min(v), max(v)) for k, v in groups.items())


def film(movie, n, seed):
    rng, rows, at, scene = random.Random(seed), [], 0.0, 0
    for shot in range(1, n + 1):
        scene += rng.random() < 0.2
        length = rng.choice([1.0, 2.0, 3.5])
        rows.append((movie, shot, scene, rng.random() < 0.6, at, at + length))
        at += length
    return rows


END = (-1, 1, 0, False, 1e5, 1e5)


def test_order_and_restarts(spark, tmp_path):
    rows = [*film(1, 60, 1), *film(2, 40, 2), *film(3, 1, 3)]
    early = [r for r in rows if r[5] <= 50]
    kept = [r for r in early if r[5] > 42 and r[1] % 2]  # within the delay: they come with the next part
    parts = [[r for r in early if r not in kept], [*kept, *(r for r in rows if r[5] > 50)][::-1], [END]]
    assert streamed(spark, str(tmp_path), parts) == batch(spark, rows) != []


def test_late_and_repeated_rows(spark, tmp_path):
    rows = film(1, 40, 5)
    lost = next(r for r in rows if r[3] and r[5] > 20)
    first = [r for r in rows if r[5] <= 60 and r != lost]
    parts = [first, [rows[-1], *(r for r in rows if r[5] > 60)], [lost, *first[:3]], [END]]  # far behind the watermark
    assert streamed(spark, str(tmp_path), parts) == batch(spark, [r for r in rows if r != lost])


def test_idle_film_ends(spark, tmp_path):
    """A session is given out by its timer, without another row of its film; a film that goes on later has new sessions."""
    one = [(1, 1, 1, True, 0.0, 1.0), (1, 2, 1, True, 1.0, 2.0)]
    parts = [one, [(2, 1, 1, True, 500.0, 501.0)]]
    assert streamed(spark, str(tmp_path), parts, idle=50.0) == [(1, 1, 2, 1, 2)]
    assert streamed(spark, str(tmp_path), [[(1, 3, 1, True, 600.0, 601.0)], [END]], idle=50.0) == [(1, 1, 2, 1, 2), (1, 2, 1, 3, 3), (2, 1, 1, 1, 1)]


def test_one_timer_for_all_that_waits():
    """Rows of a batch set one timer, what still waits sets the next: not one for each row."""
    import pandas as pd

    from sceneline.streaming import bridges

    class Kept:
        def __init__(self):
            self.held = {}

        def updateValue(self, k, v):
            self.held[k] = v

        def removeKey(self, k):
            del self.held[k]

        def iterator(self):
            return iter(list(self.held.items()))

        def exists(self):
            return bool(self.held)

        def get(self):
            return self.held[0]

        def update(self, v):
            self.held = {0: v}

        def clear(self):
            self.held = {}

    class Handle:
        def __init__(self):
            self.timers = []

        def getMapState(self, *_):
            return Kept()

        getValueState = getMapState

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 25_000

    bridge, handle = bridges.Bridge(60.0, 1000.0), Handle()
    bridge.init(handle)
    rows = pd.DataFrame([(n, 1, True, 10.0 * n, 10.0 * n + 4) for n in range(5, 0, -1)], columns=["shot", "scene", "selected", "start", "end"])
    assert list(bridge.handleInputRows((7,), iter([rows]), Now())) == [] and handle.timers == [14_001]
    assert list(bridge.handleExpiredTimer((7,), Now(), None)) == [] and handle.timers == [14_001, 34_001]
    assert sorted(k[0] for k in bridge.waiting.held) == [3, 4, 5]
