"""Ordered rows: islands, ranges, sessions, fills, samples and packings.

Every function is partitioned by a key (a film, a user, a request) and ordered
by an explicit position, so work spreads over keys and no global sort is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)
AFTER = (1, Window.unboundedFollowing)
#: Cells of a stratified sample, at most: their quotas are made on the driver and broadcast.
MOST_CELLS = 10_000


def ordinal(key: str | list[str], *order: str | Column) -> Column:
    """0-based position of a row within its key."""
    keys = [key] if isinstance(key, str) else key
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def run_apexes(frames: DataFrame, threshold: float, key: str = "movie_key", frame: str = "frame", value: str = "confidence") -> DataFrame:
    """A row for each maximal run above ``threshold``: the first frame of its maximum, unless that is frame 0.

    Frames are 0..n-1 without holes; a null value is not above the threshold.
    """
    hot = F.coalesce(F.col(value) > threshold, F.lit(False))
    w = Window.partitionBy(key).orderBy(frame).rowsBetween(*UP_TO_HERE)
    runs = frames.withColumn("_cold", F.sum(F.when(hot, 0).otherwise(1)).over(w)).where(hot)
    top = runs.groupBy(key, "_cold").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(frame)).alias("f"))).alias("m"))
    return top.select(key, (-F.col("m.f")).alias(frame), F.col("m.v").alias(value)).where(F.col(frame) > 0)


def frame_counts(frames: DataFrame, key: str = "movie_key") -> DataFrame:
    return frames.groupBy(key).agg(F.count("*").alias("frame_count"))


def ranges_from_boundaries(boundaries: DataFrame, meta: DataFrame, key: str = "movie_key") -> DataFrame:
    """Half-open ranges between consecutive boundaries: shot_id, start_frame, end_frame, frame_count, keyframe and confidences.

    ``meta`` has frame_count by key.  The ordinal counts empty ranges too, which are then left out.
    """
    ends = meta.select(key, F.lit(0).cast("long").alias("frame"), F.lit(None).cast("double").alias("confidence"))
    last = meta.select(key, F.col("frame_count").cast("long").alias("frame"), F.lit(None).cast("double").alias("confidence"))
    points = ends.unionByName(boundaries.select(key, F.col("frame").cast("long").alias("frame"), F.col("confidence").cast("double").alias("confidence"))).unionByName(last)
    w = Window.partitionBy(key).orderBy("frame", F.col("confidence").isNull())
    rows = points.withColumns(
        {"end_frame": F.lead("frame").over(w), "boundary_after_confidence": F.lead("confidence").over(w), "ordinal": F.row_number().over(w)}
    ).where("end_frame > frame")
    start, end = F.col("frame"), F.col("end_frame")
    return rows.select(
        key,
        F.format_string("shot_%06d", F.col("ordinal")).alias("shot_id"),
        start.alias("start_frame"),
        end,
        (end - start).alias("frame_count"),
        F.floor((start + end - 1) / 2).alias("keyframe_frame"),
        F.col("confidence").alias("boundary_before_confidence"),
        "boundary_after_confidence",
    )


def sliding_windows(frames: DataFrame, size: int = 100, stride: int = 50, key: str = "movie_key", frame: str = "frame") -> DataFrame:
    """Windows of ``size`` frames every ``stride``, edges repeated: key, window, frames (array of clamped indices).

    The centre ``stride`` frames of the windows cover every frame once.
    """
    pad = (size - stride) // 2
    n = frames.groupBy(key).agg((F.max(frame) + 1).alias("n"))
    w = n.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / stride))))
    first = F.col("window") * stride - pad
    index = F.transform(F.sequence(first, first + size - 1), lambda i: F.greatest(F.lit(0).cast("long"), F.least(i, F.col("n") - 1)))
    return w.select(key, "window", index.alias("frames"))


def change_groups(key: str, order: list[str], values: list[str]) -> Column:
    """Number that grows with each change of ``values`` along ``order``; a null value always starts a new group."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*values)).over(w)
    known = F.lit(True)
    for v in values:
        known = known & F.col(v).isNotNull()
    return F.sum(F.when(known & before.isNotNull() & (before == F.struct(*values)), 0).otherwise(1)).over(w.rowsBetween(*UP_TO_HERE))


def islands(key: str, order: list[str], breaks: Column) -> Column:
    """Number of the island: one more at each row where ``breaks`` holds (null counts as a break)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(*UP_TO_HERE)
    return F.sum(F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(w)


def bounded_islands(rows: DataFrame, key: str, order: list[str], at: str, gap: float, most: int) -> DataFrame:
    """``rows`` with island and chunk: a gap above ``gap`` starts an island, and after ``most`` rows a new chunk."""
    w = Window.partitionBy(key).orderBy(*order)
    out = rows.withColumn("island", islands(key, order, F.col(at) - F.lag(at).over(w) > gap))
    n = F.row_number().over(Window.partitionBy(key, "island").orderBy(*order)) - 1
    return out.withColumn("chunk", F.floor(n / most))


class GroupStream:
    """For ``mapInArrow`` over rows sorted by their first ``keys`` columns: ``func`` makes rows of the rows (tuples) of one key.

    Only one key's rows are held, and results go out in batches, so many small keys cost little each.
    """

    BATCH = 10_000

    def __init__(self, keys: int, func, schema):
        self.keys, self.func, self.schema = keys, func, schema

    def __call__(self, batches):
        import pyarrow as pa

        frame = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)
        held, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[: self.keys] != held[0][: self.keys]:
                    out += self.func(held)
                    held = []
                held.append(row)
            while len(out) >= self.BATCH:
                yield frame(out[: self.BATCH])
                out = out[self.BATCH :]
        if held:
            out += self.func(held)
        if out:
            yield frame(out)


def spread_out(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` shuffled by key into as many tasks as shuffles have: adaptive execution joins small partitions, also where a row is much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stream_groups(rows: DataFrame, keys: list[str], order: list, func, schema: str, spread: bool = False) -> DataFrame:
    """What ``func`` makes of the rows of each key, ``keys`` first in them, in order; nulls are a key.  One shuffle by key, with ``spread`` that of :func:`spread_out`."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    rows = spread_out(rows, *keys) if spread else rows.repartition(*keys)
    return rows.sortWithinPartitions(*keys, *order).mapInArrow(GroupStream(len(keys), func, arrow), schema)


class OrderedFold:
    """For ``mapInPandas`` over rows sorted by key and order: a value for each row from what came before it within its key.

    ``start`` makes the state of a key, ``step(state, *values)`` gives the next state and the value
    of the row.  Only the state is held, so a key of any length streams through.
    """

    def __init__(self, key: str, inputs: list[str], out: str, start, step):
        self.key, self.inputs, self.out, self.start, self.step = key, inputs, out, start, step

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            values = []
            for k, *v in zip(batch[self.key], *(batch[c] for c in self.inputs), strict=True):
                if state is None or k != key:
                    key, state = k, self.start()
                state, value = self.step(state, *v)
                values.append(value)
            yield batch.assign(**{self.out: pd.Series(values, index=batch.index, dtype="int32")})


def ordered_fold(rows: DataFrame, key: str, order: list[str], inputs: list[str], out: str, start, step) -> DataFrame:
    """``rows`` with the integer ``out`` of a fold over the rows of each key in order; one shuffle by key."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.IntegerType())])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(OrderedFold(key, inputs, out, start, step), schema)


def span_capped_sessions(rows: DataFrame, key: str, at: str, gap: float, span: float) -> DataFrame:
    """``rows`` with session: a row joins the open session if it is at most ``gap`` after the last and ``span`` after the first.

    The span rule depends on where the session began, so it is a fold over the ordered times of a key.
    """

    def step(state, t):
        first, last, session = state
        if first is None or t - last > gap or t - first > span:
            first, session = t, session + 1
        return (first, t, session), session

    return ordered_fold(rows, key, [at], [at], "session", lambda: (None, None, 0), step)


def bridged_sessions(rows: DataFrame, key: str, index: str, selected: str, group: str, start: str, end: str, bridge: float) -> DataFrame:
    """The selected rows with event: consecutive selected rows of one group with at most one row between, of the same group and at most ``bridge`` long."""
    w = Window.partitionBy(key).orderBy(index)
    rows = rows.withColumns({"_len": F.col(end) - F.col(start), "_group1": F.lag(group).over(w), "_len1": F.lag(F.col(end) - F.col(start)).over(w)})
    kept = rows.where(selected)
    back = F.lag(F.struct(index, group)).over(w)
    step = F.col(index) - back[index]
    same = F.col(group) == back[group]
    bridged = (F.col("_group1") == F.col(group)) & (F.col("_len1") <= bridge)
    joined = same & ((step == 1) | ((step == 2) & bridged))
    return kept.withColumn("event", islands(key, [index], ~joined)).drop("_len", "_group1", "_len1")


def fill_between_equal(rows: DataFrame, key: str, order: str, value: str, score: str, start: str, end: str, gap: float) -> DataFrame:
    """``rows`` with ``value`` and ``score`` filled where null, if the nearest known values on both sides are equal and at most ``gap`` apart."""
    w = Window.partitionBy(key).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(score).alias("s"), F.col(start).alias("t0"), F.col(end).alias("t1")))
    before, after = F.last(known, True).over(w.rowsBetween(*BEFORE)), F.first(known, True).over(w.rowsBetween(*AFTER))
    fill = F.col(value).isNull() & (before["v"] == after["v"]) & (after["t0"] - before["t1"] <= gap)
    out = rows.withColumns({"_fill": F.coalesce(fill, F.lit(False)), "_b": before, "_a": after})
    return out.withColumns(
        {value: F.when(F.col("_fill"), F.col("_b")["v"]).otherwise(F.col(value)), score: F.when(F.col("_fill"), F.least(F.col("_b")["s"], F.col("_a")["s"])).otherwise(F.col(score)), "interpolated": F.col("_fill")}
    ).drop("_fill", "_b", "_a")


def nearest_where(rows: DataFrame, key: str, order: list[str], pred: Column, value: str | Column, before: str, after: str) -> DataFrame:
    """``rows`` with the nearest ``value`` before and after among the rows where ``pred`` holds."""
    w = Window.partitionBy(key).orderBy(*order)
    v = F.when(pred, value if isinstance(value, Column) else F.col(value))
    return rows.withColumns({before: F.last(v, True).over(w.rowsBetween(*BEFORE)), after: F.first(v, True).over(w.rowsBetween(*AFTER))})


def context(rows: DataFrame, key: str, order: list[str], value: str, radius: int) -> DataFrame:
    """``rows`` with the ``radius`` values before and after, in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"before": F.collect_list(value).over(w.rowsBetween(-radius, -1)), "after": F.collect_list(value).over(w.rowsBetween(1, radius))})


def even_sample(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """``k`` evenly spaced rows of each key (all, if there are no more): positions round(i * (n - 1) / (k - 1)), halves to even."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"_n": F.count("*").over(w), "_at": F.row_number().over(w.orderBy(*order)) - 1})
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / max(1, k - 1)).cast("int"))
    return ranked.where((F.col("_n") <= k) | F.array_contains(steps, F.col("_at"))).drop("_n", "_at")


def priority_selection(parts: list[DataFrame], key: str, item: str, orders: list[list[str]], most: int) -> DataFrame:
    """Union of ``parts`` by priority, each in its own order; the first mention of an item wins; ``most`` items of each key.

    Returns key, item and admitted (1-based order of admission).
    """
    ranked = None
    for i, (part, order) in enumerate(zip(parts, orders, strict=True)):
        r = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        part = part.select(key, item, F.struct(F.lit(i).alias("part"), r.alias("rank")).alias("priority"))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = ranked.groupBy(key, item).agg(F.min("priority").alias("priority"))
    w = Window.partitionBy(key).orderBy("priority")
    return first.withColumn("admitted", F.row_number().over(w)).where(F.col("admitted") <= most).drop("priority")


def round_robin(rows: DataFrame, key: str, bucket: str, order: list[str], k: int) -> DataFrame:
    """``k`` rows of each key, one of each bucket in turn, buckets by name."""
    turn = F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order))
    out = rows.withColumn("_turn", turn)
    place = F.row_number().over(Window.partitionBy(key).orderBy("_turn", bucket))
    return out.withColumn("taken", place).where(F.col("taken") <= k).drop("_turn")


def proportional_quotas(counts: dict[str, int], target: int) -> dict[str, int]:
    """Quota of each cell: the floor of its share, at least 1 if the target allows, filled and reduced by the largest remainder.

    Cells are few and known on the driver; ties go to the larger count, then to the earlier cell.
    """
    cells = [c for c, n in counts.items() if n > 0]
    total = sum(counts[c] for c in cells)
    if not cells:
        return {}
    target = min(target, total)
    ideal = {c: target * counts[c] / total for c in cells}
    least = 1 if target >= len(cells) else 0
    quota = {c: min(counts[c], max(least, int(ideal[c]))) for c in cells}
    place = {c: i for i, c in enumerate(cells)}
    while sum(quota.values()) < target:
        c = max((c for c in cells if quota[c] < counts[c]), key=lambda c: (ideal[c] - quota[c], counts[c], -place[c]))
        quota[c] += 1
    while sum(quota.values()) > target:
        c = min((c for c in cells if quota[c] > least), key=lambda c: (ideal[c] - quota[c], counts[c]))
        quota[c] -= 1
    return quota


def stratified_pilot(rows: DataFrame, cell: str, bucket: str, order: list[str], target: int) -> DataFrame:
    """``target`` rows with a quota for each cell, within a cell one of each bucket in turn; the rest is filled in order."""
    found = rows.groupBy(cell).count().orderBy(cell).limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells to sample from")
    counts = {r[cell]: r["count"] for r in found}
    quotas = proportional_quotas(counts, target)
    spark = rows.sparkSession
    table = spark.createDataFrame(list(quotas.items()) or [(None, 0)], f"{cell} {rows.schema[cell].dataType.simpleString()}, quota int")
    turn = F.row_number().over(Window.partitionBy(cell, bucket).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(cell).orderBy("_turn", bucket))
    return rows.withColumn("_turn", turn).withColumn("_place", place).join(F.broadcast(table), cell).where("_place <= quota").drop("_turn", "_place", "quota")


def greedy_packing(rows: DataFrame, key: str, order: str, cost: str, most_cost: int, most_rows: int) -> DataFrame:
    """``rows`` with pack (from 0): rows in order go to the open pack until its cost or number would pass the limit.

    What fits depends on the whole pack before it: a fold over the ordered rows of a key.  A
    single row above the limit is an error.
    """

    def step(state, c):
        total, n, pack = state
        if c > most_cost:
            raise ValueError("a single row is above the limit")
        if total + c > most_cost or n >= most_rows:
            total, n, pack = 0, 0, pack + 1
        return (total + c, n + 1, pack), pack

    return ordered_fold(rows, key, [order], [cost], "pack", lambda: (0, 0, 0), step)


def frame_times(rows: DataFrame, key: str, frame: str, pts: str, variable: str, rate: float) -> DataFrame:
    """``rows`` with starts and ends (exclusive): of the timeline where ``variable`` holds, else frame / rate; the last frame of a timeline lasts 1 / rate."""
    after = F.lead(pts).over(Window.partitionBy(key).orderBy(frame))
    starts = F.when(F.col(variable), F.col(pts)).otherwise(F.col(frame) / rate)
    ends = F.when(F.col(variable), F.coalesce(after, F.col(pts) + 1 / rate)).otherwise((F.col(frame) + 1) / rate)
    return rows.withColumns({"starts": starts, "ends": ends})


def split_long(events: DataFrame, key: list[str], most: float) -> DataFrame:
    """Members (key, index, start, end, score) with part: an event longer than ``most`` is cut where the smaller neighbouring score is least.

    Ties go to the cut nearest the middle, then to the first.  Cuts depend on cuts before, so each
    event - some rows - is done in one piece.
    """
    schema = ", ".join([*(f"{k} {events.schema[k].dataType.simpleString()}" for k in key), "index long, start double, end double, score double, part int"])
    columns = [F.col("index").cast("long"), *(F.col(c).cast("double") for c in ("start", "end", "score"))]
    return stream_groups(events.select(*key, *columns), key, ["index"], partial(_cut, most, len(key)), schema)


def _cut(most: float, keys: int, rows: list[tuple]) -> list[tuple]:
    nan = float("nan")
    start, end, score = ([nan if r[keys + k] is None else r[keys + k] for r in rows] for k in (1, 2, 3))
    todo, done = [(0, len(rows))], []
    while todo:
        a, b = todo.pop()
        span = max((e for e in end[a:b] if e == e), default=nan) - start[a]
        if span <= most or b - a == 1:
            done.append((a, b))
            continue
        middle = (start[a] + end[b - 1]) / 2
        best = min(range(a + 1, b), key=lambda i: (min(score[i - 1], score[i]), abs(start[i] - middle), i))
        todo += [(best, b), (a, best)]
    return [(*r, n) for n, (a, b) in enumerate(sorted(done)) for r in rows[a:b]]
