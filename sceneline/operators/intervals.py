"""Joins of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], bin_sec: float, names: tuple[str, str, str, str] = ("start", "end", "sub_start", "sub_end")) -> DataFrame:
    """Pairs of ``left`` and ``right`` with equal ``keys`` whose intervals overlap, with the overlap.

    An inequality join would be a nested loop.  Instead both sides are listed in each bin of
    ``bin_sec`` that they touch and joined on (keys, bin); a pair is kept only in the bin in
    which its overlap begins, so it appears once and no distinct is needed.  Empty and reversed
    intervals overlap with nothing; ``bin_sec`` should be about the usual length.
    """
    a0, a1, b0, b1 = map(F.col, names)
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bin_sec), F.floor(hi / bin_sec)))
    x = left.where(a1 > a0).withColumn("_bin", bins(a0, a1))
    y = right.where(b1 > b0).withColumn("_bin", bins(b0, b1))
    shared = overlap(a0, a1, b0, b1)
    first = F.floor(F.greatest(a0, b0) / bin_sec)
    return x.join(y, [*keys, "_bin"]).where((shared > 0) & (F.col("_bin") == first)).withColumn("overlap", shared).drop("_bin")


def evidence_share(overlaps: DataFrame, item: list[str], group: str, order: str) -> DataFrame:
    """For each item and group: summed overlap, its share of the item's sum (0 if the sum is 0), and whether it is the best.

    The best has the largest sum, ties to the smaller ``order``.
    """
    from pyspark.sql import Window

    sums = overlaps.groupBy(*item, group).agg(F.sum("overlap").alias("score"), F.min(order).alias("_order"))
    w = Window.partitionBy(*item)
    total = F.sum("score").over(w)
    best = F.row_number().over(w.orderBy(F.desc("score"), "_order", group)) == 1
    return sums.withColumns({"share": F.when(total > 0, F.col("score") / total).otherwise(F.lit(0.0)), "best": best}).drop("_order")


def min_distance_join(rows: DataFrame, seeds: DataFrame, keys: list[str], at: str, seed_at: str, radius: int) -> DataFrame:
    """``rows`` within ``radius`` of a seed with the same keys, with the least distance; an equality join on neighbouring cells."""
    width = radius + 1
    near = seeds.select(*keys, F.col(seed_at).alias("_s")).withColumn("_cell", F.explode(F.sequence(F.floor((F.col("_s") - radius) / width), F.floor((F.col("_s") + radius) / width)))).distinct()
    hit = rows.withColumn("_cell", F.floor(F.col(at) / width)).join(near, [*keys, "_cell"]).where(F.abs(F.col(at) - F.col("_s")) <= radius)
    names = [F.col(c) for c in rows.columns]
    return hit.groupBy(*names).agg(F.min(F.abs(F.col(at) - F.col("_s"))).alias("distance"))
