"""Review requests: candidate intervals, grouping, limits and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_interval(left: Column, right: Column, total: Column, left_scene: Column, right_scene: Column, elapsed: Column, window: int = 120, one_sided: int = 240) -> Column:
    """(low, high, reason, fallback) in block orders (inclusive) between the anchors ``left`` and ``right``; null where there is none."""
    centre = F.rint(elapsed * (total - 1)).cast("long")
    lo = lambda v: F.greatest(F.lit(0).cast("long"), v.cast("long"))
    hi = lambda v: F.least(total.cast("long") - 1, v.cast("long"))
    make = lambda a, b, r, f: F.struct(a.alias("low"), b.alias("high"), F.lit(r).alias("reason"), F.lit(f).alias("fallback"))
    none = F.lit(None).cast("long")
    return (
        F.when(total <= 0, make(none, none, "empty_screenplay", True))
        .when(left.isNull() & right.isNull(), make(lo(centre - window), hi(centre + window), "fallback_timeline_estimate", True))
        .when(left > right, make(lo(centre - window), hi(centre + window), "fallback_nonmonotonic_anchor_interval", True))
        .when(left.isNotNull() & right.isNotNull() & (F.abs(right_scene - left_scene) > 1), make(left.cast("long"), right.cast("long"), "fallback_between_reliable_anchors", True))
        .when(left.isNotNull() & right.isNotNull(), make(left.cast("long"), right.cast("long"), "between_reliable_anchors", False))
        .when(left.isNotNull(), make(left.cast("long"), hi(left + one_sided), "fallback_after_reliable_anchor", True))
        .otherwise(make(lo(right - one_sided), right.cast("long"), "fallback_before_reliable_anchor", True))
    )


def merge_candidates(rows: DataFrame, key: str, item: str, priority: str, score: str, order: str, most: int) -> DataFrame:
    """At most ``most`` items of each key: by priority, then score; the first mention of an item counts; back in their own order."""
    first = rows.groupBy(key, item).agg(F.min(F.struct(F.col(priority).alias("p"), (-F.col(score)).alias("s"), F.col(order).alias("o"))).alias("m"))
    kept = first.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("m.p", "m.s", "m.o", item))).where(F.col("_k") <= most)
    place = F.row_number().over(Window.partitionBy(key).orderBy("m.o", item))
    return kept.select(key, item, F.col("m.p").alias(priority), place.alias("place"))


def strata(automatic: Column, matches: Column, score: Column) -> Column:
    """difficult > multi > fuzzy > easy."""
    return F.when(matches == 0, "difficult").when(matches > 1, "multi").when(score < 0.82, "fuzzy").when(automatic, "easy").otherwise("fuzzy")


def region(mean_ordinal: Column, total: Column) -> Column:
    at = F.try_divide(mean_ordinal, total)
    return F.when(at < 1 / 3, "early").when(at < 2 / 3, "middle").otherwise("late")


def request_lines(requests: DataFrame, columns: list[str], model: str) -> DataFrame:
    """One JSON line for each request, with its payload embedded as text."""
    body = F.struct(F.lit(model).alias("model"), F.to_json(F.struct(*columns)).alias("input"))
    return requests.select(F.to_json(F.struct(F.col("request_id").cast("string").alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("line"))
