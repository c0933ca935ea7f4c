"""Constraint queries: each rule returns the rows that break it as (rule, key, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_rules(rows: DataFrame, key: Column, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Violations of rules on single rows: name to (condition that breaks it, message).  One pass for all rules."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("rule"), m.cast("string").alias("message"))) for n, (bad, m) in rules.items()]))
    return rows.select(key.cast("string").alias("key"), F.explode(found).alias("v")).select("v.rule", "key", "v.message")


def unique(rows: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return n.select(F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("key"), F.concat(F.lit("repeated "), F.col("n").cast("string"), F.lit(" times")).alias("message"))


def references(rows: DataFrame, rule: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    lost = rows.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return lost.groupBy(key).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.concat(F.lit("unknown, "), F.col("n").cast("string"), F.lit(" rows")).alias("message"))


def contiguous(rows: DataFrame, rule: str, group: str, order: str, start: str, end: str) -> DataFrame:
    """Half-open ranges that do not begin where the one before ends."""
    before = F.lag(end).over(Window.partitionBy(group).orderBy(order))
    bad = rows.withColumn("_b", before).where(F.col(start) != F.col("_b"))
    kind = F.when(F.col(start) > F.col("_b"), "gap").otherwise("overlap")
    return bad.select(F.lit(rule).alias("rule"), F.concat_ws(":", F.col(group).cast("string"), F.col(order).cast("string")).alias("key"), kind.alias("message"))


def sums_to_one(rows: DataFrame, rule: str, keys: list[str], share: str, tolerance: float = 1e-5) -> DataFrame:
    s = rows.groupBy(*keys).agg(F.sum(share).alias("s")).where(F.abs(F.col("s") - 1) > tolerance)
    return s.select(F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("key"), F.format_string("sum %.4f", "s").alias("message"))


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require_none(found: DataFrame) -> DataFrame:
    """``found`` if it is empty; a row of it fails the query."""
    return found.withColumn("rule", F.when(F.lit(True), F.raise_error(F.concat_ws(" ", "rule", "key", "message"))))
