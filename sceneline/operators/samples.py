"""Samples for review: strata in order of priority, each item once, spread over scenes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stratum:
    """Up to ``limit`` items that meet ``condition``, in ``order``."""

    label: str
    condition: Column
    order: tuple[Column, ...]
    limit: int


def spread(condition: Column, key: str, scene: str, time: list[str], order: list[str]) -> tuple[Column, ...]:
    """An order in which the first row in time of every scene comes before all others; those follow in ``order``.  A null scene is one scene."""
    first = F.row_number().over(Window.partitionBy(key, condition, scene).orderBy(*time, *order)) == 1
    return (~first, *[F.when(first, F.col(c)) for c in time], *map(F.col, order))


def shuffled(seed: str, key: str, item: str) -> Column:
    """A random order of the items of a key that is the same in every run."""
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(key).cast("string"), F.col(item).cast("string")), 256)


def take_unique(rows: DataFrame, key: str, item: str, strata: list[Stratum], total: int) -> DataFrame:
    """``key``, ``item``, stratum and ordinal (from 1) of the sample of each key.

    Stratum after stratum takes its first items that no earlier one has taken, and the sample ends
    at ``total``.  Ties in an order go to the smaller item; an item that is repeated counts once,
    a null item or condition never.  Only the items that a stratum can come to are
    gathered: its limit and those of all before it.
    """
    fields, reach, known = [], 0, F.col(item).isNotNull()
    rows = rows.repartition(key)
    for k, s in enumerate(strata):
        reach += s.limit
        met = F.coalesce(s.condition & known, F.lit(False))
        rows = rows.withColumn(f"_met{k}", met).withColumn(f"_first{k}", F.row_number().over(Window.partitionBy(key, f"_met{k}", item).orderBy(*s.order)) == 1)
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(f"_met{k}"), F.desc(f"_first{k}"), *s.order, item))
        rows = rows.withColumn(f"_place{k}", place)
        reached = F.col(f"_met{k}") & F.col(f"_first{k}") & (F.col(f"_place{k}") <= reach)
        fields.append(F.when(reached, F.struct(F.lit(k).alias("k"), F.col(f"_place{k}").alias("place"), F.col(item).alias("item"))))
    asked = rows.select(key, F.explode(F.array_compact(F.array(*fields))).alias("a"))
    limits = F.array(*[F.lit(s.limit) for s in strata])
    kind = asked.schema["a"].dataType.simpleString()

    def add(taken, a):
        had = F.exists(taken, lambda t: t["item"] == a["item"]) | (F.size(F.filter(taken, lambda t: t["k"] == a["k"])) >= F.get(limits, a["k"]))
        return F.when(had, taken).otherwise(F.concat(taken, F.array(a)))

    sample = asked.groupBy(key).agg(F.array_sort(F.collect_list("a")).alias("a"))  # by stratum and place; as many as all limits allow
    sample = sample.select(key, F.posexplode(F.slice(F.aggregate("a", F.array().cast(f"array<{kind}>"), add), 1, total)).alias("n", "t"))
    labels = F.array(*[F.lit(s.label) for s in strata])
    return sample.select(key, F.col("t.item").alias(item), F.get(labels, F.col("t.k")).alias("stratum"), (F.col("n") + 1).alias("ordinal"))
