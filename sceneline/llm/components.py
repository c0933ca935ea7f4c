"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneline.llm.common import cut, materialize

MAX_ROUNDS = 40
#: Links of a partition, at least: a few links are not worth many small shuffle files.
PART = 250_000


def _large(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(2 * parts))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, parts: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them; edges point from larger to smaller."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of ``links`` (a, b: long) but the roots; root is the least node of the component.

    A node with very many links costs no more than its links: minima are aggregated before the
    shuffle and the joins can be split.  Each step is checkpointed, so a lost executor repeats one;
    its partitions are as many as its links need, and there are never more links than at first.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before or now[0] == 0:
            return edges.select("u", F.col("v").alias("root"))
        before, parts = now, -(-now[0] // PART)
        large = cut(_large(edges, parts).coalesce(parts))
        edges = cut(_small(large, parts).coalesce(parts))
    raise RuntimeError(f"components: not settled after {MAX_ROUNDS} rounds")
