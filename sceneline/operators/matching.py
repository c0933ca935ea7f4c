"""Containment and retrieval joins between spoken lines and script blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containment_join(lines: DataFrame, blocks: DataFrame, keys: list[str], line_id: str, block_id: str, toks: str = "tokens") -> DataFrame:
    """All places where a line's token array stands in a block's: keys, line_id, block_id, token_start.

    Pruned by an equality join on the line's rarest token, which comes with its positions on both
    sides: each tells the one place of the line that can go with it, so a pair costs one comparison
    of arrays.  Of the blocks only tokens of some line are shuffled; how often they stand in blocks
    is summed before the shuffle.  Whole arrays come in last, for the pairs that are left.
    """
    own = lines.select(*keys, line_id, F.explode(F.array_distinct(toks)).alias("_t"))
    posts = blocks.select(*keys, block_id, F.posexplode(toks).alias("_p", "_t")).join(own.select(*keys, "_t").distinct(), [*keys, "_t"], "left_semi")
    rare = posts.groupBy(*keys, "_t").agg(F.count("*").alias("_df"))
    n = F.size(F.array_distinct(toks)).alias("_n")
    heads = own.join(rare, [*keys, "_t"]).groupBy(*keys, line_id).agg(F.min(F.struct("_df", "_t")).alias("_m"), F.count("*").alias("_found"))
    heads = heads.join(lines.select(*keys, line_id, n, F.col(toks).alias("_needle")), [*keys, line_id]).where("_found = _n")  # a line with a token of no block is nowhere
    heads = heads.select(*keys, line_id, F.col("_m._t").alias("_t"), "_needle", (F.array_position("_needle", F.col("_m._t")) - 1).cast("int").alias("_at"))
    hays = blocks.select(*keys, block_id, F.col(toks).alias("_hay"))
    pairs = heads.join(posts, [*keys, "_t"]).withColumn("token_start", F.col("_p") - F.col("_at")).where("token_start >= 0").join(hays, [*keys, block_id])
    found = pairs.where(F.slice("_hay", F.col("token_start") + 1, F.size("_needle")) == F.col("_needle"))
    return found.select(*keys, line_id, block_id, "token_start", F.size("_needle").alias("line_tokens"), F.size("_hay").alias("block_tokens"))


def unique_places(found: DataFrame, keys: list[str], line_id: str) -> DataFrame:
    """The places of the lines that have exactly one, counting positions."""
    w = Window.partitionBy(*keys, line_id)
    return found.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_n")


def overlap_top_k(lines: DataFrame, blocks: DataFrame, keys: list[str], line_id: str, block_id: str, toks: str, k: int, least: int = 2) -> DataFrame:
    """For each line the ``k`` blocks that share most distinct tokens with it: share = shared / distinct tokens of the line that stand in some block.

    An inverted-index join on all tokens: of the blocks only tokens of some line are shuffled, and
    shared tokens are counted before the second shuffle.  A frequent token is a skewed key of a
    plain join, which adaptive execution splits.  Ties go to the smaller block id.
    """
    line = lines.select(*keys, line_id, F.explode(F.array_distinct(toks)).alias("_t"))
    b = blocks.select(*keys, block_id, F.explode(F.array_distinct(toks)).alias("_t")).join(line.select(*keys, "_t").distinct(), [*keys, "_t"], "left_semi")
    size = line.join(b.select(*keys, "_t").distinct(), [*keys, "_t"], "left_semi").groupBy(*keys, line_id).agg(F.count("*").alias("_n"))
    shared = line.join(b, [*keys, "_t"]).groupBy(*keys, line_id, block_id).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    scored = shared.join(size, [*keys, line_id]).withColumn("score", F.col("shared") / F.col("_n")).drop("_n")
    w = Window.partitionBy(*keys, line_id).orderBy(F.desc("score"), block_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
