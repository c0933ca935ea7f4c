"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources are cut into hash blocks.  From its target each source gets a quota:
whole copies of all its blocks, then the first blocks of a permutation, then a
part of one more block.  The exact quotas, in block copies, are divided among
the output shards by a tree: at each node a random half of the block copies -
a multivariate-hypergeometric draw of the quotas of all sources - goes left.
Each shard then draws its quota of each source from a second permutation of
that source's block copies, so the draws are disjoint; within a shard the
documents are shuffled: each draw has a place, and the mix is in the order of
shard and place.  What is taken of a document is the sum of its draws.

Everything is DataFrame expressions.  Documents are aggregated to at most
``BLOCKS`` rows of a source before any window, so a source with a third of all
rows is as good as any other.  The half of a node is found by a histogram of
random keys, so no window holds all block copies.  What documents are joined
with has a row for each source or block and is broadcast only below a checked
size.  All randomness is a hash of ids and the seed, so a rerun, or a task run
again after an executor is lost, gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneline.llm.common import checked_broadcast, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order (nulls last), repeating.
WEIGHTS = (1, 2, 3)
#: No source, and no document, is taken more often than this.
MAX_COPIES = 3
#: Blocks of a source and of the block at which its quota ends.
BLOCKS, SUB_BLOCKS = 256, 1024
#: Levels of the tree; 2 ** LEVELS shards.
LEVELS = 4
#: Classes of the histogram by which a node is halved.
CLASSES = 1024


def _hash(seed: int, salt: int, *cols: str | Column) -> Column:
    return F.xxhash64(F.lit(seed * 1000 + salt), *cols)


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """A row for each of ``docs``: ``row`` (all its columns), source key (null last), size in words and the hashes that place it."""
    doc_id = F.col("row.doc_id")
    return docs.select(F.struct(*docs.columns).alias("row")).select(
        "row",
        F.when(F.col("row.source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "row.source")).alias("_sk"),
        F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.pmod(_hash(seed, 1, doc_id), F.lit(BLOCKS)).cast("int").alias("_block"),
        F.pmod(_hash(seed, 2, doc_id), F.lit(SUB_BLOCKS)).cast("int").alias("_sub"),
        _hash(seed, 3, doc_id).alias("_leaf"),
        doc_id.alias("_id"),
    )


def targets(sources: DataFrame) -> DataFrame:
    """_sk, source_size, target of each source from (_sk, source_size); one row for each source.

    Targets are min(3 x size, level x weight), with the level at which they add up to the
    total: what resharing the excess by weight comes to.
    """
    n = F.row_number().over(Window.orderBy("_sk")) - 1
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        sources.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), n % len(WEIGHTS) + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * float(MAX_COPIES))
        .withColumn("r", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
    )
    order = Window.orderBy("r", "_sk")
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("level", (F.col("total") - F.col("before")) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "_sk", "level"))).over(every)["level"])
    return t.select("_sk", "source_size", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def _end(parts: DataFrame, place: str, size: str, rest: str) -> DataFrame:
    """Of each source, the place in which its quota ends and what is left of the quota there."""
    w = Window.partitionBy("_sk").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = parts.withColumn("_cum", F.sum(size).over(w))
    return cum.where(f"_cum - {size} <= {rest} AND {rest} < _cum AND {size} > 0").select(
        "_sk", F.col(place).alias(f"end{place}"), (F.col(rest) - F.col("_cum") + F.col(size)).alias("_rest"), F.col(size).alias("_in_end")
    )


def tree(units: DataFrame, seed: int, levels: int = LEVELS) -> DataFrame:
    """(_sk, _at, shard): the places (_sk, _at) of all quotas, halved at each node of the tree at random.

    Of a node's n places those with the floor(n / 2) smallest random keys go left (one more if a
    coin says so and n is odd): a histogram tells in which class of keys the half ends, and only
    the places of that class are ranked.
    """
    nodes = units.select("_sk", "_at", F.lit(0).alias("shard"))
    for level in range(levels):
        key = _hash(seed, 10 + level, "_sk", "_at")
        nodes = nodes.withColumn("_key", key).withColumn("_class", F.pmod(F.shiftright("_key", 20), F.lit(CLASSES)).cast("int"))
        count = nodes.groupBy("shard", "_class").agg(F.count("*").alias("n"))
        upto = Window.partitionBy("shard").orderBy("_class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = Window.partitionBy("shard").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        odd = F.pmod(_hash(seed, 50 + level, "shard"), F.lit(2))  # which child gets the one that is over
        count = count.withColumns({"cum": F.sum("n").over(upto), "half": F.floor((F.sum("n").over(every) + odd) / 2)})
        half = count.where("cum - n <= half AND half < cum").select("shard", F.col("_class").alias("_end"), (F.col("half") - F.col("cum") + F.col("n")).alias("_rest"))
        half = materialize(half, "mix-half")  # a row for each node; a node whose left child takes all has none
        nodes = nodes.join(checked_broadcast(half), "shard", "left").withColumn("_mine", F.col("_class") == F.col("_end"))
        rank = F.row_number().over(Window.partitionBy("shard", "_mine").orderBy("_key", "_sk", "_at"))
        ended = nodes.where("_mine").withColumn("left", rank <= F.col("_rest"))
        other = nodes.where("_mine IS NULL OR NOT _mine").withColumn("left", F.coalesce(F.col("_class") < F.col("_end"), F.lit(True)))
        child = (F.col("shard") * 2 + F.when(F.col("left"), 0).otherwise(1)).cast("int").alias("shard")
        nodes = materialize(ended.unionByName(other).select("_sk", "_at", child), "mix-tree")
    return nodes


def plan(sizes: DataFrame, seed: int, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """From rows (_sk, _size, _block, _sub, _leaf): a row for each source, and the shards of each block's copies."""
    blocks = materialize(sizes.groupBy("_sk", "_block").agg(F.sum("_size").alias("_size"), F.count("*").alias("_rows")), "mix-blocks")
    sources = targets(blocks.groupBy("_sk").agg(F.sum("_size").alias("source_size")))
    sources = (
        sources.withColumn("_quota", F.least(F.round("target").cast("long"), F.col("source_size") * MAX_COPIES))
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("_quota div source_size")).otherwise(F.lit(0)).cast("int"))
        .withColumn("_rest", F.col("_quota") - F.col("_whole") * F.col("source_size"))
    )
    sources = materialize(sources, "mix-sources")
    small = checked_broadcast(sources)

    one = materialize(_end(blocks.join(small.select("_sk", "_rest"), "_sk"), "_block", "_size", "_rest"), "mix-end1")
    near = sizes.join(checked_broadcast(one), "_sk").where("_block = end_block")
    two = materialize(_end(near.groupBy("_sk", "_rest", "_sub").agg(F.sum("_size").alias("_size")), "_sub", "_size", "_rest"), "mix-end2")
    near = sizes.join(checked_broadcast(one.drop("_rest", "_in_end")), "_sk").where("_block = end_block").join(checked_broadcast(two), "_sk").where("_sub = end_sub")
    three = _end(near.groupBy("_sk", "_rest", "_leaf").agg(F.sum("_size").alias("_size")), "_leaf", "_size", "_rest")
    ends = one.select("_sk", "end_block").join(two.select("_sk", "end_sub"), "_sk", "left").join(three, "_sk", "left")
    ends = materialize(ends.withColumnsRenamed({"_rest": "_num", "_in_end": "_den"}), "mix-ends")
    sources = sources.join(checked_broadcast(ends), "_sk", "left")

    # Copies of blocks; the last copy holds only the blocks up to the one in which the quota ends.
    quota = blocks.where("_rows > 0").join(checked_broadcast(sources.select("_sk", "_whole", "end_block", "_rest")), "_sk")
    copies = F.col("_whole") + F.when((F.col("_rest") > 0) & (F.col("_block") <= F.col("end_block")), 1).otherwise(0)
    units = quota.withColumn("n", copies).where("n > 0").select("_sk", "_block", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    units = materialize(units.withColumn("_at", F.row_number().over(Window.partitionBy("_sk").orderBy(_hash(seed, 4, "_sk", "_block", "copy"), "_block", "copy"))), "mix-units")
    # The tree deals out places 1..quota of each source to the shards: a quota for each shard and source.
    quotas = tree(units, seed, levels).groupBy("_sk", "shard").agg(F.count("*").alias("quota"))
    last = F.sum("quota").over(Window.partitionBy("_sk").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Each shard draws its quota from the permuted block copies of the source, after the shards before it.
    runs = quotas.withColumn("last", last).select("_sk", "shard", F.explode(F.sequence(F.col("last") - F.col("quota") + 1, "last")).alias("_at"))
    shards = units.join(runs, ["_sk", "_at"]).groupBy("_sk", "_block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("_copies"))
    return materialize(sources, "mix-plan"), materialize(shards, "mix-shards")


def with_draws(placed: DataFrame, sizes: DataFrame, seed: int, levels: int) -> DataFrame:
    """``placed`` (as by :func:`sized`) with source_size, target, taken and draws: array of (copy, shard, words, place)."""
    sources, shards = plan(sizes, seed, levels)
    found = placed.join(checked_broadcast(sources), "_sk", "left").join(checked_broadcast(shards, weight=F.size("_copies")), ["_sk", "_block"], "left")
    part = F.expr("CASE WHEN _leaf < end_leaf THEN _size WHEN _leaf = end_leaf THEN (_size * _num) div _den ELSE 0L END")
    part = F.when(F.col("_sub") < F.col("end_sub"), F.col("_size")).when(F.col("_sub") == F.col("end_sub"), part).otherwise(F.lit(0))
    part = F.when(F.col("_block") < F.col("end_block"), F.col("_size")).when(F.col("_block") == F.col("end_block"), part).otherwise(F.lit(0))
    found = found.withColumn("_part", F.when(F.col("_rest") > 0, part).otherwise(F.lit(0)).cast("long"))
    draw = lambda c: F.struct(
        c["copy"].alias("copy"),
        c["shard"].alias("shard"),
        F.when(c["copy"] <= F.col("_whole"), F.col("_size")).otherwise(F.col("_part")).alias("words"),
        _hash(seed, 90, c["shard"], c["copy"], "_id").alias("place"),
    )
    draws = F.filter(F.transform(F.coalesce("_copies", F.array()), draw), lambda d: d["words"] > 0)
    found = found.withColumn("draws", draws)
    return found.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))


def mix(docs: DataFrame, seed: int = 1, levels: int = LEVELS) -> DataFrame:
    """doc_id, size, source_size, target, taken and draws (copy, shard, words, place) of every row of ``docs``.

    A null text has size 0 and is never taken.  Null is a source of its own, after all others.
    Rows with the same doc_id fall in the same block; if a quota ends at them, they share what
    is left by their size.  Other columns are ignored; an empty table gives an empty result.
    """
    sizes = materialize(sized(docs.select("doc_id", "source", "text"), seed).drop("row"), "mix-sizes")  # words are counted once
    found = with_draws(sizes, sizes, seed, levels)
    return found.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken", "draws")


def mixed_documents(docs: DataFrame, seed: int = 1, levels: int = LEVELS) -> DataFrame:
    """The mix itself, shard by shard, each shuffled: a row of ``docs`` for each time it is drawn; of a part, the first words of its text.

    Rows come in the order of shard and place.  Nulls, ties and repeated rows are as in
    :func:`mix`; all columns of ``docs`` stay as they are (``text``, and ``n_chars`` if there, follow
    a part), whatever their names; an empty table gives an empty result.
    """
    placed = sized(docs, seed)
    sizes = materialize(placed.drop("row"), "mix-sizes")
    found = with_draws(placed, sizes, seed, levels).select("row", "_size", F.explode("draws").alias("draw"))
    part = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("draw.words").cast("int")), " ")
    text = F.when(F.col("draw.words") < F.col("_size"), part).otherwise(F.col("row.text"))
    found = found.withColumn("text", text).orderBy("draw.shard", "draw.place", "row.doc_id")
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
