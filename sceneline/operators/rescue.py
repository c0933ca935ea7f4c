"""Candidates from a whole script for lines that a request's own window does not settle.

Every line of a request is searched in all dialogue of its film.  Dialogue is
cut into tiles and the lines of a film into parts, both of bounded size; lines
stream past a tile, which compares a line only with the texts that its bounds
let through (see :class:`sceneline.functions.evidence.Dialogue`).  A tile gives
the best two blocks of a line, and those of all tiles are merged, so nothing
grows with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneline.functions.evidence import VERSIONS, Dialogue
from sceneline.operators.sequences import spread_out

#: Blocks of a tile, and lines of a part, about.
TILE, PART = 4096, 16_384
#: Blocks kept of a line; what an anchor near by adds to the rank, and how near that is.
PER_LINE, ANCHOR_BONUS, ANCHOR_REACH = 2, 0.12, 8
#: A target's hit ranks above a neighbour's by this.
TARGET_BONUS = 0.1
TARGET, NEARBY = "target_subtitle", "nearby_subtitle_context"

_FOUND = "movie_key string, request_id long, line long, source string, block long, score double, selection double, method string"


class SearchTiles:
    """For ``mapInPandas`` over rows sorted by film, tile and part, blocks before lines."""

    def __init__(self, version: str):
        self.version = version

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held, dialogue, known = None, [], None, {}
        for batch in batches:
            for own, rows in batch.groupby(["movie_key", "tile", "part"], sort=False):
                if own != name:
                    name, held, dialogue, known = own, [], None, {}
                asks = rows["request_id"].notna().to_numpy()
                blocks = rows[~asks]
                held += [(int(n), tuple(t)) for n, t in zip(blocks["block"], blocks["tokens"], strict=True)]
                if asks.any():
                    dialogue = dialogue or Dialogue(held)
                    found = [hit for r in rows[asks].itertuples() for hit in self.best(dialogue, known, r)]
                    if found:
                        yield pd.DataFrame(found, columns=["movie_key", "request_id", "line", "source", "block", "score", "selection", "method"])

    def best(self, dialogue: Dialogue, known: dict, r) -> list[tuple]:
        words = tuple(r.tokens)
        if words not in known:
            known[words] = dialogue.search(words, self.version)
        own, anchors = set(r.existing), list(r.anchors) if self.version == "v4" else []
        hits = []
        for score, method, text in known[words]:
            for block in dialogue.numbers[text]:
                if block not in own:
                    near = bool(anchors) and min(abs(block - a) for a in anchors) <= ANCHOR_REACH
                    hits.append((-(score + ANCHOR_BONUS * near), -score, block, method))
        return [(r.movie_key, int(r.request_id), int(r.line), r.source, block, -score, -selection, method) for selection, score, block, method in sorted(hits)[:PER_LINE]]


class FuzzyTiles(SearchTiles):
    """The best block of each line by the fuzzy score alone."""

    def best(self, dialogue: Dialogue, known: dict, r) -> list[tuple]:
        words = tuple(r.tokens)
        if words not in known:
            known[words] = dialogue.best_fuzzy(words)
        score, block = known[words]
        return [(r.movie_key, int(r.request_id), int(r.line), r.source, block, score, score, "rapidfuzz")]


def best_fuzzy(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """movie_key, line, block, score: for each line (movie_key, line, tokens) the block of its film with the highest fuzzy score, rounded to six digits; ties to the smaller block."""
    none = F.array().cast("array<long>")
    asked = lines.select("movie_key", F.lit(0).cast("long").alias("request_id"), "line", F.lit(TARGET).alias("source"), "tokens", none.alias("existing"), none.alias("anchors"))
    return _tiled(asked, blocks, FuzzyTiles("")).where("place = 1").select("movie_key", "line", "block", "score")


def search_script(lines: DataFrame, blocks: DataFrame, version: str) -> DataFrame:
    """The best blocks of every line in its whole film, at most two: ``_FOUND`` and place (from 1).

    ``lines``: movie_key, request_id, line, source, tokens, existing (blocks that are not taken again), anchors
    (blocks of the request's anchors).  ``blocks``: movie_key, block (0, 1, ...), tokens.  Rows with null
    words or keys find nothing.  Ties go to the smaller block.
    """
    if version not in VERSIONS:
        raise ValueError(f"no such version: {version}")
    return _tiled(lines, blocks, SearchTiles(version))


def _tiled(lines: DataFrame, blocks: DataFrame, search: SearchTiles, most: int | None = PER_LINE) -> DataFrame:
    """What ``search`` finds for every line in the tiles of its film, the ``most`` best blocks of all tiles with their place (all with None)."""
    sizes = blocks.groupBy("movie_key").agg((F.floor(F.max("block") / TILE) + 1).cast("int").alias("tiles"))
    sizes = sizes.join(lines.groupBy("movie_key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "movie_key")
    part = F.pmod(F.xxhash64("request_id", "line"), F.col("parts")).cast("int").alias("part")
    asked = lines.where("tokens IS NOT NULL").join(sizes, "movie_key")
    asked = asked.select("movie_key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), part, F.lit(None).cast("long").alias("block"), "request_id", "line", "source", "tokens", "existing", "anchors")
    held = blocks.where("tokens IS NOT NULL").join(sizes, "movie_key")
    tile = F.floor(F.col("block") / TILE).cast("int").alias("tile")
    none = lambda t: F.lit(None).cast(t)
    held = held.select("movie_key", tile, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("block").cast("long").alias("block"), none("long").alias("request_id"), none("long").alias("line"), none("string").alias("source"), "tokens", none("array<long>").alias("existing"), none("array<long>").alias("anchors"))
    both = spread_out(held.unionByName(asked), "movie_key", "tile", "part").sortWithinPartitions("movie_key", "tile", "part", F.col("request_id").isNotNull(), "request_id", "line")
    w = Window.partitionBy("movie_key", "request_id", "line").orderBy(F.desc("selection"), F.desc("score"), "block")
    found = both.mapInPandas(search, _FOUND).withColumn("place", F.row_number().over(w))
    return found if most is None else found.where(F.col("place") <= most)


def query_lines(requests: DataFrame, lines: DataFrame, version: str, radius: int = 2) -> DataFrame:
    """The lines that a request asks with: its own, and under v4 those up to ``radius`` before and after them.

    ``requests``: movie_key, request_id, first, last (places of its lines), existing, anchors.  ``lines``: movie_key,
    line, position (0, 1, ... by film), tokens.  A range join by equality on bins of the position.
    """
    reach = radius if version == "v4" else 0
    width = 16
    wide = requests.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("first") - reach) / width), F.floor((F.col("last") + reach) / width))))
    near = wide.join(lines.withColumn("_bin", F.floor(F.col("position") / width)), ["movie_key", "_bin"]).where((F.col("position") >= F.col("first") - reach) & (F.col("position") <= F.col("last") + reach))
    source = F.when(F.col("position").between(F.col("first"), F.col("last")), TARGET).otherwise(NEARBY)
    return near.select("movie_key", "request_id", "line", source.alias("source"), "tokens", "existing", "anchors")


def rescued(found: DataFrame, most: int = 12) -> DataFrame:
    """movie_key, request_id, block, score, methods of the blocks to add to each request, ``most`` at most.

    Lines near by count only where no line of the request itself found anything.  A block found twice
    has the better rank, of equal ones the first in the order of the lines.
    """
    request = Window.partitionBy("movie_key", "request_id")
    target = F.col("source") == TARGET
    found = found.withColumn("_hit", F.max(target).over(request)).where(target | ~F.col("_hit"))
    found = found.withColumn("rank", F.col("score") + F.when(target, TARGET_BONUS).otherwise(0.0))
    once = Window.partitionBy("movie_key", "request_id", "block").orderBy(F.desc("rank"), F.desc(target), "line", "place")
    found = found.withColumn("_k", F.row_number().over(once)).where("_k = 1")
    found = found.withColumn("_k", F.row_number().over(request.orderBy(F.desc("rank"), "block"))).where(F.col("_k") <= most)
    return found.select("movie_key", "request_id", "block", F.round("score", 6).alias("score"), F.array(F.lit("global_lexical_rescue"), "method", "source").alias("methods"))


def augment(candidates: DataFrame, limits: DataFrame, added: DataFrame) -> DataFrame:
    """movie_key, request_id, block, methods, score, added: the candidates of each request with the rescued ones, within its limit.

    ``candidates``: movie_key, request_id, block, methods, score.  ``limits``: movie_key, request_id, candidate_limit.
    Automatic mappings stay, then the best of the others give way to what is added; a request to which
    nothing is added keeps its candidates as they are.
    """
    rows = candidates.select("movie_key", "request_id", "block", "methods", "score", F.lit(False).alias("added"))
    rows = rows.unionByName(added.select("movie_key", "request_id", "block", "methods", "score", F.lit(True).alias("added")))
    request = Window.partitionBy("movie_key", "request_id")
    kept = F.array_contains("methods", "automatic_mapping") & ~F.col("added")
    rows = rows.join(limits.select("movie_key", "request_id", "candidate_limit"), ["movie_key", "request_id"])
    rows = rows.withColumns({"_class": F.when(kept, 0).when(F.col("added"), 1).otherwise(2), "_any": F.max("added").over(request)})
    best = Window.partitionBy("movie_key", "request_id", "_class").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "block")
    rows = rows.withColumns({"_n": F.count_if(F.col("_class") < 2).over(request), "_k": F.row_number().over(best)})
    rows = rows.where(~F.col("_any") | (F.col("_class") < 2) | (F.col("_k") <= F.col("candidate_limit") - F.col("_n")))
    rows = rows.withColumn("_k", F.row_number().over(request.orderBy("block"))).where(~F.col("_any") | (F.col("_k") <= F.col("candidate_limit")))
    return rows.select("movie_key", "request_id", "block", "methods", "score", "added")
