"""Alignment of spoken lines with script blocks.

Lines that stand at exactly one place of the script are anchors; the longest
monotone chain of them cuts a film into regions that do not depend on each
other.  Within a region lines are aligned one after the other with a cursor,
which is a fold: the rows of a region - some hundred short ones - come together
and regions stream through a task, so the work spreads over films and regions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneline.functions.evidence import Spans
from sceneline.functions.text import GENERIC, fuzzy
from sceneline.operators.matching import containment_join, unique_places
from sceneline.operators.sequences import spread_out, stream_groups
from sceneline.sources.scratch import scratch_path


@dataclass(frozen=True)
class Policy:
    """Limits of the alignment."""

    accept: float = 0.82
    review: float = 0.65
    margin: float = 0.08
    window: int = 100
    gap_penalty: float = 0.004
    gap_most: float = 0.12
    two_blocks: float = 0.015


ALIGNED = "movie_key string, line long, status string, method string, block_start long, block_end long, token_start int, token_end int, score double, margin double, reason string"


def _informative(tokens: list[str]) -> bool:
    text = " ".join(tokens)
    return len(tokens) >= 4 or len(tokens) >= 2 and len(text) >= 15 and text not in GENERIC


def anchors(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Places of the informative lines that occur once: movie_key, line, block, token_start, token_end, method.

    ``lines`` has movie_key, line, tokens; ``blocks`` movie_key, block (dialogue order), tokens.
    """
    n = F.size("tokens")
    useful = lines.where((n >= 4) | ((n >= 2) & (F.length(F.array_join("tokens", " ")) >= 15) & ~F.array_join("tokens", " ").isin(*GENERIC)))
    found = unique_places(containment_join(useful, blocks, ["movie_key"], "line", "block"), ["movie_key"], "line")
    method = F.when(F.col("line_tokens") == F.col("block_tokens"), "anchor_normalized_exact").otherwise("anchor_unique_substring")
    return found.select("movie_key", "line", "block", "token_start", (F.col("token_start") + F.col("line_tokens")).alias("token_end"), method.alias("method"))


def longest_chain(rows: list[tuple[int, int, int, int]]) -> list[int]:
    """Indices of the longest chain of (line, block, token_start, token_end) in line order.

    A row may follow another one of a smaller block, or of the same block that ends where it
    begins or before.  Of equally long chains the one with the smallest last row, and in each
    step the earliest predecessor, is taken.  The rows that end chains of one length are kept as
    those whose end is a new minimum: the first of them that a row can follow is the earliest of all.
    """
    ends: list[list[tuple[tuple[int, int], int]]] = []  # ends[k]: (end, row) of chains of k + 1 rows, ends falling
    before = [-1] * len(rows)

    def first(length: int, start: tuple[int, int]) -> int:
        """Place of the first row in ends[length] that ends by ``start``."""
        lo, hi = 0, len(ends[length])
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ends[length][mid][0] <= start else (mid + 1, hi)
        return lo

    for i, (_, block, start, stop) in enumerate(rows):
        lo, hi = 0, len(ends)
        while lo < hi:  # chains of k + 1 rows can only be followed if those of k rows can
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid][-1][0] <= (block, start) else (lo, mid)
        if lo:
            before[i] = ends[lo - 1][first(lo - 1, (block, start))][1]
        if lo == len(ends):
            ends.append([])
        if not ends[lo] or (block, stop) < ends[lo][-1][0]:
            ends[lo].append(((block, stop), i))
    chain = [ends[-1][0][1]] if ends else []
    while chain and before[chain[-1]] >= 0:
        chain.append(before[chain[-1]])
    return chain[::-1]


def anchor_chain(found: DataFrame) -> DataFrame:
    """The rows of :func:`anchors` that make up the longest monotone chain of each film."""
    schema = "movie_key string, line long, block long, token_start int, token_end int, method string"

    found = found.select("movie_key", "line", "block", "token_start", "token_end", "method")
    return stream_groups(found, ["movie_key"], ["line"], _chained, schema, spread=True)


def _chained(rows: list[tuple]) -> list[tuple]:
    return [rows[i] for i in longest_chain([r[1:5] for r in rows])]


def _places(needle: list[str], hay: list[str]) -> list[int]:
    n = len(needle)
    return [i for i in range(len(hay) - n + 1) if hay[i : i + n] == needle] if n else []


#: Spans of blocks that a region keeps for its next lines.
_KEPT = 128


def _one_block(line: list[str], block: list[str], start: int, spans) -> tuple[float, int, int, str] | None:
    """Score, token span and method of a line in one block: contained anywhere, else containing, else the best span from ``start`` on.

    ``spans`` gives the :class:`Spans` of the block for a number of words.
    """
    at = _places(line, block)
    if at:
        first = next((a for a in at if a >= start), at[0])
        return 1.0, first, first + len(line), "exact" if len(line) == len(block) else "substring"
    rest = block[start:]
    if rest and _places(rest, line):
        return 0.99 * len(rest) / len(line), start, len(block), "reverse_substring"
    if found := spans(len(line)).best(line, start):
        score, a, width = found
        return score, a, a + width, "fuzzy"
    return (fuzzy(line, rest), start, len(block), "fuzzy") if rest else None


def _two_blocks(line: list[str], left: list[str], right: list[str], start: int) -> tuple[float, int, int, str] | None:
    """Best end of one block joined with a beginning of the next."""
    best = None
    for k in range(1, len(line)):
        a = max(start, len(left) - k)
        end = min(len(right), len(line) - k)
        if a >= len(left) or end < 1:
            continue
        s = fuzzy(line, left[a:] + right[:end])
        if best is None or s > best[0]:
            best = (s, a, end, "fuzzy_two_blocks")
    return best


def align_region(lines: list[tuple[int, list[str]]], blocks: dict[int, list[str]], low: int, high: int, first_token: int, last_token: int | None, policy: Policy) -> list[tuple]:
    """Rows (line, status, method, block_start, block_end, token_start, token_end, score, margin, reason) of the lines of a region."""
    if not blocks or high < low:
        return [(n, "no_match", None, None, None, None, None, None, None, "insufficient_candidates") for n, _ in lines]
    tokens = {b: (t[:last_token] if b == high and last_token is not None else t) for b, t in blocks.items() if low <= b <= high}
    places = {}  # lines of four words and more that stand at one place within the bounds
    for n, t in lines:
        if len(t) >= 4:
            hits = [(b, a) for b, h in tokens.items() for a in _places(t, h) if b > low or a >= first_token]
            if len(hits) == 1:
                places[n] = hits[0]
    cursor, out, kept = (low, first_token), [], {}

    def spans(b: int, n: int) -> Spans:
        if (b, n) not in kept:
            if len(kept) >= _KEPT:
                kept.clear()
            kept[b, n] = Spans(tokens.get(b, []), max(1, n - 3), n + 5)
        return kept[b, n]

    for i, (n, t) in enumerate(lines):
        future = min((places[m] for m, _ in lines[i + 1 :] if m in places and places[m] >= cursor), default=(high, 0))[0]
        cands = []
        hit = places.get(n)
        if hit and hit >= cursor:
            cands.append((1.0, hit[0], hit[0], hit[1], hit[1] + len(t), "exact" if len(t) == len(tokens[hit[0]]) else "substring"))
        else:
            for b in range(cursor[0], min(high, future) + 1):
                start = cursor[1] if b == cursor[0] else 0
                gap = min(policy.gap_most, policy.gap_penalty * (b - cursor[0]))
                one = _one_block(t, tokens.get(b, []), start, partial(spans, b))
                if one:
                    cands.append((one[0] - gap, b, b, one[1], one[2], one[3]))
                if b + 1 <= high and (two := _two_blocks(t, tokens.get(b, []), tokens.get(b + 1, []), start)):
                    cands.append((two[0] - gap - policy.two_blocks, b, b + 1, two[1], two[2], two[3]))
        cands.sort(key=lambda c: (-c[0], c[1:5]))
        if not cands:
            out.append((n, "no_match", None, None, None, None, None, None, None, "below_review_threshold"))
            continue
        score, b0, b1, a, e, method = cands[0]
        other = next((c for c in cands[1:] if c[1:5] != cands[0][1:5]), None)
        margin = score - other[0] if other else 0.0
        sure = method in ("exact", "substring") and len(t) >= 4 or _informative(t) and score >= policy.accept and (margin >= policy.margin or other is None)
        if sure:
            out.append((n, "auto_aligned", method, b0, b1, a, e, score, margin, None))
            cursor = (b1, e) if e < len(tokens.get(b1, [])) else (b1 + 1, 0)
        elif score >= policy.review:
            out.append((n, "needs_review", method, b0, b1, a, e, score, margin, "low_margin_or_score"))
        else:
            hits = [(b, p) for b, h in tokens.items() for p in _places(t, h)]
            if len(hits) == 1:
                b, p = hits[0]
                out.append((n, "needs_review", "exact", b, b, p, p + len(t), 1.0, 0.0, "nonmonotonic_exact_fragment"))
            else:
                out.append((n, "no_match", None, None, None, None, None, score, margin, "below_review_threshold"))
    return out


class Regions:
    """For ``mapInPandas`` over rows sorted by film and region, blocks (without a line) before lines: a region is done when the next one begins."""

    NAMES = ("movie_key", "line", "status", "method", "block_start", "block_end", "token_start", "token_end", "score", "margin", "reason")
    WHOLE = ("line", "block_start", "block_end", "token_start", "token_end")

    def __init__(self, policy: Policy):
        self.policy = policy

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, texts, lines, out = None, {}, [], []
        for batch in batches:
            cols = [batch[c] for c in ("movie_key", "region", "line", "block", "tokens", "low", "high", "first_token", "last_token")]
            for movie, region, line, block, tokens, *bounds in zip(*cols, strict=True):
                if own != (movie, region):
                    out += self.region(own, texts, lines)
                    own, texts, lines = (movie, region), {}, []
                if pd.isna(line):
                    texts[int(block)] = list(tokens)
                else:
                    lines.append((int(line), list(tokens), bounds))
            if out:
                yield self.frame(out)
                out = []
        if lines:
            yield self.frame(self.region(own, texts, lines))

    def region(self, own: tuple[str, int] | None, texts: dict[int, list[str]], lines: list[tuple]) -> list[tuple]:
        if not lines:
            return []
        low, high, first, last = (None if pd.isna(b) else int(b) for b in lines[0][2])
        low, high = (low, min(high, max(texts))) if low is not None and high is not None and texts else (0, -1)
        return [(own[0], *found) for found in align_region([(n, t) for n, t, _ in lines], texts, low, high, first or 0, last, self.policy)]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.NAMES)
        return out.astype(dict.fromkeys(self.WHOLE, "Int64") | dict.fromkeys(("score", "margin"), "float64"))


def align(lines: DataFrame, blocks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Every line with its status and place (see ``ALIGNED``); lines have movie_key (string), line and tokens."""
    chain = anchor_chain(anchors(lines, blocks))
    marks = chain.select("movie_key", "line", F.struct("block", "token_start", "token_end", "method").alias("anchor"))
    w = Window.partitionBy("movie_key").orderBy("line")
    before, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    rows = lines.select("movie_key", "line", "tokens").join(marks, ["movie_key", "line"], "left")
    rows = rows.withColumns(
        {
            "region": F.sum(F.col("anchor").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "left": F.last("anchor", True).over(w.rowsBetween(*before)),
            "right": F.first("anchor", True).over(w.rowsBetween(*after)),
        }
    )
    path = scratch_path(lines.sparkSession, "regions")
    rows.write.parquet(path)  # anchored and open lines, and the regions' bounds, are read from it
    rows = lines.sparkSession.read.parquet(path)
    done = rows.where("anchor IS NOT NULL").select(
        "movie_key",
        "line",
        F.lit("auto_aligned").alias("status"),
        "anchor.method",
        F.col("anchor.block").alias("block_start"),
        F.col("anchor.block").alias("block_end"),
        "anchor.token_start",
        "anchor.token_end",
        F.lit(1.0).alias("score"),
        F.lit(1.0).alias("margin"),
        F.lit(None).cast("string").alias("reason"),
    )
    low = F.when(F.col("left").isNotNull(), F.col("left.block")).otherwise(F.greatest(F.lit(0), F.col("right.block") - policy.window))
    high = F.when(F.col("right").isNotNull(), F.col("right.block")).otherwise(F.col("left.block") + policy.window)
    open_ = rows.where("anchor IS NULL AND movie_key IS NOT NULL").select(
        "movie_key", "region", "line", F.lit(None).cast("long").alias("block"), "tokens", low.alias("low"), high.alias("high"), F.col("left.token_end").alias("first_token"), F.col("right.token_start").alias("last_token")
    )
    # Each region gets the blocks between its anchors, no others.
    bounds = open_.where("low <= high").groupBy("movie_key", "region").agg(F.first("low").alias("low"), F.first("high").alias("high"))
    own = bounds.select("movie_key", "region", F.explode(F.sequence("low", "high")).alias("block")).join(blocks.select("movie_key", "block", "tokens"), ["movie_key", "block"])
    none = [F.lit(None).cast(open_.schema[c].dataType).alias(c) for c in ("line", "low", "high", "first_token", "last_token")]
    both = spread_out(open_.unionByName(own.select("movie_key", "region", "block", "tokens", *none)), "movie_key", "region").sortWithinPartitions("movie_key", "region", F.col("line").isNotNull(), "line")
    return done.unionByName(both.mapInPandas(Regions(policy), ALIGNED))
