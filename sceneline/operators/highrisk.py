"""The audit of risky decisions: why a decision wants a human look, and what a line without a match has elsewhere in the script.

A line that was left without a match is searched in all dialogue of its film
outside the candidates that its request supplied, and held against the
supplied ones between its anchors; from both comes one of four classes.
The search uses the tiles of :mod:`sceneline.operators.rescue`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneline.functions.evidence import Dialogue
from sceneline.operators import audits as au
from sceneline.operators import resolutions as rs
from sceneline.operators.rescue import TARGET, SearchTiles, _tiled

#: Words that do not count as content here; results have to agree on them.
PLAIN_WORDS = frozenset(
    "a an and are as at be been but by do for from got had has have he her here him his i in is it just me my of on or our out she so that the their them there "
    "they this to up us was we were what when with you your".split()
)
#: Classes of a line without a match; grounds of a decision that are risks.
CLASSES = ("reviewer_selection_risk", "candidate_recall_risk", "ambiguous_needs_review", "probable_true_no_match")
NO_MATCH, VOCATIVE, REORDERED = "no_candidate_match", "vocative_attachment", "repeated_or_reordered_dialogue"
#: Blocks that an envelope of anchors reaches beyond them; matches that are shown of each line; unsure below.
MARGIN, SHOWN, UNSURE = 4, 5, 0.8
#: Texts remembered by a task before it forgets them.
REMEMBERED = 100_000

KEYS = ["movie_key", "request_id", "line"]


def content(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*sorted(PLAIN_WORDS))))


class OutsideTiles(SearchTiles):
    """All blocks outside a line's candidates that hold it, or three quarters and at least two of its words of content.

    ``anchors`` of a line are its two bounds, -1 where there is none.  Of matches that are neither
    near nor telling a tile gives only those that can be among the ``SHOWN`` best.
    """

    def best(self, dialogue: Dialogue, known: dict, r) -> list[tuple]:
        words = tuple(r.tokens)
        own = {t for t in words if t not in PLAIN_WORDS}
        if words not in known:
            if sum(map(len, known.values())) > REMEMBERED:
                known.clear()
            known[words] = self.matches(dialogue, words, own)
        supplied, (low, high) = set(r.existing), (int(a) for a in r.anchors)
        found = []
        for phrase, share, text in known[words]:
            for block in dialogue.numbers[text]:
                if block not in supplied:
                    near = enveloped(block, low, high) and (phrase and len(words) >= 3 or len(own) >= 2)
                    far = not near and (phrase and len(words) >= 4 or share >= 0.75 and len(own) >= 4)
                    found.append((-phrase, -share, block, "near" if near else "far" if far else "shown"))
        found.sort()
        return [(r.movie_key, int(r.request_id), int(r.line), r.source, b, -s, float(-p), kind) for k, (p, s, b, kind) in enumerate(found) if k < SHOWN or kind != "shown"]

    def matches(self, dialogue: Dialogue, words: tuple[str, ...], own: set[str]) -> list[tuple[bool, float, int]]:
        counts, phrases = dialogue.shared(own), set(dialogue.saying(words))
        enough = {i for i, n in enumerate(counts.tolist()) if n >= 2 and n / len(own) >= 0.75}
        return [(i in phrases, int(counts[i]) / len(own) if own else 0.0, i) for i in sorted(enough | phrases)]


def enveloped(block: int, low: int, high: int) -> bool:
    """:func:`sceneline.operators.resolutions.within_envelope` for bounds that are -1 where there is none."""
    if low >= 0 and high >= 0:
        return low - MARGIN <= block <= high + MARGIN
    one = max(low, high)
    return one >= 0 and abs(block - one) <= MARGIN


def outside(lines: DataFrame, requests: DataFrame, candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """movie_key, request_id, line, place, block, share, phrase, kind of what lines without a match have outside their candidates.

    ``lines``: movie_key, request_id, line, tokens.  ``requests``: movie_key, request_id, lower, upper (anchors, null where
    there is none).  ``candidates``: movie_key, request_id, block, a bounded number for a request.  ``blocks``: movie_key,
    block (0, 1, ...), tokens.  kind: near (between the anchors), far (telling enough without them), shown
    (neither, but among the five best).  Phrases come first, then shares, then the script's order.
    Lines with null keys or words find nothing.
    """
    has = candidates.groupBy("movie_key", "request_id").agg(F.collect_list("block").alias("existing"))
    none = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    asked = lines.select(*KEYS, "tokens").join(requests.select("movie_key", "request_id", F.array(none(F.col("lower")), none(F.col("upper"))).alias("anchors")), ["movie_key", "request_id"])
    asked = asked.join(has, ["movie_key", "request_id"], "left").withColumns({"existing": F.coalesce("existing", F.array().cast("array<long>")), "source": F.lit(TARGET)})
    found = _tiled(asked.select(*KEYS, "source", "tokens", "existing", "anchors"), blocks.select("movie_key", "block", "tokens"), OutsideTiles(""), None)
    found = found.where((F.col("method") != "shown") | (F.col("place") <= SHOWN))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS).orderBy("place")))  # tiles gave more than are shown
    return found.select(*KEYS, "place", "block", F.col("score").alias("share"), (F.col("selection") > 0).alias("phrase"), F.col("method").alias("kind"))


def supplied(lines: DataFrame, requests: DataFrame, candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """movie_key, request_id, line, shared, share, phrase: the best of each line's candidates between its anchors; no row without one."""
    words = blocks.select("movie_key", "block", F.col("tokens").alias("_said"))
    near = candidates.select("movie_key", "request_id", "block").distinct().join(requests.select("movie_key", "request_id", "lower", "upper"), ["movie_key", "request_id"])
    near = near.where(rs.within_envelope(F.col("block"), F.col("lower"), F.col("upper"), MARGIN)).join(words, ["movie_key", "block"])
    own = lines.select(*KEYS, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).withColumn("_own", content(F.col("tokens")))
    shared = F.coalesce(F.size(F.array_intersect("_own", "_said")), F.lit(0))
    phrase = F.coalesce((F.size("tokens") >= 2) & F.contains(F.array_join("_said", " "), F.array_join("tokens", " ")), F.lit(False))
    both = own.join(near, ["movie_key", "request_id"]).select(*KEYS, shared.alias("shared"), F.coalesce(F.try_divide(shared, F.size("_own")), F.lit(0.0)).alias("share"), phrase.alias("phrase"))
    return both.groupBy(*KEYS).agg(F.max("shared").alias("shared"), F.max("share").alias("share"), F.max("phrase").alias("phrase"))


def line_events(rows: DataFrame) -> DataFrame:
    """movie_key, request_id, line, backward, large, cross, repeat: what :func:`audits.sequence_events` says of a line or of the one after it.

    ``rows``: movie_key, request_id, line, scene, first, last (blocks, null without a match), basis.
    """
    request = Window.partitionBy("movie_key", "request_id").orderBy("line")
    rows = rows.withColumn("_q", F.struct("movie_key", "request_id"))
    before = rows.where("first IS NOT NULL").select("_q", "line", F.lag("line").over(request).alias("_before"))
    events = au.sequence_events(rows, "_q", ["line"], "scene", "first", "last", "basis", REORDERED).join(before, ["_q", "line"])
    both = events.select("_q", F.explode(F.array_compact(F.array("line", "_before"))).alias("line"), "event", "distance")
    back = F.col("event") == "backward"
    return both.groupBy(F.col("_q.movie_key").alias("movie_key"), F.col("_q.request_id").alias("request_id"), "line").agg(
        F.max(back).alias("backward"), F.max(back & (F.col("distance") > 3)).alias("large"), F.max(F.col("event") == "cross_scene").alias("cross"), F.max(F.col("event") == "repeat").alias("repeat")
    )


def audit(lines: DataFrame, requests: DataFrame, candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every decision with a reason to look at it, why, and the class of those without a match.

    ``lines``: movie_key, request_id, line, text, tokens, decision, basis, confidence, selected (array of blocks), scene (of the
    selection), semantic (best score of automatic matches, null without), automatic (whether there are any).
    ``requests``: movie_key, request_id, lower, upper, fallback, candidate_limit, parser_warning.  Others as for :func:`outside`.
    Null texts and words are empty, a null confidence is not low, null flags are false.  Repeated candidates count once.
    ``outside`` is the number of matches that are shown, ``recall`` that of near and far ones, ``best`` the first;
    ``local_low`` and ``local_high`` are the part of the script around the candidates.
    """
    false = lambda c: F.coalesce(F.col(c), F.lit(False))
    candidates = candidates.select("movie_key", "request_id", "block").distinct()
    size = blocks.groupBy("movie_key").agg((F.max("block")).alias("_last"))
    held = candidates.groupBy("movie_key", "request_id").agg(F.count("*").alias("candidates"), F.min("block").alias("_min"), F.max("block").alias("_max"))
    asked = requests.join(held, ["movie_key", "request_id"], "left").join(size, "movie_key", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    asked = asked.withColumn("saturated", F.coalesce((F.col("candidate_limit") > 0) & (F.col("candidates") >= F.col("candidate_limit")), F.lit(False)))
    asked = asked.withColumns({"local_low": F.greatest(F.lit(0), F.col("_min") - 2), "local_high": F.least(F.col("_last"), F.col("_max") + 2)})
    asked = asked.select("movie_key", "request_id", "fallback", "parser_warning", "candidates", "saturated", "local_low", "local_high")
    missed = lines.where(F.col("decision") == NO_MATCH).select(*KEYS, "tokens")
    found = outside(missed, requests, candidates, blocks).groupBy(*KEYS).agg(F.count("*").alias("outside"), F.count_if(F.col("kind") != "shown").alias("recall"), F.min_by("block", "place").alias("best"))
    events = line_events(lines.select(*KEYS, "scene", F.array_min("selected").alias("first"), F.array_max("selected").alias("last"), "basis"))
    rows = lines.join(asked, ["movie_key", "request_id"]).join(supplied(missed, requests, candidates, blocks), KEYS, "left").join(found, KEYS, "left").join(events, KEYS, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("outside", "recall", "shared", "share")})
    text, n = F.coalesce("text", F.lit("")), F.coalesce(F.size("tokens"), F.lit(0))
    several, semantic, open_ = rs.multi_speaker(text), F.coalesce("semantic", F.lit(0.0)), F.coalesce(F.col("decision") == NO_MATCH, F.lit(False))
    strong = (false("phrase") & (n >= 4)) | ((F.col("shared") >= 2) & (F.col("share") >= 2 / 3))
    moderate = ((F.col("shared") >= 2) & (F.col("share") >= 0.5)) | (semantic >= 0.5)
    doubtful = F.col("saturated") | false("fallback") | several | false("parser_warning")
    found_class = F.when(strong, CLASSES[0]).when(F.col("recall") > 0, CLASSES[1]).when(moderate & doubtful, CLASSES[2]).otherwise(CLASSES[3])
    rows = rows.withColumn("class", F.when(open_, found_class))
    one = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    reasons = [
        one(F.col("confidence") < UNSURE, "low_confidence"),
        one((F.col("decision") == "match") & (F.size("selected") > 1), "multi_block_selection"),
        one(several, "multi_speaker_subtitle"),
        one(F.col("saturated"), "candidate_limit_saturated"),
        one(F.col("fallback"), "fallback_retrieval"),
        one(rs.insert_like(text), "graphic_or_insert_like_text"),
        one(n <= 3, "very_short_subtitle"),
        one(F.col("basis") == VOCATIVE, "vocative_fragment"),
        one((F.col("basis") == REORDERED) | false("repeat"), "repeated_or_reordered_mapping"),
        one(F.col("parser_warning"), "parser_structural_warning"),
        one(F.col("backward"), "backward_sequence_jump"),
        one(F.col("large"), "large_sequence_jump"),
        one(F.col("cross"), "cross_scene_sequence_event"),
        one(open_ & strong, "strong_lexical_overlap_no_candidate_match"),
        one(open_ & (semantic >= 0.75), "high_semantic_score_no_candidate_match"),
        one(F.col("outside") > 0, "strong_screenplay_text_outside_candidate_window"),
        one(F.col("class") == CLASSES[0], CLASSES[0]),
        one(F.col("class") == CLASSES[1], CLASSES[1]),
        one(F.col("class") == CLASSES[2], "ambiguous_no_candidate_match"),
    ]
    evidence = F.when(open_, F.array_compact(F.array(one(strong, "strong_supplied_candidate_in_anchor_envelope"), one(F.col("automatic"), "automatic_mapping_present"), one(F.col("recall") > 0, "strong_screenplay_text_outside_candidate_window"))))
    rows = rows.withColumns({"reasons": F.array_compact(F.array(*reasons)), "evidence": evidence})
    return rows.select(*KEYS, "decision", "class", "reasons", "evidence", "candidates", "saturated", "outside", "recall", "best", "local_low", "local_high").where((F.size("reasons") > 0) | open_)


def summary(audited: DataFrame) -> DataFrame:
    """part (records, reason or class), name, n; lines without a match count by class even where nothing else speaks for a look."""
    looked = audited.where(F.size("reasons") > 0)
    records = looked.agg(F.count("*").alias("n")).select(F.lit("records").alias("part"), F.lit("all").alias("name"), "n")
    reasons = looked.select(F.explode("reasons").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("reason").alias("part"), "name", "n")
    classes = audited.where(F.col("class").isNotNull()).groupBy(F.col("class").alias("name")).agg(F.count("*").alias("n")).select(F.lit("class").alias("part"), "name", "n")
    return records.unionByName(reasons).unionByName(classes)
