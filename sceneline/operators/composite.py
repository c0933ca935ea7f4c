"""The composite audit of resolutions, and checks of a frozen calibration reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The flags of the audit, in their order.
FLAGS = (
    "multiple_dialogue_turns", "automatic_mapping_has_more_blocks", "multi_request", "one_block_with_two_adjacent_overlaps", "candidate_boundary_spanning_fragment",
    "uncertain", "low_confidence", "multiple_fragments_match_adjacent_candidates",
)


def several_turns(text: Column) -> Column:
    """Two dashes that open a turn, or one between blanks."""
    return (F.regexp_count(text, F.lit(r"(?:^|\s)-\s*")) >= 2) | text.rlike(r"\s-\s")


def agrees(tokens: Column, candidate: Column) -> Column:
    """Two different words in common, or one of a line of up to four different words."""
    shared = F.size(F.array_intersect(tokens, candidate))
    return (shared >= 2) | ((shared >= 1) & (F.size(F.array_distinct(tokens)) <= 4))


def flags(text: Column, tokens: Column, stratum: Column, selected: Column, automatic: Column, decision: Column, confidence: Column, candidates: Column) -> Column:
    """The flags of a resolution, in the order of ``FLAGS``; ``candidates`` are (block, tokens) in script order.

    Null texts and arrays are empty; a null confidence is not low.
    """
    dashes = several_turns(F.coalesce(text, F.lit("")))
    n = F.coalesce(F.size(candidates), F.lit(0))
    pairs = F.when(n >= 2, F.arrays_zip(F.slice(candidates, F.lit(1), n - 1).alias("a"), F.slice(candidates, F.lit(2), n - 1).alias("b")))
    both = F.coalesce(F.exists(pairs, lambda p: (p["b"]["block"] == p["a"]["block"] + 1) & agrees(tokens, p["a"]["tokens"]) & agrees(tokens, p["b"]["tokens"])), F.lit(False))
    first, last = F.element_at(candidates, 1)["tokens"], F.element_at(candidates, -1)["tokens"]
    end = lambda a, k: F.slice(a, F.greatest(F.lit(1), F.size(a) - k + 1), F.lit(k))
    spans = F.when(n >= 2, F.arrays_overlap(F.slice(tokens, 1, 4), end(first, 6)) & F.arrays_overlap(end(tokens, 4), F.slice(last, 1, 6)))
    tests = [dashes, F.size(automatic) > F.size(selected), stratum == "multi", (F.size(selected) == 1) & both, spans, decision == "uncertain", confidence < 0.80, dashes & both]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in zip(FLAGS, tests, strict=True)]))


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row: flagged resolutions, requests of several blocks, blocks selected too few, uncertain and unsure ones."""
    has = lambda f: F.array_contains("flags", f)
    few = (F.size("selected") == 1) & (has(FLAGS[3]) | has(FLAGS[1]))
    return audited.where(F.size("flags") > 0).agg(
        F.count("*").alias("total_flagged"), F.count_distinct(F.when(has(FLAGS[2]), F.struct("movie_key", "request_id"))).alias("multi_requests"), F.count_if(few).alias("one_block_underselection"),
        F.count_if(has("uncertain")).alias("uncertain"), F.count_if(has("low_confidence")).alias("low_confidence"),
    )


def nested_digest(rows: DataFrame) -> str:
    """Digest of a nested table that depends on its rows and how often each is there, not on their order or partitions.

    A row is its JSON text with nulls written; its SHA-256, cut into four 64-bit numbers, is added up by number.
    """
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    h = F.sha2(text.cast("binary"), 256)
    word = lambda i: F.conv(F.substring(h, 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")
    r = rows.select(*[word(i).alias(f"w{i}") for i in range(4)]).agg(F.count("*").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)]).first()
    return f"{r['n']}:" + "".join(f"{int(r[f'w{i}'] or 0) % (1 << 64):016x}" for i in range(4))


def reference_errors(references: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, error, detail (the place of a resolution, or null) of a calibration reference against the requests it was made for.

    ``references``: request_id, human_gold, request (a copy of the request's row as a struct), resolutions (array of
    line, text, decision, blocks).  ``requests``: request_id, lines (array of line, text), candidates (array of
    block).  A request must occur once, be known, not be called human gold, hold an unchanged copy, and
    resolve its lines in their order with decisions that fit their blocks; every request must occur.
    """
    own = F.struct(*[F.col(c) for c in requests.columns])
    known = requests.select("request_id", own.alias("_own"))
    repeated = references.groupBy("request_id").agg(F.count("*").alias("_n")).where("_n > 1")
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    rows = references.join(known, "request_id", "left").join(repeated, "request_id", "left")
    here = F.col("_own").isNotNull()
    whole = lambda name, test: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("error"), F.lit(None).cast("int").alias("detail")))
    lines, said = F.col("_own.lines"), F.col("resolutions")
    order = ~F.coalesce(F.transform(said, lambda r: r["line"]).eqNullSafe(F.transform(lines, lambda r: r["line"])), F.lit(False))

    def checks(r: Column, i: Column) -> Column:
        blocks = r["blocks"]
        unique = blocks.isNotNull() & (F.size(F.array_distinct(blocks)) == F.size(blocks))
        sound = F.coalesce(r["decision"].isin("match", "no_candidate_match"), F.lit(False))
        one = lambda name, test: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("error"), i.cast("int").alias("detail")))
        return F.array(
            one("invalid_decision", ~sound), one("blocks_not_unique", sound & ~unique), one("foreign_blocks", sound & unique & (F.size(F.array_except(blocks, F.col("_own.candidates"))) > 0)),
            one("match_without_blocks", sound & unique & (r["decision"] == "match") & (F.size(blocks) == 0)), one("blocks_without_match", sound & unique & (r["decision"] == "no_candidate_match") & (F.size(blocks) > 0)),
            one("text_differs", sound & unique & (i < F.size(lines)) & ~r["text"].eqNullSafe(F.get(lines, i)["text"])),
        )

    found = F.concat(
        F.array(
            whole("duplicate_request", F.col("_n").isNotNull()), whole("foreign_request", ~here), whole("human_gold", here & ~F.coalesce(~F.col("human_gold"), F.lit(False))),
            whole("request_differs", here & ~json(F.col("request")).eqNullSafe(json(F.col("_own")))), whole("no_resolutions", here & said.isNull()), whole("lines_differ", here & said.isNotNull() & order),
        ),
        F.when(here & said.isNotNull(), F.flatten(F.transform(said, checks))).otherwise(F.array()),
    )
    out = rows.select("request_id", F.explode(F.array_compact(found)).alias("e")).select("request_id", "e.error", "e.detail")
    missing = requests.join(references.select("request_id"), "request_id", "left_anti")
    return out.unionByName(missing.select("request_id", F.lit("missing_request").alias("error"), F.lit(None).cast("int").alias("detail")))


def frozen_errors(references: DataFrame, requests: DataFrame, manifest: dict) -> list[str]:
    """What of the frozen manifest does not hold: its statements, the digests of both tables, and its counts."""
    said = F.explode("resolutions")
    decisions = {r["decision"]: r["n"] for r in references.select(said.alias("r")).where("r.decision IN ('match', 'no_candidate_match')").groupBy("r.decision").agg(F.count("*").alias("n")).collect()}  # two rows
    counts = {"request_count": references.count(), "resolution_count": references.agg(F.sum(F.greatest(F.lit(0), F.size("resolutions")))).first()[0] or 0}
    tests = {
        "human_gold": manifest.get("human_gold") is False,
        "frozen_before_reviewer_output": manifest.get("frozen_before_reviewer_output") is True,
        "reference_digest": manifest.get("reference_digest") == nested_digest(references),
        "request_digest": manifest.get("request_digest") == nested_digest(requests),
        **{name: manifest.get(name) == n for name, n in counts.items()},
        "decision_counts": manifest.get("decision_counts") == {d: decisions.get(d, 0) for d in ("match", "no_candidate_match")},
    }
    return [name for name, holds in tests.items() if not holds]
