"""The audit of risky decisions against a plain reading of its rules that compares every line with all dialogue."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sceneline.operators import highrisk as hr
from sceneline.operators import rescue as rc
from sceneline.plans import rescue_queries as queries

SF = "/root/testdata/sf0.001"
STOP = hr.PLAIN_WORDS


def evidence(words, said):
    own = {t for t in words if t not in STOP}
    shared = len(own & set(said))
    return shared, shared / len(own) if own else 0.0, len(words) >= 2 and " ".join(words) in " ".join(said)


def inside(block, low, high):
    if low is None and high is None:
        return False
    if low is None or high is None:
        return abs(block - (high if low is None else low)) <= 4
    return low - 4 <= block <= high + 4


def plain_search(words, script, supplied, low, high):
    words, hits = words or [], []
    own = {t for t in words if t not in STOP}
    for block, said in script:
        shared, share, phrase = evidence(words, said or [])
        if block not in supplied and (phrase or shared >= 2 and share >= 0.75):
            near = inside(block, low, high) and (phrase and len(words) >= 3 or len(own) >= 2)
            far = not near and (phrase and len(words) >= 4 or share >= 0.75 and len(own) >= 4)
            hits.append((not phrase, -share, block, "near" if near else "far" if far else "shown"))
    hits.sort()
    return [h for k, h in enumerate(hits) if k < 5 or h[3] != "shown"]


def plain_events(rows):
    """line -> names, of one request's lines in order."""
    out, before = {}, None
    for r in rows:
        if not r["selected"]:
            continue
        first, last = min(r["selected"]), max(r["selected"])
        if before:
            p, f, z, scene = before
            found, back = set(), max(0, f - first, z - last)
            if r["scene"] != scene:
                found.add("cross")
            if (first, last) == (f, z):
                found.add("repeat")
            if back:
                found |= {"backward", "large"} if back > 3 else {"backward"}
            for line in (p, r["line"]):
                out.setdefault(line, set()).update(found)
        before = (r["line"], first, last, r["scene"])
    return out


def plain_audit(lines, requests, candidates, blocks):
    scripts, held, out, matches = {}, {}, {}, {}
    for m, b, words in blocks:
        scripts.setdefault(m, []).append((b, words))
    for m, q, b in candidates:
        held.setdefault((m, q), set()).add(b)
    asked = {(r["movie_key"], r["request_id"]): r for r in requests}
    by = {}
    for r in sorted(lines, key=lambda r: r["line"]):
        by.setdefault((r["movie_key"], r["request_id"]), []).append(r)
    for key, rows in by.items():
        q, has, script, events = asked[key], held.get(key, set()), scripts.get(key[0], []), plain_events(rows)
        full = bool(q["candidate_limit"] and len(has) >= q["candidate_limit"])
        for r in rows:
            words, text, ev = r["tokens"] or [], r["text"] or "", events.get(r["line"], set())
            several = len(re.findall(r"(?:^|\n|\s)-\s+", text)) >= 2 or sum(t.lstrip().startswith("-") for t in text.splitlines()) >= 2
            insert = re.match(r"^(?:\[.*\]|(?:title|card|super|sign|chapter|telegram|letter|text)\s*:)", text.strip(), re.I)
            tests = [
                (r["confidence"] is not None and r["confidence"] < 0.8, "low_confidence"), (r["decision"] == "match" and len(r["selected"]) > 1, "multi_block_selection"), (several, "multi_speaker_subtitle"), (full, "candidate_limit_saturated"),
                (q["fallback"], "fallback_retrieval"), (insert, "graphic_or_insert_like_text"), (len(words) <= 3, "very_short_subtitle"), (r["basis"] == "vocative_attachment", "vocative_fragment"),
                (r["basis"] == "repeated_or_reordered_dialogue" or "repeat" in ev, "repeated_or_reordered_mapping"), (q["parser_warning"], "parser_structural_warning"), ("backward" in ev, "backward_sequence_jump"), ("large" in ev, "large_sequence_jump"), ("cross" in ev, "cross_scene_sequence_event"),
            ]
            cls, hits = None, []
            if r["decision"] == "no_candidate_match":
                local = [evidence(words, said or []) for b, said in script if b in has and inside(b, q["lower"], q["upper"])]
                shared, share, phrase = (max(v, default=0) for v in zip(*local, strict=True)) if local else (0, 0.0, False)
                hits = plain_search(words, script, has, q["lower"], q["upper"])
                strong, semantic = phrase and len(words) >= 4 or shared >= 2 and share >= 2 / 3, r["semantic"] or 0.0
                doubt = full or q["fallback"] or several or q["parser_warning"]
                cls = "reviewer_selection_risk" if strong else "candidate_recall_risk" if any(h[3] != "shown" for h in hits) else "ambiguous_needs_review" if (shared >= 2 and share >= 0.5 or semantic >= 0.5) and doubt else "probable_true_no_match"
                tests += [(strong, "strong_lexical_overlap_no_candidate_match"), (semantic >= 0.75, "high_semantic_score_no_candidate_match"), (hits, "strong_screenplay_text_outside_candidate_window")]
                tests.append((cls != "probable_true_no_match", "ambiguous_no_candidate_match" if cls == "ambiguous_needs_review" else cls))
            reasons = [name for t, name in tests if t]
            matches |= {(*key, r["line"], k): (b, -s, not p, kind) for k, (p, s, b, kind) in enumerate(hits, 1)}
            if reasons or cls:
                out[*key, r["line"]] = (cls, reasons, len(hits), sum(h[3] != "shown" for h in hits), hits[0][2] if hits else None, len(has), full)
    return out, matches


def compare(spark, lines, requests, candidates, blocks):
    want, matches = plain_audit([r.asDict() for r in lines.collect()], requests.collect(), [tuple(r) for r in candidates.select("movie_key", "request_id", "block").collect()], [(r["movie_key"], r["block"], r["tokens"]) for r in blocks.collect()])
    audited = hr.audit(lines, requests, candidates, blocks)
    got = {(r["movie_key"], r["request_id"], r["line"]): (r["class"], r["reasons"], r["outside"], r["recall"], r["best"], r["candidates"], r["saturated"]) for r in audited.collect()}
    assert got == want
    found = hr.outside(lines.where(F.col("decision") == hr.NO_MATCH), requests, candidates, blocks).collect()
    assert {(r["movie_key"], r["request_id"], r["line"], r["place"]): (r["block"], r["share"], r["phrase"], r["kind"]) for r in found} == matches and len(found) == len(matches)
    return want, matches, audited


def test_queries(spark, monkeypatch):
    tables = queries.decided(spark, SF)
    want, matches, audited = compare(spark, *tables)
    monkeypatch.setattr(queries, "decided", lambda spark, sf_dir: tables)
    assert {"reviewer_selection_risk", "candidate_recall_risk"} <= {v[0] for v in want.values()} and matches
    got = {(r["part"], r["name"]): r["n"] for r in hr.summary(audited).collect()}
    assert got["records", "all"] == sum(bool(v[1]) for v in want.values())
    for name in {n for v in want.values() for n in v[1]}:
        assert got["reason", name] == sum(name in v[1] for v in want.values())
    assert {k[1]: n for k, n in got.items() if k[0] == "class"} == {c: sum(v[0] == c for v in want.values()) for c in {v[0] for v in want.values()} - {None}}
    assert queries.QUERIES["high_risk_audit"](spark, SF).count() == len(want) and queries.QUERIES["outside_matches"](spark, SF).count() == len(matches)
    assert queries.QUERIES["high_risk_summary"](spark, SF).count() == len(got)


LINES = "movie_key string, request_id long, line long, text string, tokens array<string>, decision string, basis string, confidence double, selected array<long>, scene long, semantic double, automatic boolean"
REQUESTS = "movie_key string, request_id long, lower long, upper long, fallback boolean, candidate_limit long, parser_warning boolean"


def made(spark, seed):
    """Films of few words, with null words and texts, requests without anchors or candidates, a film without a script, repeated candidates."""
    rng = random.Random(seed)
    words = "a the you is sun tree star moon river lantern gold art part the them us bus".split()
    lines, requests, candidates, blocks = [], [], [], []
    for m in range(4):
        script = [[rng.choice(words) for _ in range(rng.choice([0, 2, 4, 7, 12]))] for _ in range(0 if m == 0 else 60)]
        blocks += [(str(m), b, None if rng.random() < 0.05 else t) for b, t in enumerate(script)]
        for q in range(12):
            low, high = (None if rng.random() < 0.3 else rng.randrange(60) for _ in range(2))
            requests.append((str(m), q, low, high, rng.choice([True, False, None]), rng.choice([0, 3, None]), rng.choice([True, False, None])))
            own = [rng.randrange(60) for _ in range(rng.choice([0, 3, 9]))] if script else []
            candidates += [(str(m), q, b) for b in own + own[:1]]
            for k in range(8):
                said = rng.choice(script) if script and rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(6))]
                at = rng.randrange(7)
                said = said[at : at + rng.choice([2, 3, 5, 9])] if len(said) > 5 else said
                found = bool(own) and rng.random() < 0.4
                text = rng.choice(["- oh\n- no", "[sign]", "Title: x", "well - known", "", None, " ".join(said)])
                lines.append((str(m), q, q * 10 + k, text, None if rng.random() < 0.05 else said, "match" if found else "no_candidate_match", rng.choice([None, "vocative_attachment", "repeated_or_reordered_dialogue"]), rng.choice([None, 0.1, 0.8, 1.0]), rng.sample(own, rng.choice([1, 2])) if found else [], rng.randrange(2), rng.choice([None, 0.2, 0.5, 0.8]), rng.choice([True, False])))
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(candidates, "movie_key string, request_id long, block long"), spark.createDataFrame(blocks, "movie_key string, block long, tokens array<string>")


@pytest.mark.parametrize("seed", [1, 2])
def test_made_films(spark, monkeypatch, seed):
    monkeypatch.setattr(rc, "TILE", 16)
    monkeypatch.setattr(rc, "PART", 20)
    want, matches, _ = compare(spark, *made(spark, seed))
    assert {v[0] for v in want.values()} == {*hr.CLASSES, None}
    assert {k[3] for k in matches.values()} == {"near", "far", "shown"}
    assert {n for v in want.values() for n in v[1]} >= {"large_sequence_jump", "cross_scene_sequence_event", "backward_sequence_jump", "ambiguous_no_candidate_match", "graphic_or_insert_like_text"}


def test_edges(spark):
    lines, requests, candidates, blocks = made(spark, 3)
    compare(spark, lines, requests, candidates.limit(0), blocks)
    compare(spark, lines, requests, candidates, blocks.limit(0))
    assert hr.audit(lines.limit(0), requests, candidates, blocks).count() == 0
    assert {(r["part"], r["n"]) for r in hr.summary(hr.audit(lines.limit(0), requests, candidates, blocks)).collect()} == {("records", 0)}


def test_forgetting(spark, monkeypatch):
    """What a task forgets of earlier texts changes nothing."""
    monkeypatch.setattr(hr, "REMEMBERED", 0)
    compare(spark, *made(spark, 5))
