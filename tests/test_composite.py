"""Composite audit and calibration references against plain readings of their rules."""

import re

from pyspark.sql import functions as F

from sceneline.operators import composite as cp
from sceneline.plans import rescue_queries as queries

SF = "/root/testdata/sf0.001"


def plain_flags(r):
    text, words = r["text"] or "", r["tokens"] or []
    agrees = lambda c: len(set(words) & set(c["tokens"])) >= 2 or set(words) & set(c["tokens"]) and len(set(words)) <= 4
    dashes = len(re.findall(r"(?:^|\s)-\s*", text)) >= 2 or re.search(r"\s-\s", text)
    cands = r["candidates"] or []
    both = any(b["block"] == a["block"] + 1 and agrees(a) and agrees(b) for a, b in zip(cands, cands[1:], strict=False))
    spans = len(cands) >= 2 and set(words[:4]) & set(cands[0]["tokens"][-6:]) and set(words[-4:]) & set(cands[-1]["tokens"][:6])
    tests = [dashes, len(r["automatic"]) > len(r["selected"]), r["stratum"] == "multi", len(r["selected"]) == 1 and both, spans, r["decision"] == "uncertain", r["confidence"] is not None and r["confidence"] < 0.8, dashes and both]
    return [name for name, t in zip(cp.FLAGS, tests, strict=True) if t]


def test_composite_audit(spark):
    rows = [r.asDict(recursive=True) for r in queries.resolved(spark, SF).collect()]
    want = {(r["movie_key"], r["request_id"], r["line"]): "+".join(f) for r in rows if (f := plain_flags(r))}
    got = {(r["movie_key"], r["request_id"], r["line"]): r["flags"] for r in queries.composite_audit(spark, SF).collect()}
    assert got == want and {f for v in got.values() for f in v.split("+")} >= set(cp.FLAGS) - {"candidate_boundary_spanning_fragment"}
    (total,) = queries.composite_audit_summary(spark, SF).collect()
    few = sum(len(r["selected"]) == 1 and bool({cp.FLAGS[1], cp.FLAGS[3]} & set(plain_flags(r))) for r in rows)
    assert (total["total_flagged"], total["one_block_underselection"]) == (len(want), few)
    assert total["multi_requests"] == len({(r["movie_key"], r["request_id"]) for r in rows if "multi_request" in plain_flags(r)})
    assert total["uncertain"] == sum("uncertain" in v.split("+") for v in want.values()) and total["low_confidence"] == sum("low_confidence" in v.split("+") for v in want.values())


def test_flags_of_made_rows(spark):
    c = lambda b, t: (b, t.split())
    rows = [
        (1, "- oh - no", "oh no".split(), "fuzzy", [3], [3, 4], "match", 0.9, [c(3, "oh dear no"), c(4, "no oh")]),
        (1, "well-known", ["well", "known"], "easy", [3], [3], "match", None, [c(3, "well"), c(5, "known")]),
        (2, "d e f g", "d e f g".split(), "multi", [], [], "uncertain", 0.1, [c(1, "a b c d"), c(9, "g h i")]),
        (3, None, None, None, [], [], None, 0.8, None),
        (4, "-a -b", ["a", "b"], "easy", [], [], "match", 1.0, []),
    ]
    schema = "request_id long, text string, tokens array<string>, stratum string, selected array<long>, automatic array<long>, decision string, confidence double, candidates array<struct<block:long,tokens:array<string>>>"
    df = spark.createDataFrame(rows, schema)
    got = [r["flags"] for r in queries.audited(df).orderBy("request_id", F.desc("text")).collect()]
    want = [plain_flags(r.asDict(recursive=True)) for r in df.orderBy("request_id", F.desc("text")).collect()]
    assert got == want == [[cp.FLAGS[4]], [*cp.FLAGS[:2], cp.FLAGS[3], cp.FLAGS[4], cp.FLAGS[7]], ["multi_request", cp.FLAGS[4], "uncertain", "low_confidence"], [], ["multiple_dialogue_turns"]]


KIND = (
    "request_id long, human_gold boolean, request struct<request_id:long,lines:array<struct<line:long,text:string>>,candidates:array<long>>, "
    "resolutions array<struct<line:long,text:string,decision:string,blocks:array<long>>>"
)


def plain_errors(references, requests):
    known, out = {r["request_id"]: r for r in requests}, []
    ids = [r["request_id"] for r in references]
    for r in references:
        me, own = r["request_id"], known.get(r["request_id"])
        add = lambda error, place=None, me=me: out.append((me, error, place))
        if ids.count(me) > 1:
            add("duplicate_request")
        if own is None:
            add("foreign_request")
            continue
        if r["human_gold"] is not False:
            add("human_gold")
        if r["request"] != own:
            add("request_differs")
        if r["resolutions"] is None:
            add("no_resolutions")
            continue
        if [x["line"] for x in r["resolutions"]] != [x["line"] for x in own["lines"]]:
            add("lines_differ")
        for i, x in enumerate(r["resolutions"]):
            if x["decision"] not in ("match", "no_candidate_match"):
                add("invalid_decision", i)
            elif x["blocks"] is None or len(set(x["blocks"])) < len(x["blocks"]):
                add("blocks_not_unique", i)
            else:
                if set(x["blocks"]) - set(own["candidates"]):
                    add("foreign_blocks", i)
                if x["decision"] == "match" and not x["blocks"]:
                    add("match_without_blocks", i)
                if x["decision"] != "match" and x["blocks"]:
                    add("blocks_without_match", i)
                if i < len(own["lines"]) and x["text"] != own["lines"][i]["text"]:
                    add("text_differs", i)
    return sorted(map(str, out + [(i, "missing_request", None) for i in known.keys() - set(ids)]))


def test_calibration_reference(spark):
    references, requests = queries.calibration(spark, "/root/testdata/sf0.01")
    rows = [[r.asDict(recursive=True) for r in df.collect()] for df in (references, requests)]
    want = plain_errors(*rows)
    assert sorted(str(tuple(r)) for r in queries.calibration_errors(spark, "/root/testdata/sf0.01").collect()) == want
    assert len({w.split("'")[1] for w in want}) >= 11
    odd = spark.createDataFrame([(1, None, None, None), (1, False, None, [])], KIND)
    assert sorted(str(tuple(r)) for r in cp.reference_errors(odd, requests).where("request_id = 1").collect()) == [w for w in plain_errors([r.asDict(recursive=True) for r in odd.collect()], rows[1]) if w.startswith("(1,")]


def test_frozen_manifest(spark):
    references, requests = queries.calibration(spark, SF)
    one, two = cp.nested_digest(references), cp.nested_digest(references.repartition(5).orderBy(F.desc("request_id")))
    assert one == two != cp.nested_digest(references.union(references.limit(1))) and cp.nested_digest(references.limit(0)).startswith("0:")
    decisions = {}
    n = 0
    for r in references.collect():
        for x in r["resolutions"]:
            n += 1
            decisions[x["decision"]] = decisions.get(x["decision"], 0) + 1
    good = {"human_gold": False, "frozen_before_reviewer_output": True, "reference_digest": one, "request_digest": cp.nested_digest(requests), "request_count": references.count(), "resolution_count": n, "decision_counts": {d: decisions.get(d, 0) for d in ("match", "no_candidate_match")}}
    assert cp.frozen_errors(references, requests, good) == []
    assert cp.frozen_errors(references, requests.withColumn("candidates", F.reverse("candidates")), good) == ["request_digest"]
    assert cp.frozen_errors(references, requests, {}) == list(good)
