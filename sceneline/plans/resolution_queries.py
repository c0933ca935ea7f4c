"""Queries over review requests and releases.

A conversation is a request, its turns are subtitles and candidate blocks.
Decisions of a reference and of a reviewer are derived from the ids, so that
every kind of agreement, error and gap occurs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneline.operators import plugs as pg
from sceneline.operators import release as rl
from sceneline.operators import resolutions as rs
from sceneline.operators.review import request_lines as build_lines
from sceneline.plans.analogs import FRAMES_SQL, frames, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_R = """r AS (SELECT conv_id AS request_id, turn AS subtitle_id, text, role,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'uncertain' WHEN 3 THEN 'no_match' ELSE 'match' END AS e,
  CASE WHEN (conv_id + turn) % 4 IN (0, 3) THEN CAST([] AS BIGINT[]) WHEN conv_id % 3 = 0 THEN [turn, turn + 1] ELSE [turn] END::BIGINT[] AS eb,
  CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN 'Absent from the candidate list' END AS notes,
  CASE (conv_id * 3 + turn * 5) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'no_match' WHEN 2 THEN 'uncertain' ELSE 'match' END AS a,
  CASE WHEN (conv_id * 3 + turn * 5) % 7 = 0 THEN NULL WHEN (conv_id * 3 + turn * 5) % 7 = 1 THEN CASE WHEN turn % 3 = 0 THEN [turn] ELSE CAST([] AS BIGINT[]) END WHEN (conv_id * 3 + turn * 5) % 7 = 2 THEN CAST([] AS BIGINT[])
    ELSE CASE (conv_id + turn * 2) % 6 WHEN 0 THEN [turn + 1] WHEN 1 THEN [turn, turn + 1] WHEN 2 THEN [turn, turn + 2] WHEN 3 THEN [turn, turn] ELSE [turn] END END::BIGINT[] AS ab,
  CASE WHEN (conv_id * 3 + turn * 5) % 7 <> 0 THEN list_extract(['exact_or_near_exact', 'paraphrase', 'changed_or_improvised_dialogue', 'split_across_blocks', 'repeated_or_reordered_dialogue', 'no_such_basis'], CAST((conv_id + turn) % 6 + 1 AS BIGINT)) END AS basis,
  CASE WHEN (conv_id * 3 + turn * 5) % 7 <> 0 THEN (turn % 10) / 8e0 END AS confidence FROM conversations)"""


def _resolutions(spark, sf_dir):
    k, none = F.col("conv_id"), F.array().cast("array<long>")
    t = F.col("turn").cast("long")
    m, d, v = (k + t) % 4, (k * 3 + t * 5) % 7, (k + t * 2) % 6
    decision = F.when(m == 0, "uncertain").when(m == 3, "no_match").otherwise("match")
    gold = F.when(m.isin(0, 3), none).when(k % 3 == 0, F.array(t, t + 1)).otherwise(F.array(t))
    notes = F.when((k * 3 + t) % 5 == 0, "Absent from the candidate list")
    hit = F.when(v == 0, F.array(t + 1)).when(v == 1, F.array(t, t + 1)).when(v == 2, F.array(t, t + 2)).when(v == 3, F.array(t, t)).otherwise(F.array(t))
    ids = F.when(d == 1, F.when(t % 3 == 0, F.array(t)).otherwise(none)).when(d == 2, none).otherwise(hit)
    bases = F.array(*map(F.lit, ("exact_or_near_exact", "paraphrase", "changed_or_improvised_dialogue", "split_across_blocks", "repeated_or_reordered_dialogue", "no_such_basis")))
    actual = F.struct(
        F.when(d == 1, "no_match").when(d == 2, "uncertain").otherwise("match").alias("decision"), ids.alias("block_ids"), F.element_at(bases, ((k + t) % 6 + 1).cast("int")).alias("basis"), ((t % 10) / 8.0).alias("confidence")
    )
    return table(spark, sf_dir, "conversations").select(
        k.alias("request_id"), t.alias("subtitle_id"), "text", "role", F.struct(decision.alias("decision"), gold.alias("block_ids"), notes.alias("notes")).alias("expected"), F.when(d != 0, actual).alias("actual")
    )


def _candidates(spark, sf_dir):
    """All turns of a request but the user's second one are its candidates."""
    c = table(spark, sf_dir, "conversations").where("NOT (role = 'user' AND turn % 4 = 2)")
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("position"), F.col("turn").cast("long").alias("block_id"), F.floor(F.col("turn") / 4).alias("scene_id"))


_C = "c AS (SELECT conv_id AS request_id, list(CAST(turn AS BIGINT) ORDER BY turn) AS ids FROM conversations WHERE NOT (role = 'user' AND turn % 4 = 2) GROUP BY 1)"
_SAME = "list_sort(list_distinct(eb)) = list_sort(list_distinct(ab))"


@query(f"""WITH {_R} SELECT request_id, subtitle_id, CASE WHEN e = 'match' THEN 'candidate_match' ELSE 'no_candidate_match' END AS expected_outcome,
  CASE WHEN a IS NULL THEN 'missing' WHEN a = 'match' THEN 'candidate_match' ELSE 'no_candidate_match' END AS actual_outcome,
  coalesce(e = a AND {_SAME}, false) AS correct, coalesce(CASE WHEN e = 'match' THEN a = 'match' AND {_SAME} ELSE a IN ('no_match', 'uncertain') END, false) AS task_correct,
  coalesce((e = 'match') = (a = 'match'), false) AS presence_correct, e = 'uncertain' AND coalesce(notes, '') ILIKE '%absent%' AND coalesce(notes, '') ILIKE '%candidate%' AS recall_gold FROM r""")
def candidate_outcomes(spark, sf_dir):
    """Outcomes of both sides, and in which senses they agree."""
    e, a = F.col("expected"), F.col("actual")
    both = a.isNotNull() & (rs.outcome(e) == rs.outcome(a))
    return _resolutions(spark, sf_dir).select(
        "request_id", "subtitle_id", rs.outcome(e).alias("expected_outcome"), rs.outcome(a).alias("actual_outcome"), rs.resolution_correct(e, a).alias("correct"), rs.task_correct(e, a).alias("task_correct"),
        both.alias("presence_correct"), rs.recall_gold(e).alias("recall_gold"),
    )


_CLASSES = [
    ("a IS NULL", "missing_prediction"), (f"a IS NOT NULL AND {_SAME} AND e <> a", "correct_candidate_wrong_decision"), (f"e = 'match' AND a = 'match' AND NOT {_SAME}", "wrong_candidate"),
    ("a IS NOT NULL AND list_has_all(eb, ab) AND len(list_distinct(ab)) < len(list_distinct(eb))", "underselection"), ("a IS NOT NULL AND list_has_all(ab, eb) AND len(list_distinct(eb)) < len(list_distinct(ab))", "overselection"),
    ("e = 'no_match' AND a = 'uncertain'", "gold_no_match_predicted_uncertain"), ("e = 'no_match' AND a = 'match'", "gold_no_match_predicted_match"), ("e = 'uncertain' AND a = 'no_match'", "gold_uncertain_predicted_no_match"),
    ("e = 'uncertain' AND a = 'match'", "gold_uncertain_predicted_match"), ("e = 'uncertain' AND notes IS NOT NULL", "candidate_recall_failure"), ("basis = 'repeated_or_reordered_dialogue'", "repeated_or_reordered_error"),
]


def _concat(rules, sep="|"):
    return f"concat_ws('{sep}', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules) + ")"


@query(f"WITH {_R} SELECT request_id, subtitle_id, {_concat(_CLASSES)} AS classes FROM r WHERE NOT coalesce(e = a AND {_SAME}, false)")
def pilot_disagreements(spark, sf_dir):
    d = rs.disagreements(_resolutions(spark, sf_dir))
    return d.select("request_id", "subtitle_id", F.array_join("classes", "|").alias("classes"))


@query(f"""WITH {_R} SELECT count(*) AS resolutions, round(avg(coalesce(e = a, false)::INT), 6) AS decision_accuracy, round(avg(coalesce({_SAME}, false)::INT), 6) AS blocks_accuracy, round(avg(coalesce(e = a AND {_SAME}, false)::INT), 6) AS resolution_accuracy,
  round(avg(coalesce(CASE WHEN e = 'match' THEN a = 'match' AND {_SAME} ELSE a IN ('no_match', 'uncertain') END, false)::INT), 6) AS task_accuracy, round(avg(coalesce((e = 'match') = (a = 'match'), false)::INT), 6) AS presence_accuracy FROM r""")
def pilot_metrics(spark, sf_dir):
    m = rs.pilot_metrics(_resolutions(spark, sf_dir))
    return m.select("resolutions", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(f"""WITH {_R}, x AS (SELECT request_id, subtitle_id, CASE WHEN a = 'match' THEN 'auto_aligned' WHEN a = 'uncertain' OR a IS NULL THEN 'needs_review' ELSE 'no_match' END AS status, ab[1] AS f, ab[len(ab)] AS z FROM r),
d AS (SELECT *, f < lag(f) OVER w AS back, greatest(0, f - lag(z) OVER w - 1) AS gap FROM x WHERE status = 'auto_aligned' WINDOW w AS (PARTITION BY request_id ORDER BY subtitle_id)),
s AS (SELECT request_id, count(*) FILTER (WHERE back) AS v, CAST(coalesce(sum(CASE WHEN gap IS NOT NULL THEN gap END), 0) AS BIGINT) AS g FROM d GROUP BY 1)
SELECT request_id, count(*) AS rows, count(*) FILTER (WHERE status = 'auto_aligned') AS auto_aligned, count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'no_match') AS no_match, coalesce(max(v), 0) AS monotonicity_violations, coalesce(max(g), 0) AS deletion_gaps FROM x LEFT JOIN s USING (request_id) GROUP BY 1""")
def alignment_diagnostics(spark, sf_dir):
    ids, d = F.col("actual.block_ids"), F.col("actual.decision")
    status = F.when(d == "match", "auto_aligned").when((d == "uncertain") | d.isNull(), "needs_review").otherwise("no_match")
    rows = _resolutions(spark, sf_dir).select("request_id", "subtitle_id", status.alias("status"), F.try_element_at(ids, F.lit(1)).alias("first"), F.try_element_at(ids, F.lit(-1)).alias("last"))
    return rs.alignment_diagnostics(rows, "request_id", "subtitle_id")


_LINE = "CASE subtitle_id % 5 WHEN 0 THEN 'Anna,' WHEN 1 THEN 'SIGN: NO ENTRY' WHEN 2 THEN '- Who is it? - Only me.' WHEN 3 THEN 'Bob walks to the door.' ELSE coalesce(text, '') END"


def _line():
    s = F.col("subtitle_id") % 5
    return F.when(s == 0, "Anna,").when(s == 1, "SIGN: NO ENTRY").when(s == 2, "- Who is it? - Only me.").when(s == 3, "Bob walks to the door.").otherwise(F.coalesce("text", F.lit("")))


_WORDS = r"len(regexp_extract_all(x, '[\p{L}\p{N}_’''-]+'))"
_TAGS = [
    ("e = 'no_match' AND a = 'match'", "gold_no_match_predicted_match"), ("e = 'no_match' AND a = 'match'", "possible_gold_policy_issue"), (f"e = 'match' AND a = 'match' AND NOT {_SAME}", "gold_match_predicted_wrong_candidate"),
    (f"e = 'match' AND a = 'match' AND NOT {_SAME}", "possible_wrong_model_candidate"), ("e = 'match' AND a IN ('no_match', 'uncertain')", "gold_match_predicted_no_candidate_match"), ("e = 'uncertain' AND notes IS NOT NULL", "possible_candidate_recall_failure"),
    ("basis = 'repeated_or_reordered_dialogue'", "possible_repeated_dialogue"), (f"{_WORDS} <= 2 AND regexp_matches(rtrim(x), '[,:]$')", "possible_vocative_fragment"), (f"{_WORDS} <= 4", "possible_subtitle_fragment"),
    (r"length(regexp_replace(x, '\P{L}', '', 'g')) > 0 AND length(regexp_replace(x, '\P{Lu}', '', 'g')) >= 0.8 * length(regexp_replace(x, '\P{L}', '', 'g'))", "possible_graphic_or_insert_text"),
    ("basis = 'paraphrase'", "possible_paraphrase"), ("basis = 'changed_or_improvised_dialogue'", "possible_improvised_dialogue"), ("basis = 'split_across_blocks'", "possible_expanded_film_dialogue"),
]


@query(f"WITH {_R}, x AS (SELECT *, {_LINE} AS x FROM r WHERE a IS NOT NULL) SELECT request_id, subtitle_id, {_concat(_TAGS)} AS tags FROM x")
def diagnostic_tags(spark, sf_dir):
    r = _resolutions(spark, sf_dir).where("actual IS NOT NULL")
    return r.select("request_id", "subtitle_id", F.array_join(rs.diagnostic_tags(_line(), F.col("expected"), F.col("actual")), "|").alias("tags"))


@query(f"""WITH {_R}, x AS (SELECT *, {_LINE} AS x FROM r) SELECT request_id, subtitle_id, len(regexp_extract_all(x, '(?:^|\\n|\\s)-\\s+')) >= 2 OR len(regexp_extract_all(x, '(?m)^[ \\t]*-')) >= 2 AS multi_speaker,
  regexp_matches(trim(x), '(?i)^(?:\\[.*\\]|(?:title|card|super|sign|chapter|telegram|letter|text)\\s*:)') AS insert_like, subtitle_id % 5 = 3 OR regexp_matches(x, '(?i)^\\S+ (?:{rs.NARRATED})\\b.*[.:]$') AS action_narrative FROM x""")
def text_predicates(spark, sf_dir):
    x = _line()
    return _resolutions(spark, sf_dir).select("request_id", "subtitle_id", rs.multi_speaker(x).alias("multi_speaker"), rs.insert_like(x).alias("insert_like"), rs.action_narrative(x).alias("action_narrative"))


@query(f"""WITH {_R}, x AS (SELECT *, {_LINE} AS x, lag(subtitle_id) OVER w AS before, lead(subtitle_id) OVER w AS after FROM r WINDOW w AS (PARTITION BY request_id ORDER BY subtitle_id)),
d AS (SELECT request_id, subtitle_id, {_concat(_CLASSES)} AS classes, CASE WHEN a IS NULL THEN '' ELSE {_concat(_TAGS)} END AS tags, before, after FROM x WHERE NOT coalesce(e = a AND {_SAME}, false)) SELECT request_id, subtitle_id, classes, tags, before, after FROM d""")
def adjudication_package(spark, sf_dir):
    """Disagreements with their neighbours, for a person to decide."""
    r = _resolutions(spark, sf_dir)
    w = Window.partitionBy("request_id").orderBy("subtitle_id")
    near = r.select("request_id", "subtitle_id", F.array_compact(F.array(F.lag("subtitle_id").over(w))).alias("before"), F.array_compact(F.array(F.lead("subtitle_id").over(w))).alias("after"))
    p = rs.adjudication_package(r, near, _line())
    one = lambda c: F.try_element_at(c, F.lit(1)).alias(c)
    return p.select("request_id", "subtitle_id", F.array_join("classes", "|").alias("classes"), F.array_join("tags", "|").alias("tags"), one("before"), one("after"))


@query(f"""WITH {_R}, d AS (SELECT request_id, subtitle_id, (request_id + subtitle_id) % 9 AS m FROM r WHERE NOT coalesce(e = a AND {_SAME}, false)),
s AS (SELECT request_id, subtitle_id, CASE WHEN m = 0 THEN 'missing' WHEN m = 1 THEN 'repeated' WHEN m = 2 THEN 'already_decided' END AS errors FROM d) SELECT * FROM s WHERE errors IS NOT NULL UNION ALL SELECT request_id, subtitle_id + 1000, 'not_asked_for' FROM d WHERE m = 3""")
def package_errors(spark, sf_dir):
    d = rs.disagreements(_resolutions(spark, sf_dir)).select("request_id", "subtitle_id")
    m = (F.col("request_id") + F.col("subtitle_id")) % 9
    p = d.where(m != 0).withColumn("adjudicated_decision", F.when(m == 2, "match"))
    p = p.unionByName(p.where(m == 1)).unionByName(p.where(m == 3).withColumn("subtitle_id", F.col("subtitle_id") + 1000))
    return rs.package_errors(p, d).select("request_id", "subtitle_id", F.array_join("errors", "|").alias("errors"))


_ADJ = "ab = [] OR list_transform(ab, lambda i: list_position(ids, i)) = range(list_position(ids, ab[1]), list_position(ids, ab[1]) + len(ab))"
_ERRORS = [
    ("a IS NULL", "invalid_decision"), ("basis IS NULL OR basis = 'no_such_basis'", "invalid_decision_basis"), ("confidence IS NULL OR confidence > 1", "invalid_confidence"), ("len(list_distinct(ab)) < len(ab)", "block_ids_not_unique"),
    ("a IN ('no_match', 'uncertain') AND len(ab) > 0", "decision_requires_empty_block_ids"), ("len(list_distinct(ab)) = len(ab) AND NOT list_has_all(coalesce(ids, []), ab)", "block_outside_request_candidates"),
    (f"len(list_distinct(ab)) = len(ab) AND list_has_all(coalesce(ids, []), ab) AND NOT ({_ADJ})", "blocks_not_ordered_and_adjacent"),
    ("len(list_distinct(ab)) = len(ab) AND list_has_all(coalesce(ids, []), ab) AND len(list_distinct(list_transform(ab, lambda i: i // 4))) > 1", "blocks_cross_scenes"),
]


@query(f"WITH {_R}, {_C}, j AS (SELECT request_id, subtitle_id, a, basis, confidence, coalesce(ab, []) AS ab, ids FROM r LEFT JOIN c USING (request_id)), s AS (SELECT request_id, subtitle_id, {_concat(_ERRORS)} AS errors FROM j) SELECT * FROM s WHERE errors <> ''")
def resolution_errors(spark, sf_dir):
    """Decisions that break the contract; null decisions too."""
    found = rs.resolution_errors(_resolutions(spark, sf_dir), _candidates(spark, sf_dir))
    return found.where(F.size("errors") > 0).select("request_id", "subtitle_id", F.array_join("errors", "|").alias("errors"))


_V3 = [("a = 'uncertain' OR a IS NULL" if n == "invalid_decision" else c, n) for c, n in _ERRORS if n != "blocks_not_ordered_and_adjacent"]


@query(f"""WITH {_R}, {_C}, j AS (SELECT request_id, a, basis, confidence, coalesce(ab, []) AS ab, ids FROM r LEFT JOIN c USING (request_id)),
s AS (SELECT request_id, unnest(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _V3)}], lambda x: x IS NOT NULL)) AS error FROM j) SELECT error, count(*) AS n, count(DISTINCT request_id) AS requests FROM s GROUP BY error""")
def binary_contract_errors(spark, sf_dir):
    """The contract with two decisions only, and blocks in any order; summed over all responses."""
    found = rs.resolution_errors(_resolutions(spark, sf_dir), _candidates(spark, sf_dir), ("match", "no_match"), ordered=False)
    return found.select("request_id", F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("requests"))


_RESP = """p AS (SELECT conv_id * 2 AS line, CASE WHEN conv_id % 17 = 0 THEN conv_id + 1000000 ELSE conv_id END AS custom_id, CASE WHEN conv_id % 12 = 5 THEN 500 ELSE 200 END AS status_code, conv_id % 9 <> 4 AS well_formed FROM k WHERE conv_id % 10 <> 3
  UNION ALL SELECT conv_id * 2 + 1, conv_id, 200, true FROM k WHERE conv_id % 10 = 4)"""


@query(f"""WITH k AS (SELECT DISTINCT conv_id FROM conversations), {_RESP}, w AS (SELECT p.*, conv_id, row_number() OVER (PARTITION BY custom_id ORDER BY line) AS j FROM p LEFT JOIN k ON custom_id = conv_id),
f AS (SELECT custom_id, CAST(line AS BIGINT) AS line, CASE WHEN conv_id IS NULL THEN 'unknown_custom_id' WHEN j > 1 THEN 'duplicate_request_response' WHEN status_code <> 200 THEN 'api_error_or_non_200' WHEN NOT well_formed THEN 'malformed' END AS problem FROM w)
SELECT * FROM f WHERE problem IS NOT NULL UNION ALL SELECT conv_id, NULL, 'missing' FROM k WHERE conv_id NOT IN (SELECT custom_id FROM p)""")
def response_problems(spark, sf_dir):
    k = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id")).distinct()
    c = F.col("request_id")
    first = k.where(c % 10 != 3).select((c * 2).alias("line"), F.when(c % 17 == 0, c + 1000000).otherwise(c).alias("custom_id"), F.when(c % 12 == 5, 500).otherwise(200).alias("status_code"), (c % 9 != 4).alias("well_formed"))
    again = k.where(c % 10 == 4).select((c * 2 + 1).alias("line"), c.alias("custom_id"), F.lit(200).alias("status_code"), F.lit(True).alias("well_formed"))
    return rs.response_set(k, first.unionByName(again))


_REQ = """q AS (SELECT conv_id AS request_id, turn AS position, CASE WHEN turn % 10 <> 9 THEN turn - CASE WHEN (conv_id + turn) % 9 = 0 THEN 1 ELSE 0 END END AS bi, CASE WHEN role = 'system' THEN 'action' ELSE 'dialogue' END AS bt, turn % 3 AS sc, turn / 8e0 AS score,
  CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END AS last_scene, 6 AS hi, 5 AS lim, conv_id % 6 = 0 AS ins FROM conversations)"""


@query(f"""WITH {_REQ}, e AS (SELECT request_id, unnest(list_filter([CASE WHEN bi IS NULL THEN 'invalid_candidate' END, CASE WHEN bi IS NOT NULL AND bt <> 'dialogue' THEN 'candidate_is_not_dialogue' END, CASE WHEN bi IS NOT NULL AND sc > last_scene THEN 'candidate_scene_mismatch' END,
  CASE WHEN bi NOT BETWEEN 0 AND hi THEN 'candidate_outside_range' END, CASE WHEN bi IS NOT NULL AND score > 1 THEN 'invalid_score' END], lambda x: x IS NOT NULL)) AS error FROM q),
o AS (SELECT *, lag(bi) OVER (PARTITION BY request_id ORDER BY position) AS before FROM q WHERE bi IS NOT NULL),
w AS (SELECT DISTINCT request_id, 'candidates_not_ordered_and_unique' AS error FROM o WHERE bi <= before UNION ALL SELECT request_id, 'exceeds_candidate_limit' FROM o GROUP BY request_id HAVING count(*) > max(lim) UNION ALL SELECT DISTINCT request_id, 'insufficient_request_has_candidates' FROM q WHERE ins)
SELECT request_id, error, count(*) AS n FROM (SELECT * FROM e UNION ALL SELECT * FROM w) GROUP BY ALL""")
def request_errors(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    conv = table(spark, sf_dir, "conversations")
    index = F.when(t % 10 != 9, t - F.when((c + t) % 9 == 0, 1).otherwise(0))
    cands = conv.select(c.alias("request_id"), t.alias("position"), index.alias("block_index"), F.when(F.col("role") == "system", "action").otherwise("dialogue").alias("block_type"), (t % 3).cast("int").alias("scene_id"), (t / 8.0).alias("score"))
    scenes = F.when(c % 2 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    reqs = conv.select("conv_id").distinct().select(c.alias("request_id"), scenes.alias("scenes"), F.lit(0).alias("low"), F.lit(6).alias("high"), F.lit(5).alias("candidate_limit"), (c % 6 == 0).alias("insufficient"))
    return rs.request_errors(cands, reqs)


@query("""WITH k AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT CAST(conv_id AS VARCHAR) AS custom_id, CASE WHEN conv_id % 5 = 0 THEN 'missing_line' WHEN conv_id % 7 = 0 THEN 'method_differs' WHEN conv_id % 11 = 0 THEN 'model_differs' WHEN conv_id % 13 = 0 THEN 'input_differs' END AS errors
FROM k WHERE conv_id % 5 = 0 OR conv_id % 7 = 0 OR conv_id % 11 = 0 OR conv_id % 13 = 0 UNION ALL SELECT CAST(conv_id + 1000000 AS VARCHAR), 'unknown_request' FROM k WHERE conv_id % 19 = 0""")
def batch_line_errors(spark, sf_dir):
    """Batch lines with damages against lines built anew from their requests."""
    k = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.count("*").alias("turns"))
    fresh = build_lines(k, ["turns"], "reviewer").select(F.get_json_object("line", "$.custom_id").alias("custom_id"), "line")
    c, swap = F.col("custom_id").cast("long"), lambda a, b: F.replace("line", F.lit(a), F.lit(b))
    damaged = F.when(c % 7 == 0, swap('"POST"', '"GET"')).when(c % 11 == 0, swap("reviewer", "other")).when(c % 13 == 0, swap("turns", "turn")).otherwise(F.col("line"))
    lines = fresh.where(c % 5 != 0).withColumn("line", damaged).unionByName(fresh.where(c % 19 == 0).withColumn("custom_id", (c + 1000000).cast("string")))
    return rs.line_errors(lines, fresh).select("custom_id", F.array_join("errors", "|").alias("errors"))


@query(f"""WITH {_R}, s AS (SELECT request_id, subtitle_id, CASE WHEN subtitle_id % 3 = 2 THEN greatest(0, eb[1] - subtitle_id % 7) ELSE eb[1] END AS f FROM r WHERE e = 'match'), b AS (SELECT *, lag(f) OVER (PARTITION BY request_id ORDER BY subtitle_id) - f AS back FROM s)
SELECT request_id, subtitle_id, CAST(back AS BIGINT) AS back, CASE WHEN back <= 3 THEN 'bounded_backward' ELSE 'unrepresentable_backward' END AS movement FROM b WHERE back > 0""")
def gold_movement(spark, sf_dir):
    """Selections of the reference that go back."""
    s = _resolutions(spark, sf_dir).where("expected.decision = 'match'")
    first, i = F.element_at("expected.block_ids", 1), F.col("subtitle_id")
    s = s.select("request_id", "subtitle_id", F.when(i % 3 == 2, F.greatest(F.lit(0), first - i % 7)).otherwise(first).alias("first"))
    return rs.selection_movement(s, "request_id", "subtitle_id").select("request_id", "subtitle_id", "back", "movement")


_CELL = "CASE WHEN n = 0 THEN 'insufficient_candidates' WHEN request_id % 4 = 0 THEN 'fallback_retrieval' ELSE 'normal_candidate_window' END"


@query(f"""WITH q AS (SELECT conv_id AS request_id, count(*) FILTER (WHERE role = 'assistant') AS n FROM conversations GROUP BY 1), t AS (SELECT *, {_CELL} || ':' || CASE WHEN n = 3 THEN 'saturated' ELSE 'not_saturated' END AS cell FROM q)
SELECT cell, count(*) AS requests, CAST(sum(n) AS BIGINT) AS candidates, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 6) AS rate FROM t GROUP BY cell""")
def selection_cells(spark, sf_dir):
    """Distribution of requests over window types and saturation."""
    q = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.count_if(F.col("role") == "assistant").alias("n"))
    cell = F.concat_ws(":", rs.window_type(F.col("n"), F.col("request_id") % 4 == 0), rs.saturation(F.col("n"), F.lit(3)))
    per = q.groupBy(cell.alias("cell")).agg(F.count("*").alias("requests"), F.sum("n").alias("candidates"))
    return per.withColumn("rate", F.round(F.col("requests") / F.sum("requests").over(Window.partitionBy()), 6))  # six cells


@query("""WITH q AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS n FROM conversations GROUP BY 1) SELECT n AS candidates, count(*) AS requests FROM q GROUP BY n""")
def candidate_count_histogram(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("candidates"))
    return q.groupBy("candidates").agg(F.count("*").alias("requests"))


@query(f"""WITH {_R}, g AS (SELECT request_id * 10 + subtitle_id // 2 AS g, subtitle_id, ab FROM r WHERE a = 'match'), x AS (SELECT g, subtitle_id, unnest(ab) AS b FROM g), p AS (SELECT g, count(DISTINCT subtitle_id) AS rows, count(DISTINCT b) AS blocks FROM x GROUP BY g)
SELECT count(*) FILTER (WHERE rows > 1 AND blocks = 1) AS n_to_one, count(*) FILTER (WHERE rows > 1 AND blocks > 1) AS n_to_m, (SELECT count(*) FROM g WHERE len(ab) > 1) AS one_to_m FROM p""")
def mapping_cardinality(spark, sf_dir):
    g = _resolutions(spark, sf_dir).where("actual.decision = 'match'").select((F.col("request_id") * 10 + F.floor(F.col("subtitle_id") / 2)).alias("g"), F.col("actual.block_ids").alias("ids"))
    return rs.cardinality(g, "g", "ids")


@query("""WITH b AS (SELECT conv_id, turn, turn // 2 * 3 AS o, lag(turn, 3) OVER w AS lo, lead(turn, 2) OVER w AS hi FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN o BETWEEN lo - 4 AND hi + 4 ELSE abs(o - coalesce(lo, hi)) <= 4 END, false) AS within FROM b""")
def anchor_envelopes(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    b = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.floor(F.col("turn") / 2) * 3).alias("o"), F.lag("turn", 3).over(w).alias("lo"), F.lead("turn", 2).over(w).alias("hi"))
    return b.select("conv_id", "turn", rs.within_envelope(F.col("o"), F.col("lo"), F.col("hi")).alias("within"))


@query("""WITH b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS flat, CASE WHEN role <> 'system' THEN row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) - 1 END AS o FROM conversations),
s AS (SELECT DISTINCT conv_id, o AS seed FROM b WHERE o IS NOT NULL AND (conv_id + o) % 5 = 0), n AS (SELECT conv_id, seed, min(flat) AS a, max(flat) AS z FROM s JOIN b USING (conv_id) WHERE abs(o - seed) <= 1 GROUP BY ALL)
SELECT DISTINCT b.conv_id, b.turn FROM b JOIN n ON b.conv_id = n.conv_id AND flat BETWEEN a AND z""")
def screenplay_neighbourhood(spark, sf_dir):
    """The blocks within one dialogue turn of each seed."""
    w = Window.partitionBy("conv_id")
    is_action = F.col("role") == "system"
    b = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(w.orderBy("turn")) - 1).alias("flat"), F.when(~is_action, F.row_number().over(Window.partitionBy("conv_id", is_action).orderBy("turn")) - 1).alias("dialogue_order"))
    seeds = b.where("dialogue_order IS NOT NULL AND (conv_id + dialogue_order) % 5 = 0").select("conv_id", F.col("dialogue_order").alias("seed"))
    return rs.neighbourhood(seeds, b, "conv_id", 1).select("conv_id", "turn")


def _retrieval(spark, sf_dir):
    """Lines are the user's turns, blocks the assistant's and system's; the score is derived from the ids."""
    c = table(spark, sf_dir, "conversations")
    lines = c.where("role = 'user'").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("line"))
    blocks = c.where("role <> 'user'").select(F.col("conv_id").alias("request_id"), F.col("turn").cast("long").alias("block"))
    score = ((F.col("line") * 37 + F.col("block") * 53 + F.col("request_id") * 11) % 100) / 100.0
    scores = lines.join(blocks, "request_id").withColumn("score", score)
    r = F.col("request_id")
    limits = c.select(F.col("conv_id").alias("request_id")).distinct().select("request_id", F.lit(1).alias("low"), F.lit(8).alias("high"), F.lit(4).alias("candidate_limit"), F.array(r % 9, r % 4 + 20).alias("required"))
    return lines, scores, limits


@query()
def cursor_retrieval(spark, sf_dir):
    """Candidates of each request, with a preference that moves forward."""
    return rs.retrieve(*_retrieval(spark, sf_dir))


@query(f"""WITH {_R}, c AS (SELECT request_id, subtitle_id, CASE request_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'fuzzy' ELSE 'multi' END AS stratum, CASE subtitle_id % 3 WHEN 0 THEN 'early' WHEN 1 THEN 'middle' ELSE 'late' END AS region, coalesce(a = 'uncertain' AND request_id % 10 = 0, false) AS req FROM r),
s1 AS (SELECT *, 'sample_easy' AS reason FROM c WHERE NOT req AND 'easy' IN (stratum, region) ORDER BY request_id, subtitle_id LIMIT 6), l1 AS (SELECT * FROM c WHERE NOT req AND (request_id, subtitle_id) NOT IN (SELECT (request_id, subtitle_id) FROM s1)),
s2 AS (SELECT *, 'sample_fuzzy' AS reason FROM l1 WHERE 'fuzzy' IN (stratum, region) ORDER BY request_id, subtitle_id LIMIT 6), l2 AS (SELECT * FROM l1 WHERE (request_id, subtitle_id) NOT IN (SELECT (request_id, subtitle_id) FROM s2)),
s3 AS (SELECT *, 'sample_early' AS reason FROM l2 WHERE 'early' IN (stratum, region) ORDER BY request_id, subtitle_id LIMIT 6)
SELECT request_id, subtitle_id, 'required' AS reason FROM c WHERE req UNION ALL SELECT request_id, subtitle_id, reason FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)""")
def human_audit_sample(spark, sf_dir):
    """All that must be looked at, and six more of each category in turn."""
    r, s = F.col("request_id") % 3, F.col("subtitle_id") % 3
    c = _resolutions(spark, sf_dir).withColumns({"stratum": F.when(r == 0, "easy").when(r == 1, "fuzzy").otherwise("multi"), "region": F.when(s == 0, "early").when(s == 1, "middle").otherwise("late")})
    must = F.coalesce((F.col("actual.decision") == "uncertain") & (F.col("request_id") % 10 == 0), F.lit(False))
    return rs.audit_sample(c, ["easy", "fuzzy", "early"], ["stratum", "region"], ["request_id", "subtitle_id"], 6, must).select("request_id", "subtitle_id", "reason")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F') ORDER BY o_orderkey LIMIT 1")
def next_open_item(spark, sf_dir):
    return rs.next_open(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", ["F"])


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT movie_key, frame, confidence, (frame % 5) / 4e0 AS fraction FROM f), b AS (SELECT *, 0 AS pass FROM g WHERE fraction = 0.5 UNION ALL SELECT *, 1 FROM g)
SELECT movie_key, frame, CAST(pass AS INTEGER) AS pass, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY pass, confidence DESC, movie_key, frame, fraction) AS place FROM b) WHERE place <= 50""")
def gallery_candidates(spark, sf_dir):
    """The fifty frames that a reviewer labels: a report of the first ones is the feature."""
    f = frames(spark, sf_dir).select("movie_key", "frame", "confidence", ((F.col("frame") % 5) / 4.0).alias("fraction"))
    return rs.gallery_candidates(f, [F.desc("confidence"), "movie_key", "frame"], 50).select("movie_key", "frame", "pass", "place")


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT *, movie_key % 3 = 0 AS vfr, count(*) OVER (PARTITION BY movie_key) AS total FROM f) SELECT movie_key, frame, round(CASE WHEN vfr THEN pts ELSE frame / 24e0 END, 6) AS starts,
  round(CASE WHEN vfr THEN coalesce(lead(pts) OVER (PARTITION BY movie_key ORDER BY frame), pts + 1 / 24e0) ELSE (frame + 1) / 24e0 END, 6) AS ends FROM n""")
def frame_times(spark, sf_dir):
    """Start and exclusive end of each frame: of the timeline where the rate varies, else of the nominal rate."""
    from sceneline.operators.sequences import frame_times as of

    return of(frames(spark, sf_dir).withColumn("vfr", F.col("movie_key") % 3 == 0), "movie_key", "frame", "pts", "vfr", 24.0).select("movie_key", "frame", F.round("starts", 6).alias("starts"), F.round("ends", 6).alias("ends"))


@query(f"""WITH {FRAMES_SQL}, d AS (SELECT movie_key, frame, abs(confidence - lag(confidence) OVER w) AS luma, (event_type = 'error')::INT - lag((event_type = 'error')::INT) OVER w AS clip FROM f WINDOW w AS (PARTITION BY movie_key ORDER BY frame))
SELECT movie_key, frame, concat_ws('|', CASE WHEN clip >= 0.01 THEN 'clipping_increased' END, CASE WHEN luma >= 0.08 THEN 'median_luma_changed' END) AS flags FROM d WHERE clip >= 0.01 OR luma >= 0.08""")
def frame_flags(spark, sf_dir):
    """Frames that a person should look at: more clipping, or another median luma, than the one before."""
    w = Window.partitionBy("movie_key").orderBy("frame")
    clip = (F.col("event_type") == "error").cast("int")
    d = frames(spark, sf_dir).select("movie_key", "frame", F.abs(F.col("confidence") - F.lag("confidence").over(w)).alias("luma"), (clip - F.lag(clip).over(w)).alias("clip"))
    flags = rs.names(F.when(F.col("clip") >= 0.01, "clipping_increased"), F.when(F.col("luma") >= 0.08, "median_luma_changed"))
    return d.select("movie_key", "frame", F.array_join(flags, "|").alias("flags")).where("flags <> ''")


# Orders are films: the inventory has all, statuses and manifests have gaps and repeats.


@query("""WITH s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 23 = 0), m AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey + 100000000 FROM orders WHERE o_orderkey % 29 = 0),
n AS (SELECT k, sum(i) AS i, sum(s) AS s, sum(m) AS m FROM (SELECT o_orderkey AS k, 1 AS i, 0 AS s, 0 AS m FROM orders UNION ALL SELECT k, 0, 1, 0 FROM s UNION ALL SELECT k, 0, 0, 1 FROM m) GROUP BY k),
e AS (SELECT k AS o_orderkey, concat_ws('|', CASE WHEN i = 0 THEN 'missing_in_inventory' END, CASE WHEN s = 0 THEN 'missing_in_status' END, CASE WHEN s > 1 THEN 'repeated_in_status' END, CASE WHEN m = 0 AND s > 0 THEN 'missing_manifest' END) AS errors FROM n) SELECT * FROM e WHERE errors <> ''""")
def release_population(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select("o_orderkey")
    status = k.where("o_orderkey % 11 <> 0").unionAll(k.where("o_orderkey % 23 = 0"))
    manifests = k.where("o_orderkey % 7 <> 0").unionAll(k.where("o_orderkey % 29 = 0").selectExpr("o_orderkey + 100000000 AS o_orderkey"))
    return rl.population(k, status, manifests, "o_orderkey").select("o_orderkey", F.array_join("errors", "|").alias("errors"))


@query("""WITH j AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 13 = 0 THEN 13 ELSE o_orderkey END AS batch_id FROM orders), w AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM j),
r AS (SELECT o_orderkey AS batch_id, o_orderstatus = 'F' AS done FROM orders WHERE o_orderkey % 5 <> 0) SELECT job, w.batch_id, CASE WHEN n > 1 THEN 'repeated_batch_id' WHEN done IS NULL THEN 'missing_record' WHEN NOT done THEN 'not_completed' ELSE 'completed' END AS state FROM w LEFT JOIN r USING (batch_id)""")
def batch_records(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    jobs = o.select(k.alias("job"), F.when(k % 13 == 0, 13).otherwise(k).alias("batch_id"))
    records = o.where(k % 5 != 0).select(k.alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return rl.fetched(jobs, records)


@query("""SELECT o_orderkey, o_orderstatus, 'only_first' AS side FROM orders WHERE o_orderkey % 31 = 0 UNION ALL SELECT o_orderkey, 'X', 'only_second' FROM orders WHERE o_orderkey % 31 = 0""")
def rebuild_differences(spark, sf_dir):
    """A table and its rebuild, which has another status in some rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return rl.differences(o, o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 31 == 0, "X").otherwise(F.col("o_orderstatus"))))


@query("""WITH l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations), r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE (conv_id * 5 + turn) % 17 <> 0)
SELECT conv_id, CAST(place AS INTEGER) AS place, l.turn AS left_key, r.turn AS right_key, coalesce(l.turn = r.turn, false) AS agrees FROM l FULL JOIN r USING (conv_id, place)""")
def zipped_rows(spark, sf_dir):
    """Rows of two tables by their place, and whether they are the same."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return rl.zipped(c, c.where("(conv_id * 5 + turn) % 17 <> 0"), "conv_id", "turn", "turn")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 37 = 0 THEN 'not_in_source' ELSE 'differs' END AS problem FROM orders WHERE o_orderkey % 3 = 0 AND (o_orderkey % 37 = 0 OR o_orderkey % 41 = 0)""")
def unequal_subset_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    part = o.where("o_orderkey % 3 = 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 41 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return rl.unequal_rows(part, o.where("o_orderkey % 37 <> 0"), "o_orderkey")


@query("""WITH d AS (SELECT p_partkey AS artifact, sha256(p_name) AS sha256, p_partkey % 4 AS version, CASE WHEN p_partkey % 6 = 0 THEN p_partkey - 1 + CASE WHEN p_partkey % 5 = 0 THEN 100000000 ELSE 0 END END AS parent FROM part),
e AS (SELECT artifact, concat_ws('|', CASE WHEN artifact % 19 = 0 THEN 'missing_artifact' END, CASE WHEN artifact % 19 <> 0 AND artifact % 17 = 0 THEN 'hash_differs' END, CASE WHEN version = 3 THEN 'version_not_allowed' END, CASE WHEN parent NOT IN (SELECT artifact FROM d) THEN 'unknown_parent' END) AS errors FROM d) SELECT * FROM e WHERE errors <> ''""")
def lineage_errors(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("long")
    sha = F.sha2(F.col("p_name"), 256)
    declared = p.select(k.alias("artifact"), sha.alias("sha256"), (k % 4).alias("version"), F.when(k % 6 == 0, k - 1 + F.when(k % 5 == 0, 100000000).otherwise(0)).alias("parent"))
    actual = p.where(k % 19 != 0).select(k.alias("artifact"), F.when(k % 17 == 0, F.sha2(F.lit("x"), 256)).otherwise(sha).alias("sha256"))
    return rl.lineage_errors(declared, actual, spark.range(3).withColumnRenamed("id", "version")).select("artifact", F.array_join("errors", "|").alias("errors"))


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT movie_key, frame, confidence * 0.65e0 + 0.1e0 * (frame % 2) + CASE WHEN frame % 13 = 0 THEN 0.01e0 WHEN frame % 29 = 0 THEN 1e0 ELSE 0 END AS score, confidence * 0.65e0 + 0.1e0 * (frame % 2) AS again FROM f), e AS (SELECT movie_key, frame, concat_ws('|', CASE WHEN score NOT BETWEEN 0 AND 1 THEN 'score_out_of_range' END, CASE WHEN abs(score - again) > 1e-6 THEN 'score_differs' END) AS errors FROM s) SELECT * FROM e WHERE errors <> ''""")
def recomputed_scores(spark, sf_dir):
    again = F.col("confidence") * 0.65 + (F.col("frame") % 2) * 0.1
    off = F.when(F.col("frame") % 13 == 0, 0.01).when(F.col("frame") % 29 == 0, 1.0).otherwise(0.0)
    return rl.recomputed(frames(spark, sf_dir).withColumn("score", again + off), ["movie_key", "frame"], "score", again).select("movie_key", "frame", F.array_join("errors", "|").alias("errors"))


_MOVIES = """mv AS (SELECT o_orderkey AS movie_id, CASE WHEN o_orderkey % 9 = 8 THEN 'RUNNING' WHEN o_orderkey % 8 = 0 THEN 'BLOCKED_WITH_EXPLICIT_REASON' ELSE 'COMPLETE' END AS status, CASE WHEN o_orderkey % 97 = 1 THEN 'b' ELSE 'a' END AS reviewer,
  count(*) AS alignment_rows, count(*) + CASE WHEN o_orderkey % 14 = 0 THEN 1 ELSE 0 END AS line_count, count(*) FILTER (WHERE l_returnflag = 'R') * 3 AS ambiguities, count(*) FILTER (WHERE l_quantity = 50) AS risks, o_orderkey % 15 <> 1 AS qc_passed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""
_GATES = """ge AS (SELECT movie_id, concat_ws('|', CASE WHEN status = 'RUNNING' THEN 'not_terminal' END, CASE WHEN status = 'COMPLETE' AND line_count <> alignment_rows THEN 'count_mismatch' END, CASE WHEN status = 'COMPLETE' AND risks <> 0 THEN 'open_risks' END,
  CASE WHEN status = 'COMPLETE' AND ambiguities > 5 THEN 'too_many_ambiguities' END, CASE WHEN status = 'COMPLETE' AND NOT qc_passed THEN 'qc_not_passed' END, CASE WHEN status = 'COMPLETE' AND (SELECT count(DISTINCT reviewer) > 1 FROM mv WHERE status = 'COMPLETE') THEN 'several_reviewers' END) AS errors FROM mv)"""


def _movies(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("movie_id")).agg(
        F.count("*").alias("alignment_rows"), (F.count_if(F.col("l_returnflag") == "R") * 3).alias("ambiguities"), F.count_if(F.col("l_quantity") == 50).alias("risks")
    )
    k = F.col("movie_id")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("movie_id")).join(li, "movie_id")
    status = F.when(k % 9 == 8, "RUNNING").when(k % 8 == 0, rl.BLOCKED).otherwise(rl.COMPLETE)
    return o.withColumns({"status": status, "reviewer": F.when(k % 97 == 1, "b").otherwise("a"), "line_count": F.col("alignment_rows") + F.when(k % 14 == 0, 1).otherwise(0), "qc_passed": k % 15 != 1})


@query(f"WITH {_MOVIES}, {_GATES} SELECT * FROM ge WHERE errors <> ''")
def release_gates(spark, sf_dir):
    return rl.release_gates(_movies(spark, sf_dir)).select("movie_id", F.array_join("errors", "|").alias("errors"))


@query(f"""WITH {_MOVIES}, {_GATES} SELECT count(*) AS movies, count(*) FILTER (WHERE status = 'COMPLETE') AS complete, count(*) FILTER (WHERE status = 'BLOCKED_WITH_EXPLICIT_REASON') AS blocked, (SELECT count(*) FROM ge WHERE errors <> '') AS failed,
  (SELECT count(*) FROM mv WHERE ambiguities > 0) AS packed, (SELECT count(*) = 0 FROM ge WHERE errors <> '') AS frozen FROM mv""")
def release_freeze(spark, sf_dir):
    m = _movies(spark, sf_dir)
    return rl.freeze(m, rl.release_gates(m), m.where("ambiguities > 0")).drop("digest")


@query("""WITH q AS (SELECT conv_id % 40 AS film, conv_id AS id FROM (SELECT DISTINCT conv_id FROM conversations)), p AS (SELECT film, id FROM q WHERE id % 50 <> 7 UNION ALL SELECT film, id FROM q WHERE id % 61 = 5),
c AS (SELECT coalesce(a.film, b.film) AS film, count(a.id) AS requests, count(*) FILTER (WHERE a.id IS NULL OR b.n IS NULL OR b.n <> 1) AS uncovered FROM q a FULL JOIN (SELECT film, id, count(*) AS n FROM p GROUP BY ALL) b ON a.film = b.film AND a.id = b.id GROUP BY 1),
r AS (SELECT conv_id % 40 AS film, count(*) FILTER (WHERE role = 'assistant') AS auto_aligned, count(*) FILTER (WHERE role = 'system') AS needs_review, count(*) FILTER (WHERE role = 'user') AS no_match, count(*) FILTER (WHERE conv_id % 80 = 3 AND role = 'user') AS risks FROM conversations GROUP BY 1)
SELECT film, requests, uncovered, auto_aligned, needs_review, no_match, risks, uncovered = 0 AND risks = 0 AND needs_review <= 5 AS passed FROM c FULL JOIN r USING (film)""")
def final_qc(spark, sf_dir):
    """Forty films of conversations; assistant turns are aligned, system turns open."""
    c = table(spark, sf_dir, "conversations")
    q = c.select((F.col("conv_id") % 40).alias("film"), F.col("conv_id").alias("request_id")).distinct()
    p = q.where("request_id % 50 <> 7").unionAll(q.where("request_id % 61 = 5"))
    status = F.when(F.col("role") == "assistant", "auto_aligned").when(F.col("role") == "system", "needs_review").otherwise("no_match")
    risk = F.when((F.col("conv_id") % 80 == 3) & (F.col("role") == "user"), "candidate_recall_risk")
    rows = c.select((F.col("conv_id") % 40).alias("film"), status.alias("status"), risk.alias("risk"))
    return rl.final_qc(q, p, rows, "film")


@query(f"""WITH {_R}, j AS (SELECT request_id, subtitle_id, a, coalesce(ab, []) AS ab, e, eb, subtitle_id % 3 = 0 AS has FROM r) SELECT request_id, subtitle_id, CASE WHEN NOT has THEN CASE WHEN a = 'match' THEN 'auto_aligned' ELSE 'needs_review' END WHEN e = 'match' THEN 'reviewed_match' WHEN e = 'no_match' THEN 'reviewed_no_match' ELSE 'needs_review' END AS status,
  array_to_string(CASE WHEN has AND e = 'match' THEN eb WHEN has AND e = 'no_match' THEN [] ELSE ab END, ',') AS blocks FROM j""")
def reviewed_alignment(spark, sf_dir):
    """A reviewer's decisions put into the alignment."""
    r = _resolutions(spark, sf_dir)
    rows = r.select("request_id", "subtitle_id", F.when(F.col("actual.decision") == "match", "auto_aligned").otherwise("needs_review").alias("status"), F.coalesce("actual.block_ids", F.array().cast("array<long>")).alias("block_ids"))
    decided = r.where("subtitle_id % 3 = 0").select("request_id", "subtitle_id", "expected.decision", "expected.block_ids")
    done = rl.reviewed(rows, decided, ["request_id", "subtitle_id"])
    return done.select("request_id", "subtitle_id", "status", F.array_join(F.transform("block_ids", lambda b: b.cast("string")), ",").alias("blocks"))


@query("""SELECT conv_id AS movie, text AS t, shots FROM (SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user') a JOIN (SELECT conv_id, turn, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS shots FROM (SELECT conv_id, turn, unnest(range(turn // 3, turn // 3 + turn % 3 + 1)) AS s FROM conversations) GROUP BY ALL) b USING (conv_id, turn)""")
def shots_of_subtitles(spark, sf_dir):
    """The other way round: of shots with lists of subtitles, the list of shots of each subtitle."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    shots = c.select("conv_id", F.explode(F.sequence(F.floor(t / 3), F.floor(t / 3) + t % 3)).alias("shot"), "turn").groupBy("conv_id", "shot").agg(F.collect_list("turn").alias("subtitles"))
    back = shots.select("conv_id", "shot", F.explode("subtitles").alias("turn")).groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list("shot")), lambda s: s.cast("string")), ",").alias("shots"))
    return c.where("role = 'user'").join(back, ["conv_id", "turn"]).select(F.col("conv_id").alias("movie"), F.col("text").alias("t"), "shots")


def best_candidate(request: dict) -> list[int]:
    """The best of the candidates from 0.5 on, of equal ones the first in script order."""
    ranked = sorted((-c["score"], c["block"]) for c in request["candidates"] if c["score"] >= 0.5)
    return [block for _, block in ranked[:1]]


@query("""WITH q AS (SELECT conv_id // 5 AS m, conv_id AS request_id, turn AS block, (turn * 53 + conv_id * 11) % 100 / 100e0 AS score FROM conversations), b AS (SELECT m, request_id, arg_min(block, (-score, block)) FILTER (WHERE score >= 0.5) AS b FROM q GROUP BY ALL)
SELECT CAST(m AS VARCHAR) AS movie_key, request_id, CASE WHEN b IS NULL THEN 'no_match' ELSE 'match' END AS decision, CAST(b AS VARCHAR) AS blocks FROM b""")
def plugged_resolver(spark, sf_dir):
    """A resolver plugged in as a table function, request by request."""
    c = table(spark, sf_dir, "conversations").withColumn("score", (F.col("turn") * 53 + F.col("conv_id") * 11) % 100 / 100.0)
    requests = c.groupBy(F.floor(F.col("conv_id") / 5).cast("string").alias("movie_key"), F.col("conv_id").cast("long").alias("request_id")).agg(F.collect_list(F.struct(F.col("turn").cast("long").alias("block"), "score")).alias("candidates"))
    found = pg.through(requests, lambda: pg.Resolver(best_candidate), ["movie_key"], ["request_id"], "movie_key string, request_id long, decision string, blocks array<long>")
    return found.withColumn("blocks", F.when(F.size("blocks") > 0, F.array_join(F.transform("blocks", lambda b: b.cast("string")), ",")))
