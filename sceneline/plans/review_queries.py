"""Queries of the review loop, audits and mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneline.operators import audits as au
from sceneline.operators import review as rv
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


# An event is a subtitle; its number modulo fifty is where it was mapped to, errors are not mapped.
_MAP = f"""{FRAMES_SQL}, m AS (SELECT movie_key, frame, CASE WHEN event_type <> 'error' THEN frame // 2 + event_id % 5 END AS first, CASE WHEN event_type <> 'error' THEN frame // 2 + event_id % 5 + event_id % 2 END AS last,
  event_id % 3 = 0 AS by_model, frame // 20 AS scene, CASE WHEN event_id % 4 = 0 THEN 'reorder' ELSE 'text' END AS basis FROM f)"""


def mapped(spark, sf_dir):
    at = F.when(F.col("event_type") != "error", F.expr("frame div 2 + event_id % 5"))
    return frames(spark, sf_dir).select(
        "movie_key", "frame", at.alias("first"), (at + F.col("event_id") % 2).alias("last"), (F.col("event_id") % 3 == 0).alias("by_model"), F.expr("frame div 20").alias("scene"), F.when(F.col("event_id") % 4 == 0, "reorder").otherwise("text").alias("basis")
    )


@query(f"""WITH {_MAP}, p AS (SELECT *, lag(first) OVER w AS pf, lag(last) OVER w AS pl, lag(by_model) OVER w AS pb, lag(frame) OVER w AS pframe FROM m WHERE first IS NOT NULL WINDOW w AS (PARTITION BY movie_key ORDER BY frame))
SELECT movie_key, frame, first < pf AS start_regression, last < pl AS end_regression, CASE WHEN pb AND NOT by_model THEN pframe ELSE frame END AS target, pframe AS previous FROM p WHERE first < pf OR last < pl""")
def sequence_regressions(spark, sf_dir):
    r = au.sequence_regressions(mapped(spark, sf_dir), "movie_key", ["frame"], "first", "last", "by_model")
    return r.withColumns({"target": F.col("target.frame"), "previous": F.col("previous.frame")})


@query(f"""WITH {_MAP}, p AS (SELECT *, lag(scene) OVER w AS ps, lag(first) OVER w AS pf, lag(last) OVER w AS pl FROM m WHERE first IS NOT NULL WINDOW w AS (PARTITION BY movie_key ORDER BY frame)),
d AS (SELECT *, greatest(0, pf - first, pl - last) AS dist FROM p WHERE pf IS NOT NULL)
SELECT movie_key, frame, 'cross_scene' AS event, 'high_risk' AS severity, CAST(0 AS BIGINT) AS distance FROM d WHERE scene <> ps
UNION ALL SELECT movie_key, frame, 'repeat', 'info', 0 FROM d WHERE first = pf AND last = pl
UNION ALL SELECT movie_key, frame, 'backward', CASE WHEN dist > 3 OR scene <> ps THEN 'high_risk' WHEN basis = 'reorder' THEN 'info' ELSE 'warning' END, dist FROM d WHERE dist > 0
UNION ALL SELECT movie_key, frame, 'forward_jump', 'warning', first - pl FROM d WHERE dist = 0 AND first - pl > 3""")
def sequence_events(spark, sf_dir):
    return au.sequence_events(mapped(spark, sf_dir), "movie_key", ["frame"], "scene", "first", "last", "basis")


_IV = f"""{FRAMES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY movie_key) AS total, last_value(CASE WHEN event_type = 'purchase' THEN frame + event_id % 7 END IGNORE NULLS) OVER (PARTITION BY movie_key ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  first_value(CASE WHEN event_type = 'purchase' THEN frame + event_id % 7 END IGNORE NULLS) OVER (PARTITION BY movie_key ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM f),
c AS (SELECT *, CAST(round_even(frame / total * (total - 1), 0) AS BIGINT) AS centre FROM n WHERE event_type = 'error')"""


@query(f"""WITH {_IV} SELECT movie_key, frame,
  CASE WHEN l IS NULL AND r IS NULL OR l > r THEN greatest(0, centre - 120) WHEN l IS NOT NULL THEN l ELSE greatest(0, r - 240) END AS low,
  CASE WHEN l IS NULL AND r IS NULL OR l > r THEN least(total - 1, centre + 120) WHEN r IS NOT NULL THEN r ELSE least(total - 1, l + 240) END AS high,
  CASE WHEN l IS NULL AND r IS NULL THEN 'fallback_timeline_estimate' WHEN l > r THEN 'fallback_nonmonotonic_anchor_interval' WHEN l IS NOT NULL AND r IS NOT NULL AND abs(r // 20 - l // 20) > 1 THEN 'fallback_between_reliable_anchors'
    WHEN l IS NOT NULL AND r IS NOT NULL THEN 'between_reliable_anchors' WHEN l IS NOT NULL THEN 'fallback_after_reliable_anchor' ELSE 'fallback_before_reliable_anchor' END AS reason FROM c""")
def candidate_intervals(spark, sf_dir):
    from sceneline.operators.sequences import nearest_where

    f = frames(spark, sf_dir).withColumn("total", F.count("*").over(Window.partitionBy("movie_key")))
    f = nearest_where(f, "movie_key", ["frame"], F.col("event_type") == "purchase", F.col("frame") + F.col("event_id") % 7, "l", "r").where("event_type = 'error'")
    iv = rv.candidate_interval(F.col("l"), F.col("r"), F.col("total"), F.expr("l div 20"), F.expr("r div 20"), F.col("frame") / F.col("total"))
    return f.withColumn("iv", iv).select("movie_key", "frame", "iv.low", "iv.high", "iv.reason")


@query("""WITH r AS (SELECT l_orderkey AS k, l_suppkey AS item, l_linenumber AS o, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS priority, l_extendedprice AS score FROM lineitem),
f AS (SELECT k, item, priority, score, o, row_number() OVER (PARTITION BY k, item ORDER BY priority, score DESC, o) AS j FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, score DESC, o, item) AS q FROM f WHERE j = 1)
SELECT k, item, priority, CAST(row_number() OVER (PARTITION BY k ORDER BY o, item) AS INTEGER) AS place FROM g WHERE q <= 3""")
def merge_candidates(spark, sf_dir):
    p = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    li = table(spark, sf_dir, "lineitem")
    r = li.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("o"), p.alias("priority"), F.col("l_extendedprice").alias("score"))
    return rv.merge_candidates(r, "k", "item", "priority", "score", "o", 3)


@query("""SELECT conv_id AS request_id, CASE WHEN n = 0 THEN 'difficult' WHEN n > 4 THEN 'multi' WHEN s < 0.82 THEN 'fuzzy' ELSE 'easy' END AS stratum, CASE WHEN m < 1.0e0 / 3 THEN 'early' WHEN m < 2.0e0 / 3 THEN 'middle' ELSE 'late' END AS region
FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS n, avg(turn) / count(*) AS m, count(*) FILTER (WHERE role = 'user') / count(*) AS s FROM conversations GROUP BY 1)""")
def request_strata(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(
        F.count_if(F.col("role") == "assistant").alias("n"), F.avg("turn").alias("m"), F.count("*").alias("total"), (F.count_if(F.col("role") == "user") / F.count("*")).alias("s")
    )
    matches = F.when(F.col("n") == 0, 0).when(F.col("n") > 4, 2).otherwise(1)
    return c.select("request_id", rv.strata(F.lit(True), matches, F.col("s")).alias("stratum"), rv.region(F.col("m"), F.col("total")).alias("region"))


@query("""SELECT conv_id AS request_id, '{"custom_id":"' || conv_id || '","method":"POST","body":{"model":"reviewer","input":"{\\"turns\\":' || count(*) || ',\\"first\\":' || min(turn) || '}"}}' AS line FROM conversations GROUP BY conv_id""".replace("\\\\", "\\"))
def request_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.count("*").alias("turns"), F.min("turn").alias("first"))
    lines = rv.request_lines(c, ["turns", "first"], "reviewer")
    return lines.select(F.get_json_object("line", "$.custom_id").cast("long").alias("request_id"), "line")


@query(f"""WITH {FRAMES_SQL}, w AS (SELECT movie_key, frame, confidence * 0.65e0 + CASE WHEN event_type = 'view' THEN 0.25e0 ELSE 0 END + 0.10e0 * (frame % 2) AS score, pts FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY movie_key ORDER BY score DESC, pts, frame) AS target_rank FROM w) SELECT movie_key, frame, round(score, 8) AS score, CAST(target_rank AS INTEGER) AS target_rank FROM r WHERE target_rank <= 10""")
def performance_rank(spark, sf_dir):
    """Weighted score of a shot; rank by score, then time, then id."""
    score = F.col("confidence") * 0.65 + F.when(F.col("event_type") == "view", 0.25).otherwise(0.0) + (F.col("frame") % 2) * 0.10
    w = Window.partitionBy("movie_key").orderBy(F.desc("score"), "pts", "frame")
    f = frames(spark, sf_dir).withColumn("score", score).withColumn("target_rank", F.row_number().over(w)).where("target_rank <= 10")
    return f.select("movie_key", "frame", F.round("score", 8).alias("score"), "target_rank")


@query(f"""WITH {FRAMES_SQL} SELECT movie_key, CASE WHEN count(*) FILTER (WHERE confidence > 0.01) < 2 THEN 'too_few_usable' WHEN count(*) FILTER (WHERE confidence > 0.4) < 2 THEN 'too_few_faces' WHEN max(confidence) < 0.5 THEN 'face_too_small' ELSE 'eligible' END AS reason,
  round(0.5e0 * avg(CASE WHEN confidence > 0.4 THEN 1.0e0 ELSE 0 END) + 0.25e0 * least(1.0e0, max(confidence) / 0.5e0) + 0.15e0 * avg(CASE WHEN confidence > 0.01 THEN 1.0e0 ELSE 0 END), 6) AS face_score FROM f GROUP BY 1""")
def visual_eligibility(spark, sf_dir):
    """The first failing rule is the reason; the score is a weighted sum of shares."""
    usable, face = F.col("confidence") > 0.01, F.col("confidence") > 0.4
    reason = F.when(F.count_if(usable) < 2, "too_few_usable").when(F.count_if(face) < 2, "too_few_faces").when(F.max("confidence") < 0.5, "face_too_small").otherwise("eligible")
    score = 0.5 * F.avg(face.cast("double")) + 0.25 * F.least(F.lit(1.0), F.max("confidence") / 0.5) + 0.15 * F.avg(usable.cast("double"))
    return frames(spark, sf_dir).groupBy("movie_key").agg(reason.alias("reason"), F.round(score, 6).alias("face_score"))
