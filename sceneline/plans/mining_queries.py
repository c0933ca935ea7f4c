"""The mining run over films: five conversations are a film, a turn is a shot of three and a half seconds, events are frames with faces.

The run is made twice: over tables in which some films have other texts or other frames, and then
over the tables as they are.  The second run computes these films again and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneline.operators import minerun as mr
from sceneline.operators import mining as mn
from sceneline.operators import samples as sm
from sceneline.operators import sequences as sq
from sceneline.plans.analogs import table
from sceneline.sources.scratch import scratch_path

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Rules of evidence on words of the tables, and the least score of a shot that is selected.
RULES = (("tears_v1", "emotion", r"\bfor\b"), ("turns_v1", "reaction", r"\bthis\b"), ("quarrel_v1", "conflict", r"\b(?:was|but)\b"))
LEAST_SCORE = 0.35


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def sources(spark, sf_dir) -> dict[str, DataFrame]:
    """shots (movie_key, scene, shot, role, text, start, end) and frames (movie_key, shot, face_count, max_face_area_ratio, usable)."""
    c = table(spark, sf_dir, "conversations").withColumn("movie_key", F.expr("conv_id div 5"))
    shot = F.row_number().over(Window.partitionBy("movie_key").orderBy("conv_id", "turn")).cast("long")
    shots = c.select("movie_key", F.col("conv_id").alias("scene"), "turn", shot.alias("shot"), "role", "text")
    e = table(spark, sf_dir, "events")
    face = F.when(F.col("event_type") == "error", 0).otherwise((F.floor("value") % 3).cast("int"))
    frames = e.select((F.col("user_id") % 40).alias("movie_key"), (F.col("event_id") % 30 + 1).alias("shot"), face.alias("face_count"), (F.col("value") / 1000).alias("max_face_area_ratio"), (F.col("event_type") != "error").alias("usable"))
    return {"shots": shots.withColumns({"start": (F.col("shot") - 1) * 4.0, "end": (F.col("shot") - 1) * 4.0 + 3.5}), "frames": frames}


def evidence(shots: DataFrame) -> DataFrame:
    """Shots with what speaks for them: scores of evidence and of relevance, and why one is left out."""
    w = Window.partitionBy("movie_key").orderBy("shot")
    found = shots.withColumn("categories", F.array_distinct(F.transform(mn.rule_matches(F.coalesce("text", F.lit("")), list(RULES)), lambda m: m["category"])))
    hit, spoken = F.size("categories") > 0, F.col("role") == "user"
    near = F.coalesce(F.lag(hit).over(w), F.lit(False)) | F.coalesce(F.lead(hit).over(w), F.lit(False))
    speakers = F.when(F.lag("role").over(w) != F.col("role"), 2).otherwise(1)
    found = found.withColumns({"action_during": hit & ~spoken, "action_near": near, "subtitle": hit & spoken, "n_speakers": speakers, "context": F.size("categories") / len(RULES), "speakers": F.array("role"), "during": F.lit(None).cast("string"), "near": F.lit(None).cast("string")})
    scored = mn.semantic_score(found.withColumn("roles", F.col("speakers")).withColumn("speakers", F.col("n_speakers"))).withColumn("speakers", F.col("roles"))
    relevant = mn.target_relevance(scored, ["assistant"])
    pending = F.length(F.coalesce("text", F.lit(""))) < 20
    return relevant.select("movie_key", "scene", "shot", "start", "end", "categories", "semantic_score", "relevance", "band", mn.exclusion(pending, F.col("turn") == 0, F.col("scene")).alias("excluded"))


def selection(evidence: DataFrame, frames: DataFrame) -> DataFrame:
    """Every shot with its score, whether it is selected, and its rank among those of the film."""
    faces = mn.face_score(frames.withColumn("shot_id", F.struct("movie_key", "shot"))).select("shot_id.*", "face_score", "ineligible")
    both = evidence.join(faces, ["movie_key", "shot"], "left").withColumn("ineligible", F.when(F.col("face_score").isNull(), "too_few_usable_frames").otherwise(F.col("ineligible")))
    kept = F.col("excluded").isNull() & (F.col("semantic_score") >= LEAST_SCORE) & (F.col("band") != "none") & F.col("ineligible").isNull()
    score = mn.shot_score(F.col("semantic_score"), F.coalesce("face_score", F.lit(0.0)), F.col("relevance"))
    both = both.withColumns({"selected": kept, "score": F.round(score, 6)})
    rank = F.row_number().over(Window.partitionBy("movie_key", "selected").orderBy(F.desc("score"), "start", "shot"))
    return both.select("movie_key", "scene", "shot", "start", "end", "categories", "score", "selected", F.when(F.col("selected"), rank).alias("target_rank"))


def grouping(selection: DataFrame) -> DataFrame:
    """Events of selected shots of a scene, with one shot between them at most."""
    return mn.event_summary(sq.bridged_sessions(selection, "movie_key", "shot", "selected", "scene", "start", "end", 4.0), ["movie_key", "event"])


STAGES = [
    mr.Stage("evidence", ("shots",), evidence, {"rules": [list(r) for r in RULES], "version": 1}),
    mr.Stage("selection", ("evidence", "frames"), selection, {"least": LEAST_SCORE, "version": 1}),
    mr.Stage("grouping", ("selection",), grouping, {"bridge": 4.0, "version": 1}),
]


def twice(spark, sf_dir) -> str:
    """The folder of the two runs."""
    now, root = sources(spark, sf_dir), scratch_path(spark, "mining")
    text = F.when(F.col("movie_key") % 7 == 3, F.upper("text")).otherwise(F.col("text"))
    usable = F.col("usable") & (F.col("movie_key") % 7 != 5)
    mr.resume(spark, root, {"shots": now["shots"].withColumn("text", text), "frames": now["frames"].withColumn("usable", usable)}, STAGES)
    mr.resume(spark, root, now, STAGES)
    return root


_MATCHES = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{c}' END" for _, c, p in RULES)
_MINED = f"""c AS (SELECT conv_id // 5 AS movie_key, conv_id AS scene, turn, CAST(row_number() OVER (PARTITION BY conv_id // 5 ORDER BY conv_id, turn) AS BIGINT) AS shot, role, text FROM conversations),
h AS (SELECT *, (shot - 1) * 4.0e0 AS s, (shot - 1) * 4.0e0 + 3.5e0 AS e, list_filter([{_MATCHES}], lambda x: x IS NOT NULL) AS cats FROM c),
n AS (SELECT *, len(cats) > 0 AS hit, coalesce(lag(len(cats) > 0) OVER w, false) OR coalesce(lead(len(cats) > 0) OVER w, false) AS near, coalesce(lag(role) OVER w <> role, false) AS other,
  coalesce(lag(role) OVER w = 'assistant' AND lag(scene) OVER w = scene, false) OR coalesce(lead(role) OVER w = 'assistant' AND lead(scene) OVER w = scene, false) AS beside FROM h WINDOW w AS (PARTITION BY movie_key ORDER BY shot)),
v AS (SELECT *, least(1e0, CASE WHEN hit AND role <> 'user' THEN 0.45e0 WHEN near THEN 0.30e0 ELSE 0e0 END + CASE WHEN hit AND role = 'user' THEN 0.25e0 ELSE 0e0 END + CASE WHEN other THEN 0.20e0 ELSE 0e0 END + 0.10e0 * (len(cats) / {len(RULES)})) AS semantic,
  CASE WHEN role = 'assistant' THEN 1e0 WHEN regexp_matches(lower(text), '(?:^|[^a-z0-9])assistant(?:[^a-z0-9]|$)') THEN 0.85e0 WHEN beside THEN 0.45e0 ELSE 0e0 END AS relevance FROM n),
fr AS (SELECT user_id % 40 AS movie_key, event_id % 30 + 1 AS shot, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) % 3 END AS n, value / 1000 AS area, event_type <> 'error' AS ok FROM events),
fs AS (SELECT movie_key, shot, 0.5e0 * avg((n > 0)::INT) + 0.25e0 * least(1e0, max(area) / 0.1e0) + 0.15e0 * avg(ok::INT) + CASE WHEN min(n) = max(n) THEN 0.1e0 ELSE 0 END AS face,
  count(*) FILTER (WHERE ok) >= 2 AND count(*) FILTER (WHERE n > 0) >= 2 AND max(area) >= 0.005 AS fit FROM fr GROUP BY ALL),
sel AS (SELECT v.*, round(0.65e0 * semantic + 0.25e0 * coalesce(face, 0) + 0.10e0 * relevance, 6) AS score,
  length(coalesce(text, '')) >= 20 AND turn <> 0 AND semantic >= {LEAST_SCORE}e0 AND relevance >= 0.45e0 AND coalesce(fit, false) AS selected FROM v LEFT JOIN fs USING (movie_key, shot))"""


@query(f"""WITH {_MINED} SELECT movie_key, shot, score, CAST(row_number() OVER (PARTITION BY movie_key ORDER BY score DESC, s, shot) AS INTEGER) AS target_rank, CASE WHEN movie_key % 7 = 3 THEN 2 ELSE 1 END AS evidence_run FROM sel WHERE selected""")
def mining_run_shots(spark, sf_dir):
    """Selected shots by rank, and the run that computed their film's evidence."""
    root = twice(spark, sf_dir)
    run = mr.films(spark, root, "evidence").select("movie_key", F.col("run").alias("evidence_run"))
    return mr.rows(spark, root, "selection").where("selected").join(run, "movie_key").select("movie_key", "shot", "score", "target_rank", "evidence_run")


@query(f"""WITH {_MINED}, k AS (SELECT *, lag(scene) OVER w AS scene1, lag(e - s) OVER w AS len1 FROM sel WINDOW w AS (PARTITION BY movie_key ORDER BY shot)),
p AS (SELECT *, lag(shot) OVER w AS shot0, lag(scene) OVER w AS scene0 FROM k WHERE selected WINDOW w AS (PARTITION BY movie_key ORDER BY shot)),
ev AS (SELECT *, CAST(sum(CASE WHEN scene = scene0 AND (shot - shot0 = 1 OR shot - shot0 = 2 AND scene1 = scene AND len1 <= 4) THEN 0 ELSE 1 END) OVER (PARTITION BY movie_key ORDER BY shot) AS BIGINT) AS event FROM p),
g AS (SELECT movie_key, event, count(*) AS members, min(s) AS "start", max(e) AS "end", sum(score * (e - s)) / sum(e - s) AS weighted, sum(len(cats)) AS held, len(list_distinct(flatten(list(cats)))) AS kinds FROM ev GROUP BY ALL)
SELECT movie_key, event, members, "start", "end", round(least(1e0, weighted + 0.05e0 * CASE WHEN members > 1 AND kinds > 0 THEN held / (members * kinds) ELSE 0 END), 5) AS event_score FROM g""")
def mining_run_events(spark, sf_dir):
    """Events of the selected shots."""
    events = mr.rows(spark, twice(spark, sf_dir), "grouping")
    return events.select("movie_key", "event", "members", "start", "end", F.round("event_score", 5).alias("event_score"))


def _screened(spark, sf_dir) -> DataFrame:
    """Every shot with its selection, band and the reason it is left out."""
    now = sources(spark, sf_dir)
    found = evidence(now["shots"])
    return selection(found, now["frames"]).join(found.select("movie_key", "shot", "semantic_score", "band", "excluded"), ["movie_key", "shot"])


#: Shots of a stratum and of the sample of a film.
_EACH, _TOTAL = 5, 16
_SPREAD = "row_number() OVER (PARTITION BY movie_key, {c}, scene ORDER BY s, shot) = 1"


def _stratum_sql(k: int, label: str, condition: str, order: str, limit: int) -> str:
    """Items of stratum k that no earlier one has, in SQL."""
    old = " UNION ALL ".join(f"SELECT movie_key, item FROM t{j}" for j in range(k))
    left = f"AND NOT EXISTS (SELECT 1 FROM ({old}) o WHERE o.movie_key = a.movie_key AND o.item = a.item)" if k else ""
    return f"""t{k} AS (SELECT movie_key, item, {k} AS k, '{label}' AS stratum, row_number() OVER (PARTITION BY movie_key ORDER BY {order}) AS place FROM a WHERE {condition} {left} QUALIFY place <= {limit})"""


def _sample_sql(strata: list[tuple[str, str, str, int]], total: int, item: str) -> str:
    parts = ", ".join(_stratum_sql(k, *s) for k, s in enumerate(strata))
    every = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(len(strata)))
    return f"""{parts} SELECT movie_key, item AS {item}, stratum, CAST(row_number() OVER (PARTITION BY movie_key ORDER BY k, place) AS INTEGER) AS ordinal FROM ({every}) QUALIFY ordinal <= {total}"""


_BAND = "CASE WHEN relevance >= 0.8 THEN 'high' WHEN relevance >= 0.45 THEN 'medium' ELSE 'none' END"
_HASH = "sha256('{s}' || chr(31) || movie_key || chr(31) || item)"


@query(f"""WITH {_MINED}, b AS (SELECT *, shot AS item, {_BAND} AS band, length(coalesce(text, '')) < 20 OR turn = 0 AS excluded FROM sel),
f AS (SELECT *, band = 'none' AS none, band = 'high' AND selected AS high, band = 'medium' AND selected AS medium, NOT selected AND NOT excluded AND band <> 'none' AND semantic >= {LEAST_SCORE}e0 AS visual FROM b),
a AS (SELECT *, {_SPREAD.format(c="high")} AS f0, {_SPREAD.format(c="medium")} AS f1, {_SPREAD.format(c="visual")} AS f2 FROM f),
{_sample_sql([("high_selected", "high", "NOT f0, CASE WHEN f0 THEN s END NULLS FIRST, shot", _EACH), ("medium_selected", "medium", "NOT f1, CASE WHEN f1 THEN s END NULLS FIRST, shot", _EACH), ("visual_excluded", "visual", "NOT f2, CASE WHEN f2 THEN s END NULLS FIRST, shot", _EACH), ("target_none_random", "none", _HASH.format(s="none"), 3), ("target_none_strong", "none", "round(semantic, 9) DESC, shot", 2)], _TOTAL, "shot")}""")
def review_shot_sample(spark, sf_dir):
    """Shots to review: selected ones of high and medium relevance and ones without a face, spread over scenes, then shots without the target."""
    rows = _screened(spark, sf_dir)
    visual = ~F.col("selected") & F.col("excluded").isNull() & (F.col("band") != "none") & (F.col("semantic_score") >= LEAST_SCORE)
    spread = lambda c: sm.spread(c, "movie_key", "scene", ["start"], ["shot"])
    high, medium, none = F.col("selected") & (F.col("band") == "high"), F.col("selected") & (F.col("band") == "medium"), F.col("band") == "none"
    strata = [
        sm.Stratum("high_selected", high, spread(high), _EACH), sm.Stratum("medium_selected", medium, spread(medium), _EACH), sm.Stratum("visual_excluded", visual, spread(visual), _EACH),
        sm.Stratum("target_none_random", none, (sm.shuffled("none", "movie_key", "shot"),), 3), sm.Stratum("target_none_strong", none, (F.desc(F.round("semantic_score", 9)), F.col("shot")), 2),
    ]
    return sm.take_unique(rows, "movie_key", "shot", strata, _TOTAL)


_ENDED = SQL["mining_run_events"].removeprefix("WITH ").rsplit("SELECT movie_key, event, members", 1)


@query(f"""WITH {_ENDED[0]}, a AS (SELECT *, event AS item FROM (SELECT movie_key, event, members{_ENDED[1]})), {_sample_sql([("top_ranked", "true", "event_score DESC, item", 2), ("single_shot", "members = 1", "event_score DESC, item", 2), ("multi_shot", "members > 1", "event_score DESC, item", 2), ("near_limit", "true", 'abs("end" - "start" - 30), item', 2), ("random", "true", _HASH.format(s="events"), 2), ("ranked_fill", "true", "event_score DESC, item", 12)], 12, "event")}""")
def review_event_sample(spark, sf_dir):
    """Events to review: the best, single and joined shots, those near the longest span, random ones, then the next best."""
    now = sources(spark, sf_dir)
    rows = grouping(selection(evidence(now["shots"]), now["frames"])).withColumn("event_score", F.round("event_score", 5))
    best, always = (F.desc("event_score"), F.col("event")), F.lit(True)
    strata = [
        sm.Stratum("top_ranked", always, best, 2), sm.Stratum("single_shot", F.col("members") == 1, best, 2), sm.Stratum("multi_shot", F.col("members") > 1, best, 2),
        sm.Stratum("near_limit", always, (F.abs(F.col("end") - F.col("start") - 30.0), F.col("event")), 2), sm.Stratum("random", always, (sm.shuffled("events", "movie_key", "event"),), 2), sm.Stratum("ranked_fill", always, best, 12),
    ]
    return sm.take_unique(rows, "movie_key", "event", strata, 12)
