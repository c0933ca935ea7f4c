"""Queries over frames, shots and subtitles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneline.operators import intervals as iv
from sceneline.operators import plugs as pg
from sceneline.operators import sequences as sq
from sceneline.plans.analogs import FRAMES_SQL, SHOTS_SQL, SUBTITLES_SQL, frames, shots, subtitles
from sceneline.sources.scratch import scratch_path
from sceneline.streaming.bridges import SESSIONS, keyed_timers, stream_bridges

QUERIES: dict = {}
SQL: dict[str, str] = {}
BIN = 12 * 3600.0
THRESHOLD = 0.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BOUNDARIES = f"""{FRAMES_SQL}, r AS (
  SELECT *, sum(CASE WHEN confidence > {THRESHOLD} THEN 0 ELSE 1 END) OVER (PARTITION BY movie_key ORDER BY frame) AS cold FROM f
), bd AS (
  SELECT movie_key, frame, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY movie_key, cold ORDER BY confidence DESC, frame) AS k FROM r WHERE confidence > {THRESHOLD}
  ) WHERE k = 1 AND frame > 0
)"""
_RANGES = f"""{_BOUNDARIES}, n AS (SELECT movie_key, count(*) AS n FROM f GROUP BY movie_key), p AS (
  SELECT movie_key, CAST(0 AS BIGINT) AS frame, CAST(NULL AS DOUBLE) AS confidence FROM n
  UNION ALL SELECT movie_key, frame, confidence FROM bd
  UNION ALL SELECT movie_key, n, NULL FROM n
), rg AS (
  SELECT movie_key, printf('shot_%06d', row_number() OVER w) AS shot_id, frame AS start_frame, lead(frame) OVER w AS end_frame,
         confidence AS boundary_before_confidence, lead(confidence) OVER w AS boundary_after_confidence
  FROM p WINDOW w AS (PARTITION BY movie_key ORDER BY frame)
)"""


def boundaries(spark, sf_dir):
    return sq.run_apexes(frames(spark, sf_dir), THRESHOLD)


def ranges(spark, sf_dir):
    f = frames(spark, sf_dir)
    return sq.ranges_from_boundaries(sq.run_apexes(f, THRESHOLD), sq.frame_counts(f))


@query(f"WITH {_BOUNDARIES} SELECT * FROM bd")
def shot_boundaries(spark, sf_dir):
    return boundaries(spark, sf_dir)


@query(f"""WITH {_RANGES} SELECT movie_key, shot_id, start_frame, end_frame, end_frame - start_frame AS frame_count,
  CAST(floor((start_frame + end_frame - 1) / 2) AS BIGINT) AS keyframe_frame, boundary_before_confidence, boundary_after_confidence FROM rg WHERE end_frame > start_frame""")
def shot_ranges(spark, sf_dir):
    return ranges(spark, sf_dir)


@query(f"""WITH {_RANGES}, t AS (
  SELECT rg.movie_key, (SELECT 1) AS one, b.pts - a.pts AS d FROM rg JOIN f a ON a.movie_key = rg.movie_key AND a.frame = rg.start_frame
  JOIN f b ON b.movie_key = rg.movie_key AND b.frame = rg.end_frame - 1 WHERE rg.end_frame > rg.start_frame
) SELECT movie_key, count(*) AS shots, round(avg(d), 4) AS mean_sec, round(median(d), 4) AS median_sec, count(*) FILTER (WHERE d < 3600) AS short_shots FROM t GROUP BY movie_key""")
def shot_duration_summary(spark, sf_dir):
    f = frames(spark, sf_dir).select("movie_key", "frame", "pts")
    r = ranges(spark, sf_dir)
    at = lambda name, frame: f.select("movie_key", F.col("frame").alias(frame), F.col("pts").alias(name))
    t = r.withColumn("last_frame", F.col("end_frame") - 1).join(at("t0", "start_frame"), ["movie_key", "start_frame"]).join(at("t1", "last_frame"), ["movie_key", "last_frame"])
    d = F.col("t1") - F.col("t0")
    return t.groupBy("movie_key").agg(F.count("*").alias("shots"), F.round(F.avg(d), 4).alias("mean_sec"), F.round(F.median(d), 4).alias("median_sec"), F.count_if(d < 3600).alias("short_shots"))


@query(f"""WITH {FRAMES_SQL}, d AS (
  SELECT movie_key, pts - lag(pts) OVER (PARTITION BY movie_key ORDER BY frame) AS delta, count(*) OVER (PARTITION BY movie_key) AS n FROM f
) SELECT movie_key, max(n) AS frames, round(coalesce(median(CASE WHEN delta > 0 THEN delta END), 0), 4) AS median_delta,
  round(coalesce(avg(CASE WHEN delta > 0 THEN CASE WHEN abs(delta - 21600) <= 10800 THEN 1.0 ELSE 0.0 END END), 1.0), 6) AS matched,
  coalesce(avg(CASE WHEN delta > 0 THEN CASE WHEN abs(delta - 21600) <= 10800 THEN 1.0 ELSE 0.0 END END), 1.0) < 0.999 AS is_vfr
FROM d GROUP BY movie_key""")
def timeline_vfr_flag(spark, sf_dir):
    """Nominal distance six hours, tolerance three."""
    w = Window.partitionBy("movie_key").orderBy("frame")
    d = frames(spark, sf_dir).withColumn("delta", F.col("pts") - F.lag("pts").over(w))
    d = d.withColumn("delta", F.when(F.col("delta") > 0, F.col("delta")))
    matched = F.coalesce(F.avg((F.abs(F.col("delta") - 21600) <= 10800).cast("double")), F.lit(1.0))
    return d.groupBy("movie_key").agg(
        F.count("*").alias("frames"), F.round(F.coalesce(F.median("delta"), F.lit(0.0)), 4).alias("median_delta"), F.round(matched, 6).alias("matched"), (matched < 0.999).alias("is_vfr")
    )


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT movie_key, max(frame) + 1 AS n FROM f GROUP BY movie_key), w AS (
  SELECT movie_key, n, unnest(generate_series(0, CAST(floor((n - 1) / 50) AS BIGINT))) AS "window" FROM n
) SELECT movie_key, "window", greatest(0, least("window" * 50 - 25, n - 1)) AS first_frame, greatest(0, least("window" * 50 + 74, n - 1)) AS last_frame,
  CAST(100 AS INTEGER) AS size, CAST(list_sum(list_transform(generate_series("window" * 50 - 25, "window" * 50 + 74), lambda i: greatest(0, least(i, n - 1)))) AS BIGINT) AS index_sum FROM w""")
def sliding_frame_windows(spark, sf_dir):
    w = sq.sliding_windows(frames(spark, sf_dir))
    return w.select(
        "movie_key",
        "window",
        F.element_at("frames", 1).alias("first_frame"),
        F.element_at("frames", -1).alias("last_frame"),
        F.size("frames").alias("size"),
        F.aggregate("frames", F.lit(0).cast("long"), lambda a, x: a + x).alias("index_sum"),
    )


@query(f"""WITH {_BOUNDARIES}, e AS (
  SELECT *, row_number() OVER (PARTITION BY movie_key ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY movie_key) AS n FROM bd
), ev AS (SELECT movie_key, frame FROM e WHERE n <= 4 OR pos IN (0, round_even((n - 1) / 3, 0), round_even(2 * (n - 1) / 3, 0), n - 1)), u AS (
  SELECT movie_key, frame, 0 AS part, row_number() OVER (PARTITION BY movie_key ORDER BY confidence, frame) AS rank FROM bd WHERE confidence < 0.6
  UNION ALL SELECT movie_key, frame, 1, row_number() OVER (PARTITION BY movie_key ORDER BY frame) FROM ev
), m AS (SELECT movie_key, frame, min(part * 1000000 + rank) AS p FROM u GROUP BY ALL), k AS (
  SELECT movie_key, frame, row_number() OVER (PARTITION BY movie_key ORDER BY p) AS admitted FROM m
) SELECT movie_key, frame, CAST(admitted AS INTEGER) AS admitted FROM k WHERE admitted <= 6""")
def qc_boundary_priority(spark, sf_dir):
    b = boundaries(spark, sf_dir)
    low, even = b.where("confidence < 0.6"), sq.even_sample(b, "movie_key", ["frame"], 4)
    return sq.priority_selection([low, even], "movie_key", "frame", [["confidence", "frame"], ["frame"]], 6)


_OVERLAP = f"""{SHOTS_SQL}, {SUBTITLES_SQL}, o AS (
  SELECT movie_key, shot, subtitle, scene, start, "end", sub_start, sub_end, least("end", sub_end) - greatest(start, sub_start) AS overlap
  FROM s JOIN u USING (movie_key) WHERE sub_start < "end" AND sub_end > start AND least("end", sub_end) - greatest(start, sub_start) > 0
)"""


def overlaps(spark, sf_dir):
    return iv.interval_join(shots(spark, sf_dir), subtitles(spark, sf_dir), ["movie_key"], BIN)


@query(f"""WITH {_OVERLAP} SELECT movie_key, shot, subtitle, round(overlap, 4) AS overlap, round(overlap / ("end" - start), 6) AS shot_coverage,
  round(overlap / (sub_end - sub_start), 6) AS subtitle_coverage FROM o""")
def interval_overlap_join(spark, sf_dir):
    o = overlaps(spark, sf_dir)
    return o.select(
        "movie_key",
        "shot",
        "subtitle",
        F.round("overlap", 4).alias("overlap"),
        F.round(F.col("overlap") / (F.col("end") - F.col("start")), 6).alias("shot_coverage"),
        F.round(F.col("overlap") / (F.col("sub_end") - F.col("sub_start")), 6).alias("subtitle_coverage"),
    )


_SHARE = f"""{_OVERLAP}, g AS (SELECT movie_key, shot, scene, sum(overlap) AS score, min(subtitle) AS ord FROM o GROUP BY ALL)"""


@query(f"""WITH {_SHARE} SELECT movie_key, shot, scene, round(score, 3) AS score, round(score / sum(score) OVER (PARTITION BY movie_key, shot), 5) AS share,
  row_number() OVER (PARTITION BY movie_key, shot ORDER BY score DESC, ord, scene) = 1 AS best FROM g""")
def scene_evidence_share(spark, sf_dir):
    e = iv.evidence_share(overlaps(spark, sf_dir), ["movie_key", "shot"], "scene", "subtitle")
    return e.select("movie_key", "shot", "scene", F.round("score", 3).alias("score"), F.round("share", 5).alias("share"), "best")


_GAPS = f"""{FRAMES_SQL}, gp AS (
  SELECT movie_key, frame, pts, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS scene,
         CASE WHEN event_type IN ('click', 'view') THEN confidence END AS score FROM f
), nb AS (
  SELECT *, last_value(CASE WHEN scene IS NOT NULL THEN struct_pack(scene := scene, score := score, pts := pts) END IGNORE NULLS) OVER (PARTITION BY movie_key ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
            first_value(CASE WHEN scene IS NOT NULL THEN struct_pack(scene := scene, score := score, pts := pts) END IGNORE NULLS) OVER (PARTITION BY movie_key ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a
  FROM gp
), fl AS (SELECT *, coalesce(scene IS NULL AND b.scene = a.scene AND a.pts - b.pts <= 172800, false) AS interpolated FROM nb)"""


@query(f"""WITH {_GAPS} SELECT movie_key, frame, CASE WHEN interpolated THEN b.scene ELSE scene END AS scene,
  CASE WHEN interpolated THEN least(b.score, a.score) ELSE score END AS score, interpolated FROM fl""")
def fill_between_equal_neighbours(spark, sf_dir):
    """Gap of at most two days between the known neighbours."""
    known = F.col("event_type").isin("click", "view")
    g = frames(spark, sf_dir).select("movie_key", "frame", "pts", F.when(known, F.col("event_type")).alias("scene"), F.when(known, F.col("confidence")).alias("score"))
    return sq.fill_between_equal(g, "movie_key", "frame", "scene", "score", "pts", "pts", 172800).drop("pts")


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT *, lag(event_type) OVER (PARTITION BY movie_key ORDER BY frame) AS p FROM f)
SELECT movie_key, frame, CAST(sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY movie_key ORDER BY frame) AS BIGINT) AS group_id FROM c""")
def change_point_groups(spark, sf_dir):
    return frames(spark, sf_dir).select("movie_key", "frame", sq.change_groups("movie_key", ["frame"], ["event_type"]).alias("group_id"))


_ISL = f"""{FRAMES_SQL}, g AS (SELECT *, pts - lag(pts) OVER (PARTITION BY movie_key ORDER BY frame) AS gap FROM f), i AS (
  SELECT *, CAST(sum(CASE WHEN gap <= 21600 THEN 0 ELSE 1 END) OVER (PARTITION BY movie_key ORDER BY frame) AS BIGINT) AS island FROM g)"""


@query(f"""WITH {_ISL} SELECT movie_key, frame, island, CAST(floor((row_number() OVER (PARTITION BY movie_key, island ORDER BY frame) - 1) / 2) AS BIGINT) AS chunk FROM i""")
def bounded_islands(spark, sf_dir):
    """A gap above six hours ends an island; chunks of two."""
    return sq.bounded_islands(frames(spark, sf_dir), "movie_key", ["frame"], "pts", 21600, 2).select("movie_key", "frame", "island", "chunk")


@query(f"""WITH RECURSIVE {FRAMES_SQL}, r AS (
  SELECT movie_key, frame, pts, pts AS first, 1 AS session FROM f WHERE frame = 0
  UNION ALL
  SELECT f.movie_key, f.frame, f.pts, CASE WHEN f.pts - r.pts <= 36000 AND f.pts - r.first <= 86400 THEN r.first ELSE f.pts END,
         CASE WHEN f.pts - r.pts <= 36000 AND f.pts - r.first <= 86400 THEN r.session ELSE r.session + 1 END
  FROM r JOIN f ON f.movie_key = r.movie_key AND f.frame = r.frame + 1
) SELECT movie_key, frame, session FROM r""")
def span_capped_sessions(spark, sf_dir):
    """At most ten hours between neighbours and a day in all."""
    return sq.span_capped_sessions(frames(spark, sf_dir), "movie_key", "pts", 36000, 86400).select("movie_key", "frame", "session")


_BRIDGE = f"""{SHOTS_SQL}, x AS (SELECT *, movie_key * 10 + shot // 12 AS scene, (shot * 7 + movie_key) % 3 <> 0 AS selected FROM s), l AS (
  SELECT *, lag(scene) OVER w AS scene1, lag("end" - start) OVER w AS len1 FROM x WINDOW w AS (PARTITION BY movie_key ORDER BY shot)
), k AS (SELECT *, lag(shot) OVER w AS shot0, lag(scene) OVER w AS scene0 FROM l WHERE selected WINDOW w AS (PARTITION BY movie_key ORDER BY shot)), ev AS (
  SELECT *, CAST(sum(CASE WHEN scene = scene0 AND (shot - shot0 = 1 OR shot - shot0 = 2 AND scene1 = scene AND len1 <= 172800) THEN 0 ELSE 1 END)
    OVER (PARTITION BY movie_key ORDER BY shot) AS BIGINT) AS event FROM k)"""


def _bridged(spark, sf_dir):
    x = shots(spark, sf_dir).withColumns({"scene": F.expr("movie_key * 10 + shot div 12"), "selected": F.expr("(shot * 7 + movie_key) % 3 <> 0")})
    return sq.bridged_sessions(x, "movie_key", "shot", "selected", "scene", "start", "end", 172800)


@query(f"""WITH {_BRIDGE} SELECT movie_key, event, count(*) AS members, min(shot) AS first_shot, max(shot) AS last_shot, round(max("end") - min(start), 3) AS span,
  round(sum(shot * ("end" - start)) / sum("end" - start), 5) AS weighted_mean FROM ev GROUP BY movie_key, event""")
def bridged_sessions(spark, sf_dir):
    """Duration includes bridges, weights are member durations only."""
    d = F.col("end") - F.col("start")
    return _bridged(spark, sf_dir).groupBy("movie_key", "event").agg(
        F.count("*").alias("members"),
        F.min("shot").alias("first_shot"),
        F.max("shot").alias("last_shot"),
        F.round(F.max("end") - F.min("start"), 3).alias("span"),
        F.round(F.sum(F.col("shot") * d) / F.sum(d), 5).alias("weighted_mean"),
    )


#: A day: rows come so much later than others at most; a film without a row for so many seconds has ended.
_DELAY, _IDLE = 86400, 400 * 86400


@query(f"""WITH {_BRIDGE} SELECT movie_key, event, count(*) AS members, min(shot) AS first_shot, max(shot) AS last_shot, round(max("end") - min(start), 3) AS span,
  round(sum(shot * ("end" - start)) / sum("end" - start), 5) AS weighted_mean FROM ev GROUP BY movie_key, event""")
def streamed_bridges(spark, sf_dir):
    """The same from a stream that arrives in three parts, a day's rows out of order between them, each part in a run of its own that goes on from the checkpoint."""
    x = shots(spark, sf_dir).select("movie_key", "shot", F.expr("movie_key * 10 + shot div 12").alias("scene"), F.expr("(shot * 7 + movie_key) % 3 <> 0").alias("selected"), "start", "end")
    low, high = x.agg(F.min("end"), F.max("end")).first()
    cuts = [low + (high - low) * k / 3 for k in (1, 2)]
    part = F.lit(0)
    for cut in cuts:  # of the last day before a cut, half of the rows come with the next part
        late = (F.col("end") > cut - _DELAY) & (F.xxhash64("movie_key", "shot") % 2 == 0)
        part = part + ((F.col("end") > cut) | late).cast("int")
    source, out, state = (scratch_path(spark, f"bridges-{n}") for n in ("in", "out", "state"))
    dealt = x.withColumn("part", part)
    end = spark.createDataFrame([(-1, 1, 0, False, high + 2 * _IDLE, high + 2 * _IDLE, 3)], dealt.schema)  # moves the watermark past all timers
    with keyed_timers(spark):
        for k in range(4):
            (dealt.where(F.col("part") == k) if k < 3 else end).drop("part").write.mode("append").parquet(source)
            stream = spark.readStream.schema(x.schema).parquet(source)
            run = stream_bridges(stream, 172800, _IDLE, f"{_DELAY} seconds").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
            run.awaitTermination()
    return spark.read.schema(SESSIONS).parquet(out)


@query()
def split_long_events(spark, sf_dir):
    """Events above ten days are cut; checked against a plain version in the tests."""
    m = _bridged(spark, sf_dir).select("movie_key", "event", F.col("shot").alias("index"), "start", "end", F.expr("(shot * 37 % 11) / 11D").alias("score"))
    return sq.split_long(m, ["movie_key", "event"], 864000.0)


@query(f"""WITH {FRAMES_SQL} SELECT movie_key, frame, coalesce(event_type = 'view' AND lag(event_type) OVER w IN ('click', 'purchase') AND lead(event_type) OVER w IN ('click', 'purchase'), false) AS between,
  coalesce(lag(event_type) OVER w = 'purchase' OR lead(event_type) OVER w = 'purchase', false) AS adjacent FROM f WINDOW w AS (PARTITION BY movie_key ORDER BY frame)""")
def neighbour_evidence(spark, sf_dir):
    w = Window.partitionBy("movie_key").orderBy("frame")
    before, after = F.lag("event_type").over(w), F.lead("event_type").over(w)
    talk = ("click", "purchase")
    return frames(spark, sf_dir).select(
        "movie_key",
        "frame",
        F.coalesce((F.col("event_type") == "view") & before.isin(*talk) & after.isin(*talk), F.lit(False)).alias("between"),
        F.coalesce(before.eqNullSafe("purchase") | after.eqNullSafe("purchase"), F.lit(False)).alias("adjacent"),
    )


@query(f"""WITH {FRAMES_SQL} SELECT movie_key, frame, array_to_string(list(event_type) OVER (PARTITION BY movie_key ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ',') AS before,
  array_to_string(list(event_type) OVER (PARTITION BY movie_key ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ',') AS after FROM f""")
def context_radius(spark, sf_dir):
    c = sq.context(frames(spark, sf_dir), "movie_key", ["frame"], "event_type", 2)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return c.select("movie_key", "frame", text("before").alias("before"), text("after").alias("after"))


@query(f"""WITH {FRAMES_SQL} SELECT movie_key, frame, last_value(CASE WHEN event_type = 'error' THEN frame END IGNORE NULLS) OVER (PARTITION BY movie_key ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
  first_value(CASE WHEN event_type = 'error' THEN frame END IGNORE NULLS) OVER (PARTITION BY movie_key ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM f""")
def nearest_anchors(spark, sf_dir):
    f = frames(spark, sf_dir).select("movie_key", "frame", "event_type")
    return sq.nearest_where(f, "movie_key", ["frame"], F.col("event_type") == "error", "frame", "previous", "next").drop("event_type")


@query(f"""WITH {FRAMES_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY movie_key ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY movie_key) AS n FROM f)
SELECT movie_key, frame FROM e WHERE n <= 5 OR pos IN (SELECT round_even(i * (n - 1) / 4, 0) FROM range(5) t(i))""")
def even_sample(spark, sf_dir):
    return sq.even_sample(frames(spark, sf_dir).select("movie_key", "frame"), "movie_key", ["frame"], 5)


@query(f"""WITH {FRAMES_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY movie_key, event_type ORDER BY frame) AS turn FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY movie_key ORDER BY turn, event_type) AS taken FROM t) SELECT movie_key, frame, event_type, CAST(taken AS INTEGER) AS taken FROM k WHERE taken <= 7""")
def round_robin_sample(spark, sf_dir):
    return sq.round_robin(frames(spark, sf_dir), "movie_key", "event_type", ["frame"], 7).select("movie_key", "frame", "event_type", "taken")


@query(f"""WITH RECURSIVE {FRAMES_SQL}, c AS (SELECT movie_key, frame, CAST(1 + event_id % 37 AS BIGINT) AS cost FROM f), r AS (
  SELECT movie_key, frame, cost AS total, 1 AS n, 1 AS pack FROM c WHERE frame = 0
  UNION ALL
  SELECT c.movie_key, c.frame, CASE WHEN r.total + c.cost <= 100 AND r.n < 5 THEN r.total + c.cost ELSE c.cost END,
    CASE WHEN r.total + c.cost <= 100 AND r.n < 5 THEN r.n + 1 ELSE 1 END, CASE WHEN r.total + c.cost <= 100 AND r.n < 5 THEN r.pack ELSE r.pack + 1 END
  FROM r JOIN c ON c.movie_key = r.movie_key AND c.frame = r.frame + 1
) SELECT movie_key, frame, pack FROM r""")
def greedy_packing(spark, sf_dir):
    c = frames(spark, sf_dir).select("movie_key", "frame", F.expr("1 + event_id % 37").cast("long").alias("cost"))
    packed = sq.greedy_packing(c, "movie_key", "frame", "cost", 100, 5)
    return packed.select("movie_key", "frame", (F.col("pack") + 1).alias("pack"))


@query(f"""WITH {FRAMES_SQL}, a AS (SELECT * FROM f WHERE event_type IN ('view', 'error')), s AS (SELECT movie_key, frame AS seed FROM f WHERE event_type = 'purchase')
SELECT a.movie_key, a.frame, min(abs(a.frame - s.seed)) AS distance FROM a JOIN s ON a.movie_key = s.movie_key AND abs(a.frame - s.seed) <= 3 GROUP BY ALL""")
def min_distance_join(spark, sf_dir):
    f = frames(spark, sf_dir).select("movie_key", "frame", "event_type")
    seeds = f.where("event_type = 'purchase'").select("movie_key", F.col("frame").alias("seed"))
    return iv.min_distance_join(f.where("event_type IN ('view', 'error')").drop("event_type"), seeds, ["movie_key"], "frame", "seed", 3)


def smooth(values: list[float]) -> list[float]:
    """Half of each value and half of the mean of its neighbours."""
    near = [values[0], *values, values[-1]]
    return [0.5 * (v + 0.5 * (a + b)) for a, v, b in zip(near, values, near[2:])]


@query(f"""WITH {FRAMES_SQL} SELECT movie_key, frame, round(0.5 * (confidence + 0.5 * (lag(confidence, 1, confidence) OVER w + lead(confidence, 1, confidence) OVER w)), 9) AS score FROM f WINDOW w AS (PARTITION BY movie_key ORDER BY frame)""")
def plugged_predictions(spark, sf_dir):
    """A predictor plugged in as a table function: windows of a film's frames, of which the middle counts."""
    f = frames(spark, sf_dir).select("movie_key", "frame", "confidence")
    found = pg.through(f, lambda: pg.Windows(smooth, "movie_key", "frame", "confidence"), ["movie_key"], ["frame"], "movie_key long, frame long, score double")
    return found.withColumn("score", F.round("score", 9))
