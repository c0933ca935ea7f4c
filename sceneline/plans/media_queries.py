"""Queries over media rules, screenplay lines, subtitles and mined shots.

Parts are files, suppliers streams, turns are lines; the values that rules look
at are derived from the ids so that every branch occurs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneline.functions import media as md
from sceneline.functions import text as tx
from sceneline.operators import audits as au
from sceneline.operators import mining as mn
from sceneline.operators import screenplay as sp
from sceneline.operators import subtitles as sb
from sceneline.operators import verify as vf
from sceneline.plans.analogs import FRAMES_SQL, frames, table
from sceneline.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pick(i, *values):
    """One of ``values`` by the number ``i``."""
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _pick_sql(i, *values):
    return f"list_extract([{', '.join('NULL' if v is None else repr(v) for v in values)}], CAST(({i}) % {len(values)} + 1 AS BIGINT))"


_RATES = ("24000/1001", "25/1", "30", "0/0", "x", "60000/1001")
_TAGS = ("en", " ENG ", "English", "fr", "", "und")


@query(f"""WITH p AS (SELECT p_partkey, {_pick_sql("p_partkey", *_RATES)} AS r, p_partkey % 3 AS m, p_size, {_pick_sql("p_partkey", *_TAGS)} AS t FROM part),
f AS (SELECT *, CASE r WHEN '24000/1001' THEN 24000e0 / 1001 WHEN '25/1' THEN 25e0 WHEN '30' THEN 30e0 WHEN '60000/1001' THEN 60000e0 / 1001 ELSE 0 END AS fps FROM p)
SELECT p_partkey, round(fps, 6) AS fps, round(CASE WHEN fps > 30 THEN 24e0 ELSE fps END, 6) AS target, CASE WHEN m = 0 THEN 1000e0 WHEN m = 1 THEN p_size * 8e0 / 4 END AS rate, CASE WHEN m = 0 THEN 'stream' WHEN m = 1 THEN 'derived' END AS source,
  CASE WHEN lower(trim(t)) IN ('en', 'eng', 'english') THEN 'en' WHEN trim(t) = '' THEN 'und' ELSE lower(trim(t)) END AS language FROM f""")
def stream_rules(spark, sf_dir):
    """Frame rates, bit rates with their source, language codes."""
    k = F.col("p_partkey")
    fps = md.frame_rate(_pick(k, *_RATES))
    rate = md.bitrate(F.when(k % 3 == 0, 1000).otherwise(0), F.col("p_size"), F.when(k % 3 == 1, 4).otherwise(0))
    p = table(spark, sf_dir, "part").select("p_partkey", F.round(fps, 6).alias("fps"), F.round(md.target_fps(fps), 6).alias("target"), rate.alias("b"), md.language_code(_pick(k, *_TAGS)).alias("language"))
    return p.select("p_partkey", "fps", "target", "b.rate", "b.source", "language")


@query("""WITH s AS (SELECT l_orderkey AS file, l_linenumber AS i, CASE l_suppkey % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'fr' WHEN 2 THEN '' ELSE 'de' END AS lang, l_partkey % 3 = 0 AS d FROM lineitem),
r AS (SELECT *, CASE WHEN lang = 'eng' THEN 0 WHEN d THEN 1 ELSE 2 END AS r FROM s) SELECT file, CAST(arg_min(i, (r, i)) AS INTEGER) AS stream FROM r GROUP BY file""")
def audio_choice(spark, sf_dir):
    """Of a file's streams the first English one, else the default, else the first."""
    lang = F.when(F.col("l_suppkey") % 4 == 0, "eng").when(F.col("l_suppkey") % 4 == 1, "fr").when(F.col("l_suppkey") % 4 == 2, "").otherwise("de")
    s = F.struct(F.col("l_linenumber").alias("index"), lang.alias("language"), (F.col("l_partkey") % 3 == 0).alias("is_default"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.array_sort(F.collect_list(s)).alias("s"))
    return rows.select("file", md.pick_audio(F.col("s"))["index"].cast("int").alias("stream"))


@query("""SELECT p_partkey, concat_ws('|', CASE WHEN p_size % 9 = 0 THEN 'empty' END, CASE WHEN p_partkey % 4 <> 0 THEN 'codec' END, CASE WHEN p_size * 60 > 1920 THEN 'width' END, CASE WHEN p_size * 30 + p_partkey % 2 > 1080 THEN 'height' END, CASE WHEN p_partkey % 2 = 1 THEN 'odd_size' END,
  CASE WHEN p_partkey % 5 = 0 THEN 'bit_depth' END, CASE WHEN p_partkey % 7 = 0 THEN 'duration' END, CASE WHEN p_partkey % 11 = 0 THEN 'frame_rate' END) AS violations,
  CASE WHEN p_partkey % 3 = 0 THEN 'zscale=t=linear,tonemap=hable,zscale=t=bt709,' ELSE '' END || 'scale=' || p_size * 2 || ':' || p_size AS filter FROM part""")
def output_checks(spark, sf_dir):
    """What is wrong with a written file, and the filter it would be made with."""
    k, n = F.col("p_partkey"), F.col("p_size")
    off = lambda m, by: F.when(k % m == 0, by).otherwise(0.0)
    wrong = md.output_violations(100.0 + off(7, 0.6), F.lit(100.0), 24.0 + off(11, 0.03), F.lit(24.0), n * 60, n * 30 + k % 2, F.when(k % 5 == 0, 10).otherwise(8), F.when(k % 4 == 0, "h264").otherwise("hevc"), n % 9)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(wrong, "|").alias("violations"), md.scale_filter(n * 2, n, k % 3 == 0).alias("filter"))


_SLUGS = ("12A INT. OLD HOUSE - DAY", "EXT. ROAD", "I/E CAR - 1999 7", "ANNA (CONT'D)", "BOB (V.O.)", "CUT TO:", "Only me.", "INT/EXT. YARD - MOMENTS LATER 3B")


@query("""WITH l AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS i, turn * 60 AS x FROM conversations) SELECT conv_id, turn, list_extract(['12A', '', '7', '', '', '', '', '3B'], CAST(i + 1 AS BIGINT)) AS number, list_extract(['INT', 'EXT', 'I/E', '', '', '', '', 'INT/EXT'], CAST(i + 1 AS BIGINT)) AS int_ext,
  list_extract(['OLD HOUSE', 'ROAD', 'CAR', '', '', '', '', 'YARD'], CAST(i + 1 AS BIGINT)) AS location, list_extract(['DAY', '', '1999', '', '', '', '', 'MOMENTS LATER'], CAST(i + 1 AS BIGINT)) AS time_of_day, list_extract(['scene_012A', 'scene_', 'scene_007', 'scene_', 'scene_', 'scene_', 'scene_', 'scene_003B'], CAST(i + 1 AS BIGINT)) AS scene_id,
  i IN (3, 4) AND x >= 612 * 0.36e0 AS cue, list_extract(['12A INT. OLD HOUSE - DAY', 'EXT. ROAD', 'I/E CAR - 1999 7', 'ANNA', 'BOB', 'CUT TO:', 'ONLY ME.', 'INT/EXT. YARD - MOMENTS LATER 3B'], CAST(i + 1 AS BIGINT)) AS plain FROM l""")
def screenplay_lines(spark, sf_dir):
    """Slug lines in parts, scene ids, cues and cues without notes."""
    line = _pick(F.col("conv_id") + F.col("turn"), *_SLUGS)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"), (F.col("turn") * 60.0).alias("x0"))
    c = c.withColumn("s", sp.slug_parts(F.col("line")))
    return c.select("conv_id", "turn", "s.number", "s.int_ext", "s.location", "s.time_of_day", sp.scene_id(F.col("s.number")).alias("scene_id"), sp.looks_like_cue(F.col("line"), F.col("x0"), F.lit(612.0)).alias("cue"), sp.normal_cue(F.col("line")).alias("plain"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Hello there' WHEN 1 THEN 'Only words' WHEN 2 THEN '' ELSE 'Two lines' || chr(10) || 'of them' END AS english, CASE turn % 4 WHEN 0 THEN '你好' WHEN 2 THEN '只有中文' ELSE '' END AS chinese, turn % 5 = 0 AS credit,
  CASE WHEN turn % 2 = 0 THEN 'Subtitles' ELSE 'I said' END AS kind, printf('%02d:%02d:%02d.250', turn // 2, (conv_id * 7) % 60, (turn * 9) % 60) AS clock, CAST(turn // 2 * 3600 + (conv_id * 7) % 60 * 60 + (turn * 9) % 60 + 0.25e0 AS DOUBLE) AS seconds, CASE turn % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 0e0 ELSE 1e0 END AS capitals FROM conversations""")
def subtitle_lines(spark, sf_dir):
    """Lines of one language of a bilingual cue, credits, clock times both ways, share of capitals."""
    t = F.col("turn")
    both = _pick(t, "Hello there\n你好", "Only words", "只有中文", "Two lines\nof them")
    credit = F.when(t % 5 == 0, "Subtitles by somebody").otherwise("I said so")
    seconds = F.floor(t / 2) * 3600 + (F.col("conv_id") * 7) % 60 * 60 + (t * 9) % 60 + 0.25
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn", sb.wanted_lines(both, "en").alias("english"), sb.wanted_lines(both, "zh").alias("chinese"), credit.rlike(sb.CREDIT).alias("credit"), F.when(t % 2 == 0, "Subtitles").otherwise("I said").alias("kind"),
        tx.clock(seconds).alias("clock"), tx.clock_seconds(F.replace(tx.clock(seconds), F.lit("."), F.lit(","))).alias("seconds"), tx.upper_share(_pick(t, "aB", "12 ab", "ABC")).alias("capitals"),
    )


@query(f"""WITH {FRAMES_SQL}, e AS (SELECT movie_key, frame // 4 AS ev, frame, pts AS a, pts + 60 + frame % 3 AS z, confidence AS s, list_slice(['x', 'y', 'z'], 1, CAST(frame % 4 AS BIGINT)) AS c FROM f),
u AS (SELECT movie_key, ev, count(*) AS members, min(a) AS s0, max(z) AS s1, sum(s * (z - a)) / sum(z - a) AS w, sum(len(c)) AS held, max(len(c)) AS un FROM e GROUP BY ALL)
SELECT movie_key, ev, members, round(s1 - s0, 4) AS span, round(CASE WHEN members > 1 AND un > 0 THEN held / (members * un) ELSE 0 END, 6) AS consistency, round(least(1e0, w + 0.05e0 * CASE WHEN members > 1 AND un > 0 THEN held / (members * un) ELSE 0 END), 6) AS event_score FROM u""")
def event_summaries(spark, sf_dir):
    """Span, duration-weighted score and consistency of events of four frames."""
    c = F.slice(F.array(F.lit("x"), F.lit("y"), F.lit("z")), 1, (F.col("frame") % 4).cast("int"))
    m = frames(spark, sf_dir).select("movie_key", F.floor(F.col("frame") / 4).alias("ev"), F.col("frame").alias("shot"), F.col("pts").alias("start"), (F.col("pts") + 60 + F.col("frame") % 3).alias("end"), F.col("confidence").alias("score"), c.alias("categories"))
    e = mn.event_summary(m, ["movie_key", "ev"])
    return e.select("movie_key", "ev", "members", F.round(F.col("end") - F.col("start"), 4).alias("span"), F.round("consistency", 6).alias("consistency"), F.round("event_score", 6).alias("event_score"))


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT movie_key, frame // 5 AS shot_id, frame % 3 AS n, confidence / 48 AS area, event_type <> 'error' AS ok FROM f) SELECT movie_key * 1000 + shot_id AS shot_id,
  round(0.5e0 * avg((n > 0)::INT) + 0.25e0 * least(1e0, max(area) / 0.1e0) + 0.15e0 * avg(ok::INT) + CASE WHEN min(n) = max(n) THEN 0.1e0 ELSE 0 END, 6) AS face_score,
  CASE WHEN count(*) FILTER (WHERE ok) < 2 THEN 'too_few_usable_frames' WHEN count(*) FILTER (WHERE n > 0) < 2 THEN 'too_few_face_frames' WHEN max(area) < 0.005 THEN 'face_too_small' END AS ineligible FROM s GROUP BY movie_key, s.shot_id""")
def face_scores(spark, sf_dir):
    f = frames(spark, sf_dir).select((F.col("movie_key") * 1000 + F.floor(F.col("frame") / 5)).alias("shot_id"), (F.col("frame") % 3).alias("face_count"), (F.col("confidence") / 48).alias("max_face_area_ratio"), (F.col("event_type") != "error").alias("usable"))
    return mn.face_score(f).select("shot_id", F.round("face_score", 6).alias("face_score"), "ineligible")


@query("""WITH s AS (SELECT conv_id, turn, role, lower(text) LIKE '%the%' AS says, lag(role) OVER w = 'assistant' OR lead(role) OVER w = 'assistant' AS beside FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CASE WHEN role = 'assistant' THEN 1e0 WHEN turn % 6 = 5 THEN 0.9e0 WHEN turn % 7 = 6 THEN 0.55e0 WHEN coalesce(beside, false) THEN 0.45e0 ELSE 0 END AS relevance FROM s)
SELECT conv_id, turn, relevance, CASE WHEN relevance >= 0.8 THEN 'high' WHEN relevance >= 0.45 THEN 'medium' ELSE 'none' END AS band, relevance BETWEEN 0.45 AND 0.79 AND turn % 3 = 0 AND conv_id % 2 = 0 AS risk FROM r""")
def target_relevance(spark, sf_dir):
    """Relevance of shots to a target by its strongest evidence, its band, and weak evidence while others are in focus."""
    t = F.col("turn")
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array("role").alias("speakers"), F.col("conv_id").alias("scene"), F.when(t % 6 == 5, "the assistant waits").alias("during"), F.when(t % 7 == 6, "an assistant, near").alias("near"), F.lit("nothing").alias("text"))
    r = mn.target_relevance(s, ["assistant"], "conv_id", "turn")
    focus = F.when(t % 3 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("assistant")))
    risk = mn.context_risk(F.col("band"), F.array("relevance"), focus, ["assistant"], F.col("conv_id") % 2 == 1)
    return r.select("conv_id", "turn", "relevance", "band", risk.alias("risk"))


@query(r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'probable_true_no_match' WHEN 1 THEN 'reviewer_selection_risk' WHEN 2 THEN 'candidate_recall_risk' WHEN 3 THEN 'ambiguous' ELSE 'probable_true_no_match' END AS risk FROM pages""")
def no_match_risks(spark, sf_dir):
    """The class of unmatched lines by their lexical evidence."""
    k = F.col("page_id") % 5
    e = table(spark, sf_dir, "pages").select(
        "page_id", (k == 1).alias("phrase"), F.lit(4).alias("n_tokens"), F.when(k == 0, 1).when(k == 4, 1).otherwise(2).alias("shared"), F.when(k == 3, 0.5).otherwise(0.75).alias("share"), (k == 2).alias("near"), (k == 3).alias("moderate"), (k == 1).alias("supplied")
    )
    return au.no_match_risk(e, "page_id")


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS i, CAST(l_quantity AS DOUBLE) AS x, CAST(l_partkey % 40 AS DOUBLE) AS y FROM lineitem), j AS (SELECT a.k, a.i, a.x, a.y, c.i AS o, greatest(0, least(a.x + 20, c.x + 30) - greatest(a.x, c.x + 5)) * greatest(0, least(a.y + 20, c.y + 30) - greatest(a.y, c.y + 5)) AS inter FROM b a JOIN b c ON a.k = c.k WHERE a.i % 2 = 0 AND c.i % 2 = 1),
r AS (SELECT *, inter / (400e0 + 625e0 - inter) AS iou FROM j) SELECT k, i, arg_max(o, (iou, -o)) AS other, round(max(iou), 6) AS iou FROM r WHERE iou >= 0.1 GROUP BY k, i, x, y""")
def best_boxes(spark, sf_dir):
    """For each box of a key the other box with the largest overlap."""
    x, y = F.col("l_quantity").cast("double"), (F.col("l_partkey") % 40).cast("double")
    li = table(spark, sf_dir, "lineitem")
    box = lambda a, n: F.array(x + a, y + a, x + a + n, y + a + n)
    left = li.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), box(0, 20).alias("box"))
    right = li.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("other"), box(5, 25).alias("obox"))
    return vf.best_box(left, right, ["k"], "box", "obox", "other").select("k", "i", "other", F.round("iou", 6).alias("iou"))


@query(r"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS m FROM part) SELECT p_partkey, CASE WHEN m < 3 THEN 'h264' END AS codec, CASE WHEN m < 3 THEN 1920 END AS width, CASE WHEN m < 3 THEN 24e0 ELSE 0 END AS fps, CASE WHEN m >= 3 THEN 'no video stream' END AS error, m <> 1 AS kept FROM p""")
def media_probes(spark, sf_dir):
    """Probes from their JSON text, broken ones with an error; hidden paths."""
    k = F.col("p_partkey") % 5
    good = F.lit('{"streams": [{"index": 0, "codec_type": "video", "codec_name": "h264", "width": 1920, "height": 800, "pix_fmt": "yuv420p", "avg_frame_rate": "24/1"}, {"index": 1, "codec_type": "audio"}], "format": {"duration": "30.03"}}')
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k < 3, good).when(k == 3, "{}").otherwise("junk").alias("payload"), F.when(k == 1, "a/.cache/b.mkv").otherwise("a/b.mkv").alias("relpath"))
    return files.probes(rows).select("p_partkey", "codec", F.col("width").cast("int").alias("width"), F.coalesce("fps", F.lit(0.0)).alias("fps"), "error", (~files.hidden(F.col("relpath"))).alias("kept"))


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) AS INTEGER) AS place FROM documents""")
def seeded_shuffle(spark, sf_dir):
    """The order of each source's documents in a shuffle with a seed."""
    order = F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string")).cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy(order, "doc_id")).alias("place"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'und' END AS language FROM part""")
def subtitle_languages(spark, sf_dir):
    """Language of a subtitle file: named by the file, else of its first stream that says one."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "film.ENG.srt").otherwise("film.srt")
    streams = F.when(k == 1, F.array(F.lit("und"), F.lit("fr"), F.lit("de"))).when(k == 2, F.array(F.lit("de"))).otherwise(F.array(F.lit("und")))
    return table(spark, sf_dir, "part").select("p_partkey", md.subtitle_language(name, streams).alias("language"))
