"""Performance mining: evidence, relevance, context risk and events of shots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed weights of the families of evidence.
ACTION_NEAR, ACTION_DURING, SUBTITLE, INTERACTION, CONTEXT = 0.30, 0.45, 0.25, 0.20, 0.10
#: Fixed weights of relevance to a target.
SPEAKS, DURING, NEAR, ADJACENT, MENTION = 1.0, 0.90, 0.55, 0.45, 0.85
HIGH, MEDIUM = 0.80, 0.45


def rule_matches(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Array of (rule_id, category) of the rules (id, category, pattern) that the text meets; patterns are constants, so they are compiled once."""
    found = F.array(*[F.when(text.rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(c).alias("category"))) for r, c, p in rules])
    return F.array_compact(found)


def semantic_score(shots: DataFrame) -> DataFrame:
    """``shots`` with semantic_score from: action_during, action_near, subtitle (0/1 flags), speakers (count), context (0..1).

    A family counts once, by its strongest source; the score is capped at 1.
    """
    action = F.greatest(F.when(F.col("action_during"), ACTION_DURING).otherwise(0.0), F.when(F.col("action_near"), ACTION_NEAR).otherwise(0.0))
    total = action + F.when(F.col("subtitle"), SUBTITLE).otherwise(0.0) + F.when(F.col("speakers") >= 2, INTERACTION).otherwise(0.0) + CONTEXT * F.coalesce("context", F.lit(0.0))
    return shots.withColumn("semantic_score", F.least(F.lit(1.0), total))


def exclusion(pending: Column, transition: Column, scene: Column) -> Column:
    """The first reason to leave a shot out; null if there is none."""
    return F.when(pending, "pending_ambiguity").when(transition, "scene_transition").when(scene.isNull(), "unresolved_scene")


def exclude_pending(shots: DataFrame, pending: DataFrame, subtitles: str = "subtitles") -> DataFrame:
    """``shots`` (shot_id, array of subtitle ids) with pending: whether a subtitle of the shot is undecided."""
    hit = shots.select("shot_id", F.explode(subtitles).alias("subtitle_id")).join(pending.select("subtitle_id").distinct(), "subtitle_id", "left_semi")
    return shots.join(hit.select("shot_id").distinct().withColumn("_hit", F.lit(True)), "shot_id", "left").withColumn("pending", F.coalesce("_hit", F.lit(False))).drop("_hit")


def target_relevance(shots: DataFrame, aliases: list[str], key: str = "movie_key", order: str = "shot") -> DataFrame:
    """``shots`` (speakers, scene, during, near: arrays and texts) with relevance (0..1) and its band.

    Strongest evidence counts: the target speaks; is named in an action during or near; speaks in
    the shot before or after in the same scene; is named by another speaker.
    """
    w = Window.partitionBy(key).orderBy(order)
    names = F.array(*map(F.lit, aliases))
    speaks = lambda c: F.coalesce(F.arrays_overlap(c, names), F.lit(False))
    named = lambda c: F.coalesce(F.lower(c).rlike(r"(?:^|[^a-z0-9])(?:" + "|".join(a.lower() for a in aliases) + r")(?:[^a-z0-9]|$)"), F.lit(False))
    beside = lambda f: F.coalesce(speaks(f("speakers").over(w)) & (f("scene").over(w) == F.col("scene")), F.lit(False))
    evidence = F.array(
        F.when(speaks(F.col("speakers")), SPEAKS), F.when(named(F.col("during")), DURING), F.when(named(F.col("near")), NEAR), F.when(named(F.col("text")), MENTION), F.when(beside(F.lag) | beside(F.lead), ADJACENT)
    )
    score = F.coalesce(F.array_max(F.array_compact(evidence)), F.lit(0.0))
    out = shots.withColumn("relevance", score)
    return out.withColumn("band", F.when(F.col("relevance") >= HIGH, "high").when(F.col("relevance") >= MEDIUM, "medium").otherwise("none"))


def context_risk(band: Column, weights: Column, focus: Column, aliases: list[str], direct: Column) -> Column:
    """Medium relevance by weak evidence only, while all who are in focus are others and no direct rule holds."""
    weak = F.forall(weights, lambda x: x < MENTION)
    others = (F.size(focus) > 0) & F.forall(focus, lambda s: ~s.isin(*aliases))
    return F.coalesce((band == "medium") & weak & others & ~direct, F.lit(False))


def shot_score(semantic: Column, face: Column, context: Column) -> Column:
    return 0.65 * semantic + 0.25 * face + 0.10 * context


def face_score(faces: DataFrame, frames_of: str = "shot_id") -> DataFrame:
    """Score of a shot from its frame rows (face_count, max_face_area_ratio, usable): shares of visible, large, usable and steady frames."""
    visible = F.avg((F.col("face_count") > 0).cast("double"))
    size = F.least(F.lit(1.0), F.max("max_face_area_ratio") / 0.10)
    usable = F.avg(F.col("usable").cast("double"))
    steady = F.when(F.min("face_count") == F.max("face_count"), 1.0).otherwise(0.0)
    reason = (
        F.when(F.count_if("usable") < 2, "too_few_usable_frames").when(F.count_if(F.col("face_count") > 0) < 2, "too_few_face_frames").when(F.max("max_face_area_ratio") < 0.005, "face_too_small")
    )
    return faces.groupBy(frames_of).agg((0.50 * visible + 0.25 * size + 0.15 * usable + 0.10 * steady).alias("face_score"), reason.alias("ineligible"))


def event_summary(members: DataFrame, key: list[str]) -> DataFrame:
    """A row for each event from its members (shot, start, end, score, categories): span, duration-weighted score, consistency.

    Consistency is the mean share of the event's categories that a member has (events of several
    members); a twentieth of it is added to the score, which is capped at 1.
    """
    d = F.col("end") - F.col("start")
    union = F.array_distinct(F.flatten(F.collect_list("categories")))
    n = F.count("*")
    consistency = F.when((n > 1) & (F.size(union) > 0), F.sum(F.size("categories")) / (n * F.size(union))).otherwise(F.lit(0.0))
    out = members.groupBy(*key).agg(
        n.alias("members"), F.min("start").alias("start"), F.max("end").alias("end"), F.coalesce(F.try_divide(F.sum(F.col("score") * d), F.sum(d)), F.lit(0.0)).alias("weighted"), consistency.alias("consistency"),
        F.transform(F.array_sort(F.collect_list(F.struct("start", "shot"))), lambda x: x["shot"]).alias("shots"),
    )
    return out.withColumn("event_score", F.least(F.lit(1.0), F.col("weighted") + 0.05 * F.col("consistency"))).drop("weighted")


def review_evaluation(rows: DataFrame) -> DataFrame:
    """One row: precision, false-negative rate and boundary acceptance of a reviewed sample, and whether the gate is passed."""
    chosen = F.col("selected")
    precision = F.try_divide(F.count_if(chosen & (F.col("verdict") == "good")), F.count_if(chosen))
    missed = F.try_divide(F.count_if(~chosen & (F.col("verdict") == "good")), F.count_if(~chosen))
    borders = F.try_divide(F.count_if(chosen & F.col("boundary_ok")), F.count_if(chosen & F.col("boundary_ok").isNotNull()))
    out = rows.agg(precision.alias("precision"), missed.alias("false_negative_rate"), borders.alias("boundary_acceptance"))
    gate = (F.col("precision") >= 0.80) & (F.col("false_negative_rate") <= 0.20) & (F.col("boundary_acceptance") >= 0.80)
    return out.withColumn("passed", F.coalesce(gate, F.lit(False)))
