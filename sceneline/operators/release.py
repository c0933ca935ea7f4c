"""Release and lineage checks: populations, gates, reconstruction, recomputed scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneline.operators.resolutions import names

#: States in which an item needs no more work.
COMPLETE, BLOCKED = "COMPLETE", "BLOCKED_WITH_EXPLICIT_REASON"
MOST_AMBIGUITIES = 5


def population(inventory: DataFrame, status: DataFrame, manifests: DataFrame, key: str) -> DataFrame:
    """(key, errors): items that are not in all three tables, or more than once in one."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    n = count(inventory, "i").join(count(status, "s"), key, "full_outer").join(count(manifests, "m"), key, "full_outer").na.fill(0, ["i", "s", "m"])
    errors = names(*[F.when(F.col(c) == 0, f"missing_in_{t}") for c, t in (("i", "inventory"), ("s", "status"))], *[F.when(F.col(c) > 1, f"repeated_in_{t}") for c, t in (("i", "inventory"), ("s", "status"), ("m", "manifests"))], F.when((F.col("m") == 0) & (F.col("s") > 0), "missing_manifest"))
    return n.select(key, errors.alias("errors")).where(F.size("errors") > 0)


def fetched(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """``jobs`` (job, batch_id) with the state of their fetch record: completed, not completed, missing, or a batch id used twice."""
    twice = F.count("*").over(Window.partitionBy("batch_id")) > 1
    r = records.groupBy("batch_id").agg(F.bool_or(F.col("status") == "completed").alias("_done"))
    out = jobs.withColumn("_twice", twice).join(r, "batch_id", "left")
    state = F.when(F.col("_twice"), "repeated_batch_id").when(F.col("_done").isNull(), "missing_record").when(~F.col("_done"), "not_completed").otherwise("completed")
    return out.withColumn("state", state).drop("_twice", "_done")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, counting repeats, that only one of two tables has: side and the columns; none if a rebuild equals the original."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.withColumn("side", F.lit("only_first")).unionByName(right.withColumn("side", F.lit("only_second")))


def zipped(left: DataFrame, right: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Rows of two tables by their place within a group; with ``agrees``: whether both have one there and it has the same key."""
    place = lambda df: df.select(group, F.col(key), F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("place"))
    l, r = place(left).withColumnRenamed(key, "left_key"), place(right).withColumnRenamed(key, "right_key")  # noqa: E741
    out = l.join(r, [group, "place"], "full_outer")
    return out.withColumn("agrees", F.coalesce(F.col("left_key") == F.col("right_key"), F.lit(False)))


def unequal_rows(part: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(key, problem): rows of a part that the source has not, or has otherwise; compared as JSON."""
    cols = [c for c in part.columns if c != key]
    text = lambda df, name: df.select(key, F.to_json(F.struct(*cols)).alias(name))
    j = text(part, "_p").join(text(source, "_s"), key, "left")
    problem = F.when(F.col("_s").isNull(), "not_in_source").when(F.col("_p") != F.col("_s"), "differs")
    return j.withColumn("problem", problem).where("problem IS NOT NULL").select(key, "problem")


def lineage_errors(declared: DataFrame, actual: DataFrame, versions: DataFrame) -> DataFrame:
    """(artifact, errors): declared artifacts (artifact, sha256, version, parent) against what is there (artifact, sha256) and the allowed versions."""
    a = actual.select("artifact", F.col("sha256").alias("_sha"))
    parents = declared.select(F.col("artifact").alias("parent"), F.lit(True).alias("_known")).distinct()
    v = versions.select("version").distinct().withColumn("_allowed", F.lit(True))
    j = declared.join(a, "artifact", "left").join(parents, "parent", "left").join(v, "version", "left")
    errors = names(
        F.when(F.col("_sha").isNull(), "missing_artifact"),
        F.when(F.col("_sha") != F.col("sha256"), "hash_differs"),
        F.when(F.col("_allowed").isNull(), "version_not_allowed"),
        F.when(F.col("parent").isNotNull() & F.col("_known").isNull(), "unknown_parent"),
    )
    return j.select("artifact", errors.alias("errors")).where(F.size("errors") > 0)


def recomputed(rows: DataFrame, key: list[str], stored: str, again: Column, rank: str | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose stored score is not what its parts give, or is out of 0 to 1: key, errors."""
    order = Window.partitionBy(*key[:-1]).orderBy(F.desc(stored), key[-1])
    out = rows.withColumn("_rank", F.row_number().over(order)) if rank else rows
    errors = names(
        F.when(~F.coalesce(F.col(stored).between(0, 1), F.lit(False)), "score_out_of_range"),
        F.when(~F.coalesce(F.abs(F.col(stored) - again) <= tolerance, F.lit(False)), "score_differs"),
        *([F.when(F.col(rank) != F.col("_rank"), "rank_differs")] if rank else []),
    )
    return out.select(*key, errors.alias("errors")).where(F.size("errors") > 0)


def release_gates(movies: DataFrame) -> DataFrame:
    """(movie_id, errors) of movies that may not be released: status, counts against line counts, open risks, ambiguities, several reviewers.

    ``movies``: movie_id, status, reviewer, alignment_rows, line_count, ambiguities, risks, qc_passed.
    """
    several = movies.where(F.col("status") == COMPLETE).agg((F.count_distinct("reviewer") > 1).alias("several"))  # one row
    m = movies.join(F.broadcast(several))
    done = F.col("status") == COMPLETE
    errors = names(
        F.when(~F.col("status").isin(COMPLETE, BLOCKED), "not_terminal"),
        F.when(done & (F.col("line_count") != F.col("alignment_rows")), "count_mismatch"),
        F.when(done & (F.col("risks") != 0), "open_risks"),
        F.when(done & (F.col("ambiguities") > MOST_AMBIGUITIES), "too_many_ambiguities"),
        F.when(done & ~F.col("qc_passed"), "qc_not_passed"),
        F.when(done & F.col("several"), "several_reviewers"),
    )
    return m.select("movie_id", errors.alias("errors")).where(F.size("errors") > 0)


def freeze(movies: DataFrame, errors: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """One row: movies, how many are complete and blocked, ambiguities packed, whether the release can be frozen, and a digest of its content."""
    n = movies.agg(
        F.count("*").alias("movies"),
        F.count_if(F.col("status") == COMPLETE).alias("complete"),
        F.count_if(F.col("status") == BLOCKED).alias("blocked"),
        F.sum(F.crc32(F.concat_ws("|", "movie_id", "status", F.col("alignment_rows").cast("string")).cast("binary"))).alias("digest"),
    )
    e, a = errors.agg(F.count("*").alias("failed")), ambiguities.agg(F.count("*").alias("packed"))
    return n.join(F.broadcast(e)).join(F.broadcast(a)).withColumn("frozen", F.col("failed") == 0)  # one row each


def final_qc(requests: DataFrame, responses: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """For each film: requests, exact coverage, rows by status, open risks and whether it passes.

    ``requests`` and ``responses``: key, request_id.  ``rows``: key, status, risk (null: none).
    """
    q = requests.groupBy(key, "request_id").agg(F.count("*").alias("_q"))
    p = responses.groupBy(key, "request_id").agg(F.count("*").alias("_p"))
    cover = q.join(p, [key, "request_id"], "full_outer").groupBy(key).agg(
        F.count("_q").alias("requests"), F.count_if(~(F.coalesce("_q", F.lit(0)) + F.coalesce("_p", F.lit(0)) * 10 == 11)).alias("uncovered")
    )
    counts = rows.groupBy(key).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("auto_aligned", "needs_review", "no_match")], F.count_if(F.col("risk").isNotNull()).alias("risks")
    )
    out = cover.join(counts, key, "full_outer").na.fill(0)
    return out.withColumn("passed", (F.col("uncovered") == 0) & (F.col("risks") == 0) & (F.col("needs_review") <= MOST_AMBIGUITIES))


def reviewed(rows: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, status, block_ids) with the decisions of reviewers (keys, decision, block_ids) put in; rows without one stay.

    match: reviewed with its blocks; no_match: without any; uncertain: stays open.
    """
    d = decisions.select(*keys, "decision", F.col("block_ids").alias("_b"))
    j = rows.join(d, keys, "left")
    status = F.when(F.col("decision") == "match", "reviewed_match").when(F.col("decision") == "no_match", "reviewed_no_match").when(F.col("decision") == "uncertain", "needs_review").otherwise(F.col("status"))
    blocks = F.when(F.col("decision") == "match", F.col("_b")).when(F.col("decision") == "no_match", F.array().cast("array<long>")).otherwise(F.col("block_ids"))
    return j.select(*keys, status.alias("status"), blocks.alias("block_ids"))
