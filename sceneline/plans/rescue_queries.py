"""Review requests over films and what a search of the whole script adds to them.

Films are those of :mod:`sceneline.plans.script_queries`: a conversation is a scene, its turns are blocks.
A line takes a second and a half, every two seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneline.operators import alignment as al
from sceneline.operators import composite as cp
from sceneline.operators import highrisk as hr
from sceneline.operators import requests as rq
from sceneline.operators import rescue as rc
from sceneline.plans.analogs import table
from sceneline.plans.script_queries import script
from sceneline.sources.scratch import scratch_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` worked out once, for several steps to read."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def spoken(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks) as :mod:`sceneline.operators.requests` takes them, with the position of each line in its film."""
    lines, blocks = script(spark, sf_dir)
    c = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 5).cast("string").alias("movie_key"), (F.col("conv_id") % 5).alias("scene"), "conv_id", "turn")
    place = c.select("movie_key", "scene", (F.row_number().over(Window.partitionBy("movie_key").orderBy("conv_id", "turn")) - 1).cast("long").alias("block"))
    blocks, lines = stored(blocks.join(place, ["movie_key", "block"]), "blocks"), stored(lines, "lines")
    aligned = al.align(lines, blocks).select("movie_key", "line", "status", "method", "block_start", "block_end")
    position = (F.row_number().over(Window.partitionBy("movie_key").orderBy("line")) - 1).cast("long")
    rows = lines.join(aligned, ["movie_key", "line"]).withColumn("position", position)
    rows = rows.withColumns({"start": F.col("position") * 2.0, "end": F.col("position") * 2.0 + 1.5, "reliable": F.col("method").startswith("anchor_") & F.col("method").isNotNull(), "needs_review": F.col("status") != "auto_aligned"})
    return stored(rows.drop("status", "method"), "spoken"), blocks


def asked(spark, sf_dir):
    """(spoken rows, blocks, grouped rows, requests, candidates)."""
    rows, blocks = spoken(spark, sf_dir)
    grouped = stored(rq.grouped(rq.intervals(rows, blocks)), "grouped")
    requests = stored(rq.requests(grouped), "requests")
    return rows, blocks, grouped, requests, rq.candidates(requests, grouped, blocks)


@query
def review_requests(spark, sf_dir):
    """Requests with their lines, part of the script and number of candidates."""
    _, _, _, requests, candidates = asked(spark, sf_dir)
    n = candidates.groupBy("movie_key", "request_id").agg(F.count("*").alias("candidates"))
    out = requests.join(n, ["movie_key", "request_id"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    return out.select("movie_key", "request_id", F.array_join(F.transform("lines", lambda n: n.cast("string")), ",").alias("lines"), "reason", "fallback", "low", "high", "candidates", (F.col("candidates") == 0).alias("insufficient"))


@query
def review_candidates(spark, sf_dir):
    """Candidates of every request in script order."""
    found = asked(spark, sf_dir)[4]
    return found.select("movie_key", "request_id", "block", "score", F.array_join("methods", "+").alias("methods"))


def searched(spark, sf_dir, version: str):
    """(candidates, limits, rescued) of every request, each without the blocks that it has already."""
    rows, blocks, _, requests, candidates = asked(spark, sf_dir)
    has = candidates.groupBy("movie_key", "request_id").agg(F.collect_list("block").alias("existing"))  # 36 blocks at most
    anchors = F.array_compact(F.array("before", "after")).alias("anchors")
    own = requests.select("movie_key", "request_id", "first", "last", anchors).join(has, ["movie_key", "request_id"], "left")
    own = own.withColumn("existing", F.coalesce("existing", F.array().cast("array<long>")))
    lines = rc.query_lines(own, rows.select("movie_key", "line", "position", "tokens"), version)
    limits = requests.select("movie_key", "request_id", F.lit(rq.Limits().candidates).alias("candidate_limit"))
    return candidates, limits, rc.rescued(rc.search_script(lines, blocks.select("movie_key", "block", "tokens"), version))


def _rescue(version):
    def run(spark, sf_dir):
        found = searched(spark, sf_dir, version)[2]
        return found.select("movie_key", "request_id", "block", "score", F.array_join("methods", "+").alias("methods"))

    run.__name__ = f"script_rescue_{version}"
    run.__doc__ = f"What a search of the whole script ({version}) adds to every request."
    return query(run)


for _version in ("v2", "v3", "v4"):
    _rescue(_version)


@query
def rescued_requests(spark, sf_dir):
    """Candidates of every request after the search (v4), within its limit."""
    return rc.augment(*searched(spark, sf_dir, "v4")).select("movie_key", "request_id", "block", "score", F.array_join("methods", "+").alias("methods"), "added")


def resolved(spark, sf_dir) -> DataFrame:
    """A resolution of every line of the review requests: some take the first candidate, some two, some none; every sixth line is two turns."""
    _, blocks, grouped, _, candidates = asked(spark, sf_dir)
    own = candidates.join(blocks.select("movie_key", "block", "tokens"), ["movie_key", "block"]).groupBy("movie_key", "request_id").agg(F.array_sort(F.collect_list(F.struct("block", "tokens"))).alias("candidates"))
    r = grouped.join(own, ["movie_key", "request_id"])
    k, ids = F.col("line") + F.col("request_id"), F.transform("candidates", lambda c: c["block"])
    words = lambda a, n: F.array_join(F.slice("tokens", a, n), " ")
    text = F.when(F.col("line") % 6 == 0, F.concat(F.lit("- "), words(1, 3), F.lit(" - "), words(4, 9))).otherwise(F.array_join("tokens", " "))
    automatic = F.when(F.col("block_start").isNotNull(), F.sequence("block_start", "block_end")).otherwise(F.array().cast("array<long>"))
    return r.select(
        "movie_key", "request_id", "line", text.alias("text"), "tokens", F.when(F.col("request_id") % 4 == 1, "multi").otherwise("fuzzy").alias("stratum"), F.slice(ids, F.lit(1), (k % 3).cast("int")).alias("selected"),
        automatic.alias("automatic"), F.when(k % 3 == 0, "uncertain").otherwise("match").alias("decision"), (k % 10 / 10.0 + 0.05).alias("confidence"), "candidates",
    )


def audited(rows: DataFrame) -> DataFrame:
    return rows.withColumn("flags", cp.flags(*[F.col(c) for c in ("text", "tokens", "stratum", "selected", "automatic", "decision", "confidence", "candidates")]))


@query
def composite_audit(spark, sf_dir):
    """Resolutions with a flag."""
    found = audited(resolved(spark, sf_dir)).where(F.size("flags") > 0)
    return found.select("movie_key", "request_id", "line", "decision", "confidence", F.array_join("flags", "+").alias("flags"))


@query
def composite_audit_summary(spark, sf_dir):
    return cp.audit_summary(audited(resolved(spark, sf_dir)))


def calibration(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(references, requests) of conversations as requests: the user's turns are lines, the others candidates; some references are at fault."""
    c, t, k = table(spark, sf_dir, "conversations"), F.col("turn").cast("long"), F.col("request_id")
    user = F.col("role") == "user"
    requests = c.groupBy(F.col("conv_id").cast("long").alias("request_id")).agg(
        F.array_sort(F.collect_list(F.when(user, F.struct(t.alias("line"), F.col("text").alias("text"))))).alias("lines"), F.array_sort(F.collect_list(F.when(~user, t))).alias("candidates")
    )
    best = F.slice("candidates", 1, 1)
    blocks = lambda line: F.when(k % 11 == 3, F.array(F.lit(77).cast("long"))).when(k % 13 == 4, F.concat(best, best)).when(line["line"] % 4 == 0, best).otherwise(F.array().cast("array<long>"))
    decision = lambda line: F.when(k % 17 == 5, "perhaps").when(line["line"] % 4 == 0, "match").otherwise("no_candidate_match")
    one = lambda line: F.struct(line["line"].alias("line"), F.when(k % 7 == 2, F.upper(line["text"])).otherwise(line["text"]).alias("text"), decision(line).alias("decision"), blocks(line).alias("blocks"))
    order = F.when(k % 19 == 6, F.reverse("lines")).otherwise(F.col("lines"))
    copy = F.struct("request_id", "lines", F.when(k % 23 == 7, F.reverse("candidates")).otherwise(F.col("candidates")).alias("candidates"))
    number = F.when(k % 29 == 8, k + 10**6).when(k % 31 == 9, k - 1).otherwise(k)
    references = requests.select(number.alias("request_id"), (k % 37 == 10).alias("human_gold"), copy.alias("request"), F.transform(order, one).alias("resolutions"))
    return references, requests


@query
def calibration_errors(spark, sf_dir):
    """What is wrong with a calibration reference, request by request."""
    return cp.reference_errors(*calibration(spark, sf_dir))


def decided(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, requests, candidates, blocks) as :mod:`sceneline.operators.highrisk` takes them: a decision on every line of the review requests.

    Decisions, grounds and confidences follow from the numbers of lines; texts, candidates, anchors and the
    script are those of the requests.  Of every third request only one candidate in three is supplied.
    """
    _, blocks, grouped, requests, candidates = asked(spark, sf_dir)
    candidates = stored(candidates.where((F.col("request_id") % 3 > 0) | (F.col("block") % 3 == 0)).select("movie_key", "request_id", "block"), "supplied")
    own = candidates.groupBy("movie_key", "request_id").agg(F.array_sort(F.collect_list("block")).alias("ids"))  # 36 blocks at most
    k = F.col("line") + F.col("request_id")
    words = lambda a, n: F.array_join(F.slice("tokens", a, n), " ")
    said = F.array_join("tokens", " ")
    text = F.when(F.col("line") % 6 == 0, F.concat(F.lit("- "), words(1, 3), F.lit("\n- "), words(4, 9))).when(F.col("line") % 13 == 4, F.concat(F.lit("["), said, F.lit("]"))).otherwise(said)
    ids = F.coalesce("ids", F.array().cast("array<long>"))
    found = (k % 3 == 0) & (F.size(ids) > 0)
    at = (F.pmod(k * 7, F.size(ids)) + 1).cast("int")
    basis = F.when(k % 5 == 1, hr.VOCATIVE).when(k % 7 == 2, hr.REORDERED).otherwise("paraphrase")
    rows = grouped.join(own, ["movie_key", "request_id"], "left").select(
        "movie_key", "request_id", "line", text.alias("text"), "tokens", F.when(found, "match").otherwise(hr.NO_MATCH).alias("decision"), basis.alias("basis"), (k % 10 / 10.0 + 0.05).alias("confidence"),
        F.when(found, F.slice(ids, at, (k % 2 + 1).cast("int"))).otherwise(F.array().cast("array<long>")).alias("selected"),
        F.when(F.col("block_start").isNotNull(), k % 20 / 20.0).alias("semantic"), F.col("block_start").isNotNull().alias("automatic"),
    )
    scenes = blocks.select("movie_key", F.col("block").alias("_first"), "scene")
    rows = rows.withColumn("_first", F.array_min("selected")).join(scenes, ["movie_key", "_first"], "left").drop("_first")
    asks = requests.select("movie_key", "request_id", F.col("before").alias("lower"), F.col("after").alias("upper"), "fallback", F.lit(rq.Limits().candidates).alias("candidate_limit"), (F.col("request_id") % 9 == 4).alias("parser_warning"))
    return rows, asks, candidates, blocks


@query
def high_risk_audit(spark, sf_dir):
    """Decisions with a reason to look at them, and the class of those without a match."""
    found = hr.audit(*decided(spark, sf_dir))
    return found.withColumns({"reasons": F.array_join("reasons", "+"), "evidence": F.array_join("evidence", "+")})


@query
def high_risk_summary(spark, sf_dir):
    """Counts of reasons and classes."""
    return hr.summary(hr.audit(*decided(spark, sf_dir)))


@query
def outside_matches(spark, sf_dir):
    """What lines without a match have in the script outside their candidates."""
    rows, requests, candidates, blocks = decided(spark, sf_dir)
    return hr.outside(rows.where(F.col("decision") == hr.NO_MATCH), requests, candidates, blocks)
