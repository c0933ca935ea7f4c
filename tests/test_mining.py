"""Mining operators on a few shots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneline.functions import media as fm
from sceneline.operators import intervals, media, mining, verify


def test_semantic_and_exclusion(spark):
    rows = [("s1", True, True, True, 2, 1.0, False, False, "a"), ("s2", False, True, False, 1, None, True, True, None), ("s3", False, False, True, 0, 0.5, False, False, None)]
    shots = spark.createDataFrame(rows, "shot_id string, action_during boolean, action_near boolean, subtitle boolean, speakers int, context double, pending boolean, transition boolean, scene string")
    got = mining.semantic_score(shots).withColumn("why", mining.exclusion(F.col("pending"), F.col("transition"), F.col("scene"))).orderBy("shot_id").collect()
    assert [round(r["semantic_score"], 6) for r in got] == [1.0, 0.30, 0.30]
    assert [r["why"] for r in got] == [None, "pending_ambiguity", "unresolved_scene"]


def test_relevance(spark):
    rows = [("m", 1, ["ANNA"], 1, None, None, "hello"), ("m", 2, ["BOB"], 1, None, None, "nothing"), ("m", 3, [], 2, "Anna runs", None, ""), ("m", 4, ["BOB"], 3, None, "annabel sits", "so, Anna?"), ("m", 5, [], 4, None, None, None)]
    shots = spark.createDataFrame(rows, "movie_key string, shot int, speakers array<string>, scene int, during string, near string, text string")
    got = mining.target_relevance(shots, ["ANNA"]).orderBy("shot").collect()
    assert [(r["relevance"], r["band"]) for r in got] == [(1.0, "high"), (0.45, "medium"), (0.9, "high"), (0.85, "high"), (0.0, "none")]


def test_pending_and_faces(spark):
    shots = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", ["z"])], "shot_id string, subtitles array<string>")
    got = mining.exclude_pending(shots, spark.createDataFrame([("y",), ("q",)], "subtitle_id string")).orderBy("shot_id").collect()
    assert [r["pending"] for r in got] == [True, False, False]
    faces = spark.createDataFrame([("a", 1, 0.2, True), ("a", 1, 0.1, True), ("b", 0, 0.0, True), ("b", 1, 0.01, False)], "shot_id string, face_count int, max_face_area_ratio double, usable boolean")
    got = {r["shot_id"]: r for r in mining.face_score(faces).collect()}
    assert got["a"]["face_score"] == pytest.approx(1.0) and got["a"]["ineligible"] is None
    assert got["b"]["face_score"] == pytest.approx(0.25 + 0.025 + 0.075) and got["b"]["ineligible"] == "too_few_usable_frames"


def test_events(spark):
    rows = [("e", 1, 0.0, 10.0, 0.5, ["a"]), ("e", 2, 12.0, 14.0, 1.0, ["a", "b"]), ("f", 9, 0.0, 1.0, 0.99, ["a"])]
    members = spark.createDataFrame(rows, "event string, shot int, start double, end double, score double, categories array<string>")
    got = {r["event"]: r for r in mining.event_summary(members, ["event"]).collect()}
    assert got["e"]["event_score"] == pytest.approx((5 + 2) / 12 + 0.05 * 0.75) and got["e"]["shots"] == [1, 2] and got["e"]["end"] == 14.0
    assert got["f"]["consistency"] == 0.0


def test_review_gate(spark):
    rows = [(True, "good", True)] * 8 + [(True, "bad", None)] * 2 + [(False, "bad", None)] * 9 + [(False, "good", None)]
    r = mining.review_evaluation(spark.createDataFrame(rows, "selected boolean, verdict string, boundary_ok boolean")).first()
    assert (r["precision"], r["false_negative_rate"], r["boundary_acceptance"], r["passed"]) == (0.8, 0.1, 1.0, True)
    assert mining.review_evaluation(spark.createDataFrame([], "selected boolean, verdict string, boundary_ok boolean")).first()["passed"] is False


def test_boxes_and_paths(spark):
    left = spark.createDataFrame([("s", 1, [0.0, 0.0, 10.0, 10.0]), ("s", 2, [50.0, 50.0, 60.0, 60.0])], "shot string, face int, box array<double>")
    right = spark.createDataFrame([("s", 7, [1.0, 1.0, 11.0, 11.0]), ("s", 8, [8.0, 8.0, 30.0, 30.0])], "shot string, other int, obox array<double>")
    got = verify.best_box(left, right, ["shot"], "box", "obox", "other").collect()
    assert [(r["face"], r["other"]) for r in got] == [(1, 7)]
    paths = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/x",)], "path string")
    maps = spark.createDataFrame([("/a", "/A"), ("/a/b", "/B")], "source string, target string")
    assert {r["path"]: r["resolved"] for r in media.longest_prefix(paths, maps).collect()} == {"/a/b/c": "/B/c", "/a/bc": "/A/bc", "/x": "/x"}


    for wrong, sources in (("x/y", maps), ("/a/../b", maps), ("/a/b", maps.union(maps))):
        with pytest.raises(Exception, match="outside its folder|given twice"):
            media.longest_prefix(spark.createDataFrame([(wrong,)], "path string"), sources).collect()


def test_file_categories_and_keys(spark):
    names = {"a/b.JPG": "IMAGE_ASSET", "x.nfo": "RELEASE_METADATA", "x.sfv": "RELEASE_METADATA", "x.torrent": "RELEASE_METADATA", "x.7z": "ARCHIVE", "x.scr": "EXECUTABLE_OR_SCRIPT", "x.sh": "UNKNOWN", "x.tar": "UNKNOWN", ".txt": "UNKNOWN", "a.zip/b": "UNKNOWN"}
    df = spark.createDataFrame(list(names.items()), "name string, want string")
    assert df.where(fm.file_category(F.col("name")) != F.col("want")).count() == 0
    keys = {"a/TT1234567 x.mkv": "tt1234567", "tt7654321_b/part.2.mkv": "tt7654321", "Some Film (2001)/Disc 1.mkv": "some_film_2001__disc_1", "ﬁlm/№1.mkv": "film__no1", ".mkv": "mkv"}
    df = spark.createDataFrame(list(keys.items()), "path string, want string")
    assert [(r["path"], r["key"]) for r in df.withColumn("key", fm.movie_key(F.col("path"))).collect() if r["key"] != r["want"]] == []
    assert spark.createDataFrame([("日本.mkv",)], "path string").select(fm.movie_key(F.col("path")).alias("k")).first()["k"].startswith("movie_")


def test_gallery_in_blocks(spark, monkeypatch):
    """Blocks and keys of any size give the plain result, by an equality join; repeated vectors are ties."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 6))
    x[10:20] = x[10]
    u = verify.normalized(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, e array<double>"), "e")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((i, k, j) for i in range(60) for k, (_, j) in enumerate(sorted((-round(float(x[i] @ x[j]), 9), j) for j in range(0, 60, 2) if j != i)[:3], 1))
    for block, key in ((256, 20_000), (7, 9)):
        monkeypatch.setattr(verify, "GALLERY_BLOCK", block)
        monkeypatch.setattr(verify, "QUERY_BLOCK", key)
        top = verify.gallery_top_k(u, u.where("vec_id % 2 = 0"), "vec_id", 3)
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in top.collect()) == want
        best = verify.best_similarity(u, u.where("vec_id % 2 = 0"), "vec_id", [])
        assert all(abs(r["similarity"] - max(float(x[r["query_id"]] @ x[j]) for j in range(0, 60, 2) if j != r["query_id"])) < 1e-9 for r in best.collect())
        plan = top._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert verify.gallery_top_k(u, u.limit(0), "vec_id", 3).count() == 0


def test_interval_join_is_the_plain_join(spark):
    a = spark.range(60).selectExpr("id % 3 AS k", "id AS x", "id * 1.7 AS start", "id * 1.7 + (id % 7) AS end")
    b = spark.range(80).selectExpr("id % 3 AS k", "id AS y", "id * 1.3 AS sub_start", "id * 1.3 + (id % 5) AS sub_end")
    a, b = (d.select(*[F.col(c).cast("double").alias(c) if c not in ("k", "x", "y") else F.col(c) for c in d.columns]) for d in (a, b))
    want = a.join(b, "k").where("sub_start < end AND sub_end > start AND sub_end > sub_start AND end > start").select("k", "x", "y")
    for width in (0.5, 3.0, 1000.0):
        got = intervals.interval_join(a, b, ["k"], width).select("k", "x", "y")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
