"""The listing source against the file system, and the preflight of folders that it lists."""

import os

import pytest
from pyspark.sql import functions as F

from sceneline.operators import preflight as pf
from sceneline.sources import listing_source as ls


@pytest.fixture
def tree(tmp_path):
    for name in ("tt0000001_a/Film.mkv", "tt0000001_a/sub/x.EN.srt", "tt0000001_a/.cache/y.mkv", "tt0000001_a/trailer.mp4", "b/one.mp4", "b/two.mp4", "b/pic.JPG", "b/.hidden", "b/end.", "c/deep/er/list.nfo", "loose.txt", ".secret/z.mkv"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * len(name))
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def plain(root):
    out = set()
    for base, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".")]
        for n in names:
            rel = os.path.relpath(os.path.join(base, n), root)
            if not n.startswith("."):
                out.add((rel.split("/")[0] if "/" in rel else "", rel, n, os.path.splitext(n)[1][1:].lower(), os.path.getsize(os.path.join(base, n))))
    return out


def test_listing(spark, tree):
    ls.register(spark)
    for per_task in (1, 2, 64):
        files = spark.read.format("listing").option("foldersPerTask", per_task).load(tree)
        assert {tuple(r)[:5] for r in files.collect()} == plain(tree)
    assert files.where("modified IS NULL").count() == 0
    for test in (F.col("folder") == "b", F.col("folder").isin("b", "c", "q"), F.col("extension") == "mp4", (F.col("folder") == "b") & F.col("extension").isin("mp4", "jpg") & (F.col("size") > 8), F.col("folder") == "nowhere", (F.col("folder") == "b") & (F.col("folder") == "c"), F.col("folder") == ""):
        want = {r for r in plain(tree)}
        got = {tuple(r)[:5] for r in files.where(test).collect()}
        rows = spark.createDataFrame(sorted(want), "folder string, relpath string, name string, extension string, size long")
        assert got == {tuple(r) for r in rows.where(test).collect()}


def test_pushed_filters():
    """Folders that are not asked for make no partition; other filters are left to Spark."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = ls.ListingReader("/tmp", 1)
    other = GreaterThan(("size",), 3)
    assert list(reader.pushFilters([EqualTo(("folder",), "a"), In(("folder",), ("a", "b")), In(("extension",), ("x", "y")), other])) == [other]
    assert reader.wanted == {"folder": {"a"}, "extension": {"x", "y"}}


PROBE = "relpath string, duration double, width int, height int, fps double, codec string, depth int, hdr boolean, languages array<string>"


def probe(path, seconds, tags=()):
    return (path, seconds, 1920, 800, 23.976, "h264", 8, False, list(tags))


def test_preflight_of_a_tree(spark, tree):
    ls.register(spark)
    files = spark.read.format("listing").load(tree)
    probes = spark.createDataFrame([probe("tt0000001_a/Film.mkv", 6000.0, ["eng", "fr"]), probe("tt0000001_a/trailer.mp4", 5000.0), probe("b/one.mp4", 3000.0), probe("b/two.mp4", 2800.0), probe("b/two.mp4", 2800.0)], PROBE)
    rows = pf.described(files, probes)
    chosen = pf.primaries(rows)
    got = {r["movie_key"]: r for r in pf.preflight(rows, chosen).collect()}
    assert set(got) == {"tt0000001_a", "b", "c"}
    a, b, c = (got[k] for k in ("tt0000001_a", "b", "c"))
    assert (a["movie_id"], a["primary_video_path"], a["primary_video_confidence"], a["auxiliary_video_count"]) == ("tt0000001", "tt0000001_a/Film.mkv", "high", 1)
    assert a["primary_video_canonical_name"] == "tt0000001_a.1920x800.23.976fps.h264.8bit.sdr.mkv" and a["has_embedded_english_subtitle"] and not a["manual_review_required"] and a["manual_review_reasons"] == ""
    assert (b["primary_video_confidence"], b["manual_review_reasons"], b["image_asset_count"], b["unknown_file_count"]) == ("ambiguous", "MISSING_MOVIE_ID;MULTIPLE_FULL_MOVIE_CANDIDATES;MANUAL_REVIEW", 1, 1)
    assert (c["primary_video_confidence"], c["manual_review_reasons"], c["release_metadata_count"]) == ("none", "MISSING_MOVIE_ID;NO_USABLE_PRIMARY_VIDEO;MANUAL_REVIEW", 1)
    steps = {(r["source"], r["action"], r["destination"]) for r in pf.plan(rows, chosen).collect()}
    assert steps == {
        ("tt0000001_a/Film.mkv", "RENAME", "tt0000001_a/tt0000001_a.1920x800.23.976fps.h264.8bit.sdr.mkv"), ("tt0000001_a/sub/x.EN.srt", "RENAME", "tt0000001_a/sub/tt0000001_a.en.srt"),
        ("tt0000001_a/trailer.mp4", "QUARANTINE", "tt0000001_a/trailer.mp4"), ("b/pic.JPG", "QUARANTINE", "b/pic.JPG"), ("c/deep/er/list.nfo", "QUARANTINE", "c/deep/er/list.nfo"),
    }


def test_no_files(spark):
    files = spark.createDataFrame([], "folder string, relpath string, name string, extension string")
    rows = pf.described(files, spark.createDataFrame([], PROBE))
    chosen = pf.primaries(rows)
    (total,) = pf.preflight_summary(pf.preflight(rows, chosen), pf.plan(rows, chosen)).collect()
    assert set(total.asDict().values()) == {0}


def test_files_are_read_and_shuffled_once(spark):
    """Each query on one scan and one shuffle of the files: it had a scan and a shuffle of files and probes for each of its parts."""
    from sceneline.plans.preflight_queries import QUERIES

    for name in ("source_preflight", "cleanup_plan", "preflight_totals"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, name


def test_probes_beside_or_in_the_files(spark):
    """The same rows from files with probes of their own, repeated ones among them, and from two tables; with films chosen before or in the same pass."""
    names = ["a.mkv", "B.mkv", "b.mkv", "x.en.srt", "X.en.srt", "y.vtt", "sample.mp4", "p.jpg", "r.zip", "q.bin"]
    rows = [(f, f"{f}/{n}", n, n.rsplit(".", 1)[1], *probe("", d, t)[1:]) for i, f in enumerate(("tt0000001_a", "b", "c", "")) for k, n in enumerate(names[i:]) for d, t in ((3000.0 + i * k, ["eng"]), (None if (i + k) % 3 else 2900.0, ["fr"]), (3000.0, []))[: 1 + k % 3]]
    both = spark.createDataFrame(rows, "folder string, relpath string, name string, extension string, " + PROBE.split(", ", 1)[1])
    one, two = pf.described(both), pf.described(both.select("folder", "relpath", "name", "extension"), both.drop("folder", "name", "extension"))
    same = lambda a, b: sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))
    chosen = pf.primaries(two)
    assert same(one, two) and one.count() == 27 and chosen.count() > 0
    assert same(pf.preflight(one), pf.preflight(two, chosen)) and same(pf.plan(one), pf.plan(two, chosen)) and pf.plan(one).count() > 0
    assert same(pf.preflight_summary(pf.preflight(one, planned=True)), pf.preflight_summary(pf.preflight(two, chosen), pf.plan(two, chosen)))
    (empty,) = pf.preflight_summary(pf.preflight(pf.described(both.where("false")), planned=True)).collect()
    assert set(empty.asDict().values()) == {0}
