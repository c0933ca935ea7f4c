"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneline.operators import subtitles as st
from sceneline.sources import files, sinks, subtitle_source
from sceneline.streaming import sessions

SRT = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i> there &amp; all\n\n2\n00:00:03,000 --> 00:00:04,000\n你好\nGood day\n\n3\n00:00:03,000 --> 00:00:04,000\n你好\ngood DAY\n\n4\n00:01:00,000 --> 00:01:02,000\nSubtitles by somebody\n"
VTT = "WEBVTT\n\n00:01.000 --> 00:02.000\nOne\n\nWEBVTT\n\n00:03.000 --> 00:04.000\nTwo\nlines\n"


@pytest.fixture
def subs(tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    (tmp_path / "b.vtt").write_text(VTT)
    return str(tmp_path)


def test_subtitles(spark, subs):
    raw = spark.read.text([f"{subs}/a.srt", f"{subs}/b.vtt"], wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("path"), "value")
    cues = sorted((r["path"], r["start_sec"], r["end_sec"], r["original_text"]) for r in st.cues(raw).collect())
    assert cues[0] == ("a.srt", 1.0, 2.5, "<i>Hello</i> there &amp; all")
    assert [c[3] for c in cues if c[0] == "b.vtt"] == ["One", "Two\nlines"]
    clean = [tuple(r) for r in st.clean_subtitles(st.cues(raw), lang="en").where("path = 'a.srt'").orderBy("subtitle_id").select("subtitle_id", "start", "cleaned_text", "detected_language").collect()]
    assert clean == [("subtitle_000001", "00:00:01.000", "Hello there & all", "en"), ("subtitle_000002", "00:00:03.000", "Good day", "en")]


def test_subtitle_source(spark, subs):
    subtitle_source.register(spark)
    rows = spark.read.format("subtitle").load(subs).orderBy("path", "cue").collect()
    assert [(r["path"][-5:], r["start_sec"], r["original_text"]) for r in rows][-2:] == [("b.vtt", 1.0, "One"), ("b.vtt", 3.0, "Two\nlines")]
    assert len(rows) == 6


def test_listing(spark, tmp_path):
    for p in ("A/tt1234567 film.mkv", "A/.hidden/x.mkv", "B/y.mp4.part", "B/z.MP4", "B/z_standardized.mp4", "B/n.nfo"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    found = files.videos(files.listing(spark, str(tmp_path)))
    assert sorted(r["relpath"] for r in found.collect()) == ["A/tt1234567 film.mkv", "B/z.MP4", "B/z_standardized.mp4"]
    inventory = spark.createDataFrame([("B/z.MP4",), ("B/z_standardized.mp4",), ("../q.mkv",)], "source_video_relpath string")
    assert [r["relpath"] for r in files.inventory_videos(files.listing(spark, str(tmp_path)), inventory).collect()] == ["B/z.MP4"]


def test_json_and_csv(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": 0.5}\n\n{"a": 2, "b": NaN}\n{"a": 3')
    good, bad = files.checked_jsonl(spark, str(tmp_path / "x.jsonl"), schema)
    assert [tuple(r) for r in good.collect()] == [(1, 0.5)]
    assert bad.count() == 2
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.strict_jsonl(spark, str(tmp_path / "x.jsonl"), schema).collect()
    (tmp_path / "x.csv").write_text("﻿Film,Year\nA,1999\n")
    assert files.csv_with_columns(spark, str(tmp_path / "x.csv"), ["Film"]).count() == 1
    with pytest.raises(ValueError, match="Winner"):
        files.csv_with_columns(spark, str(tmp_path / "x.csv"), ["Film", "Winner"])


def test_probe(spark):
    good = {"streams": [{"index": 0, "codec_type": "video", "codec_name": "hevc", "width": 3840, "height": 2160, "pix_fmt": "yuv420p10le", "avg_frame_rate": "24000/1001", "r_frame_rate": "24/1", "color_transfer": "smpte2084"}, {"index": 1, "codec_type": "audio"}], "format": {"duration": "30.03"}}
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, "{}"), (3, "junk")], "id long, payload string")
    got = {r["id"]: r for r in files.probes(rows).collect()}
    assert (got[1]["depth"], got[1]["hdr"], round(got[1]["fps"], 3), got[1]["audio_streams"], got[1]["error"]) == (10, True, 23.976, 1, None)
    assert got[2]["error"] == got[3]["error"] == "no video stream"
    t = files.frame_timestamps(spark.createDataFrame([(1, "pts_time=1.0|duration_time=0.04"), (1, "pts_time=N/A|duration_time=1"), (1, "pts_time=1.04|duration_time=N/A")], "k int, value string"), "k")
    assert sorted(((r["pts"], r["duration"]) for r in t.collect()), key=str) == [(1.0, 0.04), (1.04, None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, [1, 2]), (2, None, None)], "id long, x double, a array<int>")
    sinks.write_once_json(rows, str(tmp_path / "j"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.write_once_json(rows, str(tmp_path / "j"))
    with pytest.raises(Exception, match="no finite number"):
        sinks.write_once_json(rows.withColumn("x", F.lit(float("nan"))), str(tmp_path / "n"))
    sinks.write_csv(rows, str(tmp_path / "c"), ["id", "a"])
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == [("1", "[1,2]"), ("2", None)]
    sinks.append_new(rows, str(tmp_path / "p"), ["id"])
    sinks.append_new(rows.union(rows.withColumn("id", F.lit(3).cast("long"))), str(tmp_path / "p"), ["id"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    m = sinks.manifest(spark, str(tmp_path / "p"))
    assert sinks.manifest_problems(m, m.where("size >= 0")).count() == 0
    assert [r["problem"] for r in sinks.manifest_problems(m, m.withColumn("sha256", F.lit("x")).limit(1)).collect()].count("changed") == 1


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    rows = src.orderBy("user_id", "ts", "event_id").select("user_id", "event_id", "value").collect()
    want, run_, user = set(), [], None
    for r in rows:
        if r["user_id"] != user:
            run_, user = [], r["user_id"]
        if r["value"] > 60:
            run_.append(r)
        elif run_:
            top = max(run_, key=lambda x: (x["value"], -run_.index(x)))
            want.add((user, run_[0]["event_id"], top["event_id"], top["value"], len(run_)))
            run_ = []
    assert {tuple(r) for r in run(sessions.runs_above(stream, 60.0), "runs").collect()} == want
    closed = run(sessions.windowed_counts(stream), "windows")
    want = src.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert closed.join(want.select("event_type", F.col("w.start").alias("start"), "n"), ["event_type", "start", "n"], "left_anti").count() == 0
    assert closed.count() > 0
