"""Readers with contracts: listings, strict JSON, CSV with required columns, probes, timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneline.functions import media as md

VIDEO_EXTENSIONS = ("mkv", "mp4", "m4v", "mov", "avi", "ts", "webm", "wmv", "mpg", "mpeg")
PARTIAL_SUFFIXES = (".part", ".crdownload", ".tmp", ".!qb")


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, relpath, size, modified of all files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace("path", rf"^.*?{_quoted(base)}/", "")
    return files.select("path", rel.alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def hidden(relpath: Column) -> Column:
    return F.exists(F.split(relpath, "/"), lambda p: F.startswith(p, F.lit(".")))


def videos(files: DataFrame) -> DataFrame:
    """The video files of a listing: no hidden ones, none that are still being written."""
    low = F.lower("relpath")
    partial = F.lit(False)
    for s in PARTIAL_SUFFIXES:
        partial = partial | F.endswith(low, F.lit(s))
    return files.where(~hidden(F.col("relpath")) & ~partial & F.regexp_extract(low, r"\.([^./]+)$", 1).isin(*VIDEO_EXTENSIONS))


def inventory_videos(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """The videos named by an inventory (source_video_relpath), without standardized ones and paths that leave the root."""
    named = inventory.select(F.col("source_video_relpath").alias("relpath")).where(~F.col("relpath").rlike(r"(?:^|/)\.\.(?:/|$)|^/"))
    return videos(files).join(named.distinct(), "relpath", "left_semi").where(~F.col("relpath").rlike(r"_standardized\.[^./]+$"))


def folders(files: DataFrame) -> DataFrame:
    """A row for each top folder: folder, files, size."""
    return files.where(~hidden(F.col("relpath")) & F.contains("relpath", F.lit("/"))).groupBy(F.split_part("relpath", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a fixed schema; a malformed line or a NaN fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)


def checked_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of JSON lines; blank lines are neither."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"}).alias("r"))
    return parsed.where("r._bad IS NULL").select("r.*").drop("_bad"), parsed.where("r._bad IS NOT NULL").select("value")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def csv_with_columns(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header, all strings; missing columns are an error before anything is read."""
    rows = spark.read.option("header", "true").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{path}: no columns {', '.join(missing)}")
    return rows


PROBE = "struct<streams: array<struct<index: int, codec_type: string, codec_name: string, width: int, height: int, pix_fmt: string, bits_per_raw_sample: string, avg_frame_rate: string, r_frame_rate: string, nb_frames: string, color_transfer: string, side_data_list: array<struct<side_data_type: string>>, tags: map<string, string>, disposition: map<string, int>>>, format: struct<format_name: string, duration: string, size: string, bit_rate: string>>"


def probes(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Columns of a media probe from its JSON text: codec, width, height, fps, depth, HDR, streams; error where it is no probe."""
    p = F.from_json(payload, PROBE)
    out = rows.withColumn("_p", p)
    video = F.try_element_at(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(1))
    out = out.withColumn("_v", video)
    avg, real = md.frame_rate(F.col("_v.avg_frame_rate")), md.frame_rate(F.col("_v.r_frame_rate"))
    fps = F.when(avg > 0, avg).otherwise(real)
    side = F.transform("_v.side_data_list", lambda s: s["side_data_type"])
    return out.select(
        *rows.columns,
        F.col("_v.codec_name").alias("codec"),
        "_v.width",
        "_v.height",
        fps.alias("fps"),
        F.col("_v.nb_frames").try_cast("long").alias("frame_count"),
        md.bit_depth(F.col("_v.bits_per_raw_sample"), F.coalesce("_v.pix_fmt", F.lit(""))).alias("depth"),
        md.is_hdr(F.col("_v.color_transfer"), F.coalesce(side, F.array().cast("array<string>"))).alias("hdr"),
        F.col("_p.format.duration").try_cast("double").alias("duration"),
        F.size(F.filter("_p.streams", lambda s: s["codec_type"] == "audio")).alias("audio_streams"),
        F.size(F.filter("_p.streams", lambda s: s["codec_type"] == "subtitle")).alias("subtitle_streams"),
        F.when(F.col("_v").isNull(), "no video stream").when(~(fps > 0), "no frame rate").alias("error"),
    )


def frame_timestamps(lines: DataFrame, key: str, value: str = "value") -> DataFrame:
    """``pts_time=1.0|duration_time=0.04`` lines to pts and duration; lines without a time are left out."""
    m = F.str_to_map(value, F.lit(r"\|"), F.lit("="))
    return lines.select(key, m["pts_time"].try_cast("double").alias("pts"), m["duration_time"].try_cast("double").alias("duration")).where("pts IS NOT NULL")
