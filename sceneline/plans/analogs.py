"""The driver's tables in the roles of film tables.

A user is a film; the user's events in time order are its frames; purchases cut
the timeline into shots; an event with its value in minutes is a subtitle; a
conversation is a scene, its turns are blocks and its roles are speakers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(col: str = "ts"):
    """Seconds since the epoch with microseconds, exact in a double for centuries."""
    return F.unix_micros(F.col(col).cast("timestamp")) / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movie_key, frame, confidence (value / 200), pts (seconds)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("movie_key"),
        (F.row_number().over(w) - 1).cast("long").alias("frame"),
        (F.col("value") / 200).alias("confidence"),
        seconds().alias("pts"),
        "event_id",
        "event_type",
    )


FRAMES_SQL = """
f AS (
  SELECT user_id AS movie_key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
         value / 200 AS confidence, epoch_us(ts) / 1e6 AS pts, event_id, event_type
  FROM events
)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movie_key, shot (1-based), start, end in seconds: the time between two purchases of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.col("user_id").alias("movie_key"), F.row_number().over(w).cast("long").alias("shot"), seconds().alias("start"), F.lead(seconds()).over(w).alias("end")
    )
    return rows.where("end IS NOT NULL")


SHOTS_SQL = """
s AS (
  SELECT * FROM (
    SELECT user_id AS movie_key, CAST(row_number() OVER w AS BIGINT) AS shot, epoch_us(ts) / 1e6 AS start, lead(epoch_us(ts) / 1e6) OVER w AS "end"
    FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
  ) WHERE "end" IS NOT NULL
)"""


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movie_key, subtitle (event_id), scene (event type), sub_start, sub_end: as many minutes as the value."""
    return events(spark, sf_dir).where("event_type <> 'purchase'").select(
        F.col("user_id").alias("movie_key"),
        F.col("event_id").alias("subtitle"),
        F.col("event_type").alias("scene"),
        seconds().alias("sub_start"),
        (seconds() + F.col("value") * 60).alias("sub_end"),
    )


SUBTITLES_SQL = """
u AS (
  SELECT user_id AS movie_key, event_id AS subtitle, event_type AS scene, epoch_us(ts) / 1e6 AS sub_start, epoch_us(ts) / 1e6 + value * 60 AS sub_end
  FROM events WHERE event_type <> 'purchase'
)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, source_order, speaker, text, block_type (system turns are action)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("scene_id"),
        F.col("turn").alias("source_order"),
        F.col("role").alias("speaker"),
        "text",
        F.when(F.col("role") == "system", "action").otherwise("dialogue").alias("block_type"),
    )


BLOCKS_SQL = """
b AS (
  SELECT conv_id AS scene_id, turn AS source_order, role AS speaker, text, CASE WHEN role = 'system' THEN 'action' ELSE 'dialogue' END AS block_type
  FROM conversations
)"""
