"""Subtitle files to clean subtitle rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneline.functions import text as tx

_TIME = r"(?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3}"
_CUE = rf"(?m)^\s*({_TIME})\s*-->\s*({_TIME})[^\n]*\n"
#: A line that is nothing but a release credit.
CREDIT = r"(?i)^\s*(?:subtitles?|captions?|sync(?:ed|hronized)?|translat(?:ed|ion)|corrected|downloaded|encoded|ripped)\b[^\n]{0,80}\b(?:by|from)\b[^\n]*$"
_CJK = "[　-〿一-鿿＀-￯]"


def cues(files: DataFrame) -> DataFrame:
    """(path, value: whole text) to a row for each cue of SRT or WebVTT: path, cue, start, end, text.

    Repeated WEBVTT headers within a file, cue numbers and style blocks are left out.
    """
    raw = F.concat(F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "(?m)^﻿", ""), F.lit("\n"))
    heads = F.regexp_extract_all(raw, F.lit(_CUE), F.lit(0))
    bodies = F.slice(F.split(raw, _CUE, -1), F.lit(2), F.greatest(F.size(heads), F.lit(1)))
    rows = files.select("path", F.posexplode(F.arrays_zip(heads.alias("head"), bodies.alias("body"))).alias("cue", "c")).where("c.head IS NOT NULL")
    body = F.regexp_replace(F.col("c.body"), r"(?s)\n\s*\n.*$", "")
    body = F.regexp_replace(body, r"(?m)^\s*(?:WEBVTT[^\n]*|NOTE\b[^\n]*|STYLE\s*)$", "")
    return rows.select(
        "path",
        "cue",
        tx.clock_seconds(F.regexp_extract("c.head", _CUE, 1)).alias("start_sec"),
        tx.clock_seconds(F.regexp_extract("c.head", _CUE, 2)).alias("end_sec"),
        F.trim(body).alias("original_text"),
    )


def wanted_lines(text: Column, lang: str) -> Column:
    """The lines of a bilingual cue in one language; for English, CJK characters are taken out of what stays."""
    lines = F.filter(F.split(text, "\n"), lambda t: tx.language(t) == lang)
    if lang == "en":
        lines = F.transform(lines, lambda t: F.trim(F.regexp_replace(t, _CJK, "")))
    return F.array_join(F.filter(lines, lambda t: t != ""), "\n")


def clean_subtitles(cue_rows: DataFrame, key: str = "path", lang: str | None = None) -> DataFrame:
    """Cleaned cues without empty, credit and repeated ones, numbered by (start, end, text)."""
    original = wanted_lines(F.col("original_text"), lang) if lang else F.col("original_text")
    rows = cue_rows.withColumn("cleaned_text", tx.clean(tx.unescaped(original))).where((F.col("cleaned_text") != "") & ~F.col("cleaned_text").rlike(CREDIT))
    rows = first_of_each(rows, [key, "start_sec", "end_sec", F.lower("cleaned_text")], ["cue"])
    w = Window.partitionBy(key).orderBy("start_sec", "end_sec", "cleaned_text", "cue")
    return rows.select(
        key,
        F.format_string("subtitle_%06d", F.row_number().over(w)).alias("subtitle_id"),
        tx.clock(F.col("start_sec")).alias("start"),
        tx.clock(F.col("end_sec")).alias("end"),
        "start_sec",
        "end_sec",
        "original_text",
        "cleaned_text",
        tx.language(F.col("cleaned_text")).alias("detected_language"),
    )


def first_of_each(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row by ``order`` of each value of ``keys``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
