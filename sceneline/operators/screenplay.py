"""Screenplay layout lines to scenes and blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIMES = "DAY|NIGHT|MORNING|EVENING|AFTERNOON|DAWN|DUSK|LATER|CONTINUOUS|SUNSET|SUNRISE|MOMENTS LATER|SAME TIME"
#: number?, INT/EXT, location, time of day or year, number?
SLUG = rf"^\s*(?:(\d+[A-Z]?)\.?\s+)?(INT\.?/EXT|EXT\.?/INT|I/E|INT|EXT)[. ]+\s*(.*?)(?:\s+[-–—]+\s*({_TIMES}|(?:19|20)\d\d)\.?)?(?:\s+(\d{{1,3}}[A-Z]?)\.?)?\s*$"
TRANSITION = r"^\s*(?:FADE (?:IN|OUT|TO BLACK)|(?:SMASH |MATCH |JUMP )?CUT TO|DISSOLVE TO|WIPE TO)\b.*:?\s*$"
CUE_NOTE = r"\s*\((?:CONT'?D|V\.? ?O\.?|O\.? ?S\.?|OFF|CONTINUING)\.?\)\s*"
NOISE = r"^\s*(?:\d+\.?|\(?(?:CONTINUED|MORE)\)?:?(?:\s*\(\d+\))?|-{2,}|\*+)\s*$"


def normal_cue(text: Column) -> Column:
    """A cue without (CONT'D), (V.O.) and the like."""
    return F.trim(F.regexp_replace(F.upper(text), CUE_NOTE, ""))


def scene_id(number: Column) -> Column:
    """``12A`` is scene_012A; other text is kept in letters, digits and underscores."""
    digits = F.regexp_extract(number, r"^(\d+)([A-Za-z]?)$", 1)
    letter = F.upper(F.regexp_extract(number, r"^(\d+)([A-Za-z]?)$", 2))
    other = F.regexp_replace(number, "[^A-Za-z0-9]+", "_")
    return F.concat(F.lit("scene_"), F.when(digits != "", F.concat(F.lpad(digits, 3, "0"), letter)).otherwise(other))


def slug_parts(text: Column) -> Column:
    """(number, int_ext, location, time_of_day) of a slug line; empty strings for what is not there."""
    part = lambda i: F.regexp_extract(F.upper(text), SLUG, i)
    number = F.when(part(1) != "", part(1)).otherwise(part(5))
    return F.struct(number.alias("number"), part(2).alias("int_ext"), F.trim(part(3)).alias("location"), part(4).alias("time_of_day"))


def looks_like_cue(text: Column, x0: Column, width: Column) -> Column:
    """Short, in capitals, indented, no slug line, no transition, no full stop at its end."""
    bare = F.regexp_replace(text, CUE_NOTE, "")
    return (
        (F.length(F.trim(text)) <= 45)
        & (F.upper(bare) == bare)
        & bare.rlike("[A-Z]")
        & (x0 >= width * 0.36)
        & ~F.upper(text).rlike(SLUG)
        & ~text.rlike(TRANSITION)
        & ~F.trim(bare).rlike("[.!?:]$")
    )


def broken_pages(lines: DataFrame) -> DataFrame:
    """Pages whose text layer is broken: no line at all, or at least 15 lines with over 45 % single characters or none of several words."""
    t = F.trim("text")
    many = F.count("*") >= 15
    bad = (F.count_if(t != "") == 0) | (many & ((F.avg((F.length(t) <= 1).cast("double")) > 0.45) | (F.count_if(t.rlike(r"\S\s+\S")) == 0)))
    return lines.groupBy("movie_key", "page").agg(bad.alias("broken")).where("broken").select("movie_key", "page")


BLOCKS = "movie_key string, scene_order int, scene_number string, slugline string, source_order int, block_type string, page int, text string, speaker string, parenthetical string"


def parse(lines: DataFrame) -> DataFrame:
    """Blocks of the screenplay of each film from layout lines (movie_key, page, width, text, x0, y0, source_block).

    A line's meaning depends on the lines before it (an open cue, an open parenthesis, the block
    that it may continue), so a film's lines - some ten thousand at most - are one group.
    """
    slug, transition, noise, note = re.compile(SLUG), re.compile(TRANSITION), re.compile(NOISE), re.compile(CUE_NOTE)

    def cue(text: str, x0: float, width: float) -> bool:
        bare = note.sub("", text).strip()
        return len(text) <= 45 and bare.upper() == bare and any(c.isalpha() for c in bare) and x0 >= 0.36 * width and not slug.match(text.upper()) and not transition.match(text) and bare[-1:] not in ".!?:"

    def film(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_y=rows["y0"].round(1)).sort_values(["page", "_y", "x0"], kind="stable")
        out: list[list] = []
        scene, number, head, order = 0, None, None, 0
        speaker = aside = None
        in_aside, last_block = False, None
        for r in rows.itertuples(index=False):
            text = " ".join(str(r.text or "").split())
            if not text or noise.match(text):
                continue
            m = slug.match(text.upper())
            if m and m[3]:
                scene, head, order = scene + 1, text, 0
                number = m[1] or (m[5] if m[5] and not re.fullmatch(r"(?:19|20)\d\d", m[5]) else None) or f"UNNUMBERED_{scene}"
                speaker = aside = last_block = None
                in_aside = False
                continue
            if not scene:
                continue
            if transition.match(text):
                speaker = aside = last_block = None
                continue
            if not in_aside and cue(text, r.x0, r.width):
                speaker, aside, last_block = note.sub("", text).strip(), None, None
                continue
            if speaker and (in_aside or text.startswith("(")):
                aside = f"{aside} {text}" if in_aside and aside else text
                in_aside = ")" not in text
                if not in_aside:
                    aside = aside.strip("() ")
                    if last_block is not None:  # within a speech it belongs to what was said before
                        last_block[9] = f"{last_block[9]}; {aside}" if last_block[9] else aside
                        aside = None
                continue
            if speaker and r.x0 < 0.22 * r.width:
                speaker = aside = last_block = None
            kind = "dialogue" if speaker else "action"
            if last_block is not None and last_block[5] == kind and (kind == "dialogue" or last_block[10] == r.source_block):
                last_block[7] += " " + text
                continue
            order += 1
            last_block = [r.movie_key, scene, number, head, order, kind, int(r.page), text, speaker, aside, r.source_block]
            aside = None
            out.append(last_block)
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        return pd.DataFrame([b[:10] for b in out], columns=names)

    cols = ["movie_key", "page", "width", "text", "x0", "y0", "source_block"]
    return lines.select(*cols).groupBy("movie_key").applyInPandas(film, BLOCKS)


def structure_audit(blocks: DataFrame) -> DataFrame:
    """For each film: blocks, dialogue that reads like action, fragments of one word, unbalanced parentheses."""
    n = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    action_like = (F.col("block_type") == "dialogue") & F.col("text").rlike(r"(?i)\b(?:walks|enters|exits|looks|turns|sits|stands|runs) (?:to|into|at|down|up|away|from|out)\b")
    return blocks.groupBy("movie_key").agg(
        F.count("*").alias("blocks"), F.count_if(action_like).alias("action_like"), F.count_if(~F.trim("text").rlike(r"\s")).alias("fragments"), F.count_if(n("(") != n(")")).alias("unbalanced")
    )
