"""Classification of media files as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed limits of the media profile.
SIZE_LIMIT_GIB, MAX_WIDTH, MAX_HEIGHT, MAX_DEPTH, MAX_FPS, TARGET_FPS = 4.5, 1920, 1080, 8, 30.0, 24.0
CODECS = ("h264", "hevc")
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
DEPTHS = (16, 14, 12, 10, 9, 8)
FULL_MIN, SHORT_MIN, AMBIGUOUS_SHARE = 40, 20, 0.9


def frame_rate(fraction: Column) -> Column:
    """``24000/1001`` or a bare number as a double; 0 where there is none."""
    parts = F.split(fraction, "/")
    top = F.try_element_at(parts, F.lit(1)).try_cast("double")
    low = F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
    return F.coalesce(F.try_divide(top, low), F.lit(0.0))


def bit_depth(raw: Column, pixel_format: Column) -> Column:
    """Bits said by the stream, else the first known depth named in the pixel format, else 8."""
    named = F.coalesce(*[F.when(F.contains(pixel_format, F.lit(str(d))), F.lit(d)) for d in DEPTHS], F.lit(8))
    return F.coalesce(F.when(raw.rlike("^[0-9]+$"), raw.cast("int")), named)


def is_hdr(transfer: Column, side_data: Column) -> Column:
    """An HDR transfer, or Dolby side data; any other named transfer is SDR; else mastering or light-level side data."""
    has = lambda word: F.exists(side_data, lambda s: F.contains(F.lower(s), F.lit(word)))
    known = F.coalesce(transfer, F.lit("")) != ""
    return F.when(transfer.isin(*HDR_TRANSFERS), True).when(has("dovi"), True).when(known & (transfer != "unknown"), False).otherwise(F.coalesce(has("mastering") | has("content light"), F.lit(False)))


def profile_reasons(hdr: Column, size_gib: Column, width: Column, height: Column, depth: Column, codec: Column, fps: Column | None = None) -> Column:
    """What keeps a file out of the profile, in a fixed order; with ``fps`` also too high a frame rate."""
    rules = [
        F.when(hdr, "hdr"),
        F.when(size_gib > SIZE_LIMIT_GIB, "oversize"),
        F.when((width > MAX_WIDTH) | (height > MAX_HEIGHT), "resolution"),
        F.when(depth > MAX_DEPTH, "bit_depth"),
        F.when(~codec.isin(*CODECS), "codec"),
    ]
    if fps is not None:
        rules.append(F.when(fps > MAX_FPS, "frame_rate"))
    return F.array_compact(F.array(*rules))


def inventory_class(reasons: Column) -> Column:
    return F.when(F.array_contains(reasons, "hdr"), "HDR_TONEMAP").when(F.array_contains(reasons, "oversize"), "OVERSIZE").when(F.size(reasons) > 0, "TRANSCODE").otherwise("PASS")


def transcode_class(reasons: Column) -> Column:
    return F.when(F.size(reasons) == 0, "KEEP").otherwise(inventory_class(reasons))


def target_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Scaled into the profile, rounded down to even numbers, at least 2."""
    f = F.least(F.lit(1.0), MAX_WIDTH / width, MAX_HEIGHT / height)
    even = lambda v: F.greatest(F.lit(2), (F.floor(v * f + 1e-9) / 2).cast("long") * 2)
    return even(width), even(height)


def target_fps(fps: Column) -> Column:
    return F.when(fps > MAX_FPS, F.lit(TARGET_FPS)).otherwise(fps)


def bitrate(stream_rate: Column, size_bytes: Column, duration: Column) -> Column:
    """(rate, source): the stream's own, else from size and duration."""
    own = stream_rate > 0
    derived = F.try_divide(size_bytes * 8, duration)
    return F.struct(F.when(own, stream_rate.cast("double")).otherwise(derived).alias("rate"), F.when(own, "stream").when(derived.isNotNull(), "derived").alias("source"))


def language_code(tag: Column) -> Column:
    low = F.lower(F.trim(tag))
    return F.when(low.isin("en", "eng", "english"), "en").when(F.coalesce(low, F.lit("")) == "", "und").otherwise(low)


def subtitle_language(name: Column, streams: Column) -> Column:
    """en if the file's name says so, else the first language that its streams (array of tags) tell, else und."""
    named = name.rlike(r"(?i)(?:^|[._ -])(?:en|eng|english)(?:[._ -]|$)")
    told = F.try_element_at(F.filter(F.transform(streams, language_code), lambda t: t != "und"), F.lit(1))
    return F.when(named, "en").otherwise(F.coalesce(told, F.lit("und")))


def pick_audio(streams: Column) -> Column:
    """First English stream, else the default one, else the first; streams are structs of (index, language, is_default)."""
    ranked = F.transform(streams, lambda s, i: F.struct(F.when(language_code(s["language"]) == "en", 0).when(s["is_default"], 1).otherwise(2).alias("r"), i.alias("i"), s.alias("s")))
    return F.try_element_at(F.array_sort(ranked), F.lit(1))["s"]


#: Extensions of each category of files.
CATEGORIES = {
    "IMAGE_ASSET": ("jpg", "jpeg", "png", "webp", "gif"),
    "RELEASE_METADATA": ("nfo", "txt", "url", "sfv", "md5", "sha1", "torrent"),
    "ARCHIVE": ("zip", "rar", "7z"),
    "EXECUTABLE_OR_SCRIPT": ("exe", "bat", "cmd", "scr"),
}


def file_category(name: Column) -> Column:
    """By the extension; a name that only begins with a dot has none."""
    ext = F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(v) for c, e in CATEGORIES.items() for x in e for v in (x, c)])
    return F.coalesce(F.try_element_at(known, ext), F.lit("UNKNOWN"))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def movie_key(path: Column) -> Column:
    """Of a path below the input folder: title id of the file name, else of the nearest folder, else the normalised path, else a digest.

    Normalised: without the extension, NFKC and lower case, all but letters a-z, digits and slashes
    as one underscore, trimmed by folder, folders joined by two underscores.
    """
    parts = F.split(path, "/")
    ids = F.transform(F.reverse(parts), lambda p: F.lower(F.regexp_extract(p, r"(?i)(?<![A-Za-z0-9])(tt[0-9]{7,10})(?![0-9])", 1)))
    found = F.try_element_at(F.filter(ids, lambda i: i != ""), F.lit(1))
    plain = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    plain = F.when(plain.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(_nfkc(plain))
    words = F.transform(F.split(F.regexp_replace(F.lower(plain), "[^a-z0-9/]+", "_"), "/"), lambda p: F.trim(p, F.lit("_")))
    key = F.array_join(F.filter(words, lambda p: p != ""), "__")
    return F.coalesce(found, F.when(key != "", key), F.concat(F.lit("movie_"), F.substring(F.sha2(path, 256), 1, 12)))


def title_of(path: Column) -> Column:
    """Title from a file name: without id and extension, words parted where capitals begin."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    plain = F.regexp_replace(stem, r"(?i)^tt[0-9]{7,8}(?:[_. -]+)?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "(?<=[a-z])(?=[A-Z])", " "), "[_.]+", " "))


def identity(relpath: Column) -> list[Column]:
    """movie_id and folder_title: the first title id in the path below the input folder, else the name of the folder."""
    folder = F.element_at(F.split(relpath, "/"), -2)
    found = F.lower(F.regexp_extract(relpath, r"(?i)(?:^|[^a-z0-9])(tt[0-9]{7,10})(?:[_ .-]|/|$)", 1))
    return [F.when(found != "", found).otherwise(folder).alias("movie_id"), folder.alias("folder_title")]


def standardized(path: Column) -> Column:
    """Where the standardized file of a source goes: beside it."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("_standardized.mp4"))


def canonical_name(key: Column, width: Column, height: Column, fps: Column, codec: Column, depth: Column, hdr: Column, ext: Column) -> Column:
    """``key.1920x1080.23.976fps.h264.8bit.sdr.mkv``; trailing zeros of the rate are cut."""
    rate = F.regexp_replace(F.format_string("%.3f", fps), r"\.?0+$", "")
    return F.format_string("%s.%dx%d.%sfps.%s.%dbit.%s%s", key, width, height, rate, codec, depth, F.when(hdr, "hdr").otherwise("sdr"), ext)


def scale_filter(width: Column, height: Column, hdr: Column) -> Column:
    """Filter string of a transcode plan (never run here)."""
    size = F.format_string("scale=%d:%d", width, height)
    return F.when(hdr, F.concat(F.lit("zscale=t=linear,tonemap=hable,zscale=t=bt709,"), size)).otherwise(size)


def output_violations(out_duration: Column, in_duration: Column, out_fps: Column, want_fps: Column, width: Column, height: Column, depth: Column, codec: Column, size: Column) -> Column:
    """What is wrong with a transcoded file."""
    return F.array_compact(
        F.array(
            F.when(size <= 0, "empty"),
            F.when(codec != "h264", "codec"),
            F.when(width > MAX_WIDTH, "width"),
            F.when(height > MAX_HEIGHT, "height"),
            F.when((width % 2 != 0) | (height % 2 != 0), "odd_size"),
            F.when(depth > MAX_DEPTH, "bit_depth"),
            F.when(F.abs(out_duration - in_duration) > 0.5, "duration"),
            F.when(F.abs(out_fps - want_fps) > F.greatest(F.lit(0.01), want_fps * 0.001), "frame_rate"),
        )
    )
