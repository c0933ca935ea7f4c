"""Folder preflight and reports over media files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneline.functions import media as md


def primary_video(files: DataFrame, folder: str = "folder", minutes: str = "minutes", name: str = "name") -> DataFrame:
    """A row for each folder: primary file and confidence.

    Files of at least ``FULL_MIN`` minutes are full; the longest is primary unless the second
    is ``AMBIGUOUS_SHARE`` of it or more.
    """
    full = files.where(F.col(minutes) >= md.FULL_MIN)
    w = Window.partitionBy(folder).orderBy(F.desc(minutes), name)
    ranked = full.withColumns({"k": F.row_number().over(w), "second": F.lead(minutes).over(w)}).where("k = 1")
    clash = F.coalesce(F.col("second") >= md.AMBIGUOUS_SHARE * F.col(minutes), F.lit(False))
    found = ranked.select(folder, F.when(~clash, F.col(name)).alias("primary"), F.when(clash, "ambiguous").otherwise("high").alias("confidence"))
    return files.select(folder).distinct().join(found, folder, "left").withColumn("confidence", F.coalesce("confidence", F.lit("none")))


def upsert_latest(index: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """``index`` with the rows of ``changes`` put in by key; of several the largest version wins, a change over the index."""
    both = index.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def count_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """For each key a sorted ``value=count`` list."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws("=", value, F.col("n").cast("string")))).alias("counts"))


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``paths`` (path) rewritten by the longest of ``prefixes`` (source, target) that ends at a folder border; as it is if none does.

    An equality join on the folder prefixes of a path, not a prefix scan.  A path that is not
    absolute, or leaves its folder by "..", and a source that is given twice are errors.
    """
    wrong = ~F.col("path").startswith("/") | F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)")
    paths = paths.withColumn("path", F.when(wrong, F.raise_error(F.concat(F.lit("path outside its folder: "), "path"))).otherwise(F.col("path")))
    twice = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("source given twice: "), "source"))).otherwise(F.first("target"))
    prefixes = prefixes.groupBy("source").agg(twice.alias("target"))
    parts = F.split("path", "/")
    heads = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("source"))
    best = heads.join(prefixes, "source").groupBy("path").agg(F.max_by("target", F.length("source")).alias("target"), F.max(F.length("source")).alias("n"))
    rewritten = F.concat("target", F.expr("substring(path, n + 1)"))
    return paths.join(best, "path", "left").select("path", F.coalesce(rewritten, "path").alias("resolved"))
