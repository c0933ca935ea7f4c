"""Runs of several stages over films that resume: a stage is computed only for the films whose inputs or options have changed.

``root/<stage>/run=<n>/rows`` holds what run n computed, and ``.../films`` the
films it was computed for, with the fingerprint of what went in and a digest
of what came out.  The table of films is written last: its appearance is the
commit of the stage, so a run that fails leaves what was there before, and the
next one goes on from it.  All of this is tables: neither films nor their
digests pass through the driver.

A fingerprint is made of the stage's name and options and the digests of its
inputs, film by film.  The digest of an earlier stage's rows is an input like
any other: a film whose rows come out as before is not computed again further
on.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """``run`` gets its inputs by name (sources or earlier stages, those of some films only) and returns rows of these films.

    Films are those of the first input.  Whatever changes the rows belongs into ``options``, the
    version of the rules too.
    """

    name: str
    inputs: tuple[str, ...]
    run: Callable[..., DataFrame]
    options: dict = field(default_factory=dict)


def film_digests(rows: DataFrame, key: str) -> DataFrame:
    """``key``, rows and digest of each film, whatever the order of its rows; repeated rows count.  A null film takes no part.

    The digest is made of the number of rows and the sum and exclusive-or of two 64-bit hashes of each.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    hashed = rows.where(F.col(key).isNotNull()).select(key, F.xxhash64(F.lit(1), text).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(2), text).alias("b"))
    found = hashed.groupBy(key).agg(F.count("*").alias("rows"), F.sum("a").cast("string").alias("a"), F.bit_xor("b").cast("string").alias("b"))
    return found.select(key, "rows", F.sha2(F.concat_ws(" ", F.col("rows").cast("string"), "a", "b"), 256).alias("digest"))


def fingerprints(stage: Stage, digests: dict[str, DataFrame], key: str) -> DataFrame:
    """``key`` and the fingerprint of each film for a stage, from the digests of its inputs."""
    first = digests[stage.inputs[0]].select(key)
    parts = [digests[name].select(key, F.struct(F.lit(name).alias("name"), "digest").alias("part")) for name in stage.inputs]
    own = reduce(DataFrame.unionByName, parts).join(first, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts"))  # a part for each input
    fixed = json.dumps([stage.name, stage.options], sort_keys=True, allow_nan=False)
    return own.select(key, F.sha2(F.concat(F.lit(fixed), F.to_json("parts")), 256).alias("fingerprint"))


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, fs = _folder(spark, path)
    return fs.exists(place)


def _runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs of a stage, committed or not."""
    place, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n[4:]) for n in names if n.startswith("run=") and n[4:].isdigit())


def _committed(spark: SparkSession, path: str) -> list[int]:
    return [n for n in _runs(spark, path) if _exists(spark, f"{path}/run={n}/films/_SUCCESS")]


def films(spark: SparkSession, root: str, stage: str, key: str = "movie_key") -> DataFrame | None:
    """The films a stage holds: ``key``, run (that computed it), fingerprint, rows, digest.  None before the first run."""
    path = f"{root}/{stage}"
    runs = _committed(spark, path)
    if not runs:
        return None
    every = spark.read.parquet(*[f"{path}/run={n}/films" for n in runs])
    newest = every.groupBy(key).agg(F.max_by(F.struct("run", "fingerprint", "rows", "digest"), "run").alias("s")).select(key, "s.*")
    return newest.where("fingerprint IS NOT NULL")


def rows(spark: SparkSession, root: str, stage: str, key: str = "movie_key") -> DataFrame:
    """The rows of a stage, of each film from the run that computed it last."""
    path, held = f"{root}/{stage}", films(spark, root, stage, key)
    if held is None:
        raise FileNotFoundError(f"{path} has no finished run")
    there = [n for n in _committed(spark, path) if _exists(spark, f"{path}/run={n}/rows")]
    parts = [spark.read.parquet(f"{path}/run={n}/rows").withColumn("_run", F.lit(n)) for n in there]
    if not parts:
        raise FileNotFoundError(f"{path} has lost its rows")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.join(held.select(key, F.col("run").alias("_run")), [key, "_run"], "left_semi").drop("_run")


def _sound(spark: SparkSession, root: str, stage: str, key: str) -> DataFrame | None:
    """The films of a stage whose rows are still those that were recorded."""
    held = films(spark, root, stage, key)
    if held is None:
        return None
    try:
        stored = film_digests(rows(spark, root, stage, key), key)
    except FileNotFoundError:
        return held.limit(0)
    stored = stored.select(key, F.col("digest").alias("_now"))
    return held.join(stored, key, "left").where(F.col("digest").eqNullSafe(F.col("_now"))).drop("_now")


def resume(spark: SparkSession, root: str, sources: dict[str, DataFrame], stages: list[Stage], key: str = "movie_key") -> int:
    """Brings all ``stages`` below ``root`` up to date with ``sources`` (each with the column ``key``); the number of this run.

    A film is computed in a stage if it is new, if its fingerprint has changed, or if its stored
    rows are not the ones that were recorded.  A film that its input holds no more is taken out.  A
    stage that has nothing to do writes nothing.  An empty source gives empty tables; rows without
    a film take no part; a stage that returns rows of other films than it was asked for fails.
    """
    run = 1 + max([n for s in stages for n in _runs(spark, f"{root}/{s.name}")], default=0)
    digests = {name: film_digests(table, key).select(key, "digest") for name, table in sources.items()}
    tables = dict(sources)
    for stage in stages:
        path = f"{root}/{stage.name}"
        place = f"{path}/run={run}"
        wanted = fingerprints(stage, digests, key)
        held, sound = films(spark, root, stage.name, key), _sound(spark, root, stage.name, key)
        todo = wanted if sound is None else wanted.join(sound, [key, "fingerprint"], "left_anti")
        gone = None if held is None else held.join(wanted, key, "left_anti").select(key)
        spark_todo = todo.withColumn("gone", F.lit(False))
        if gone is not None:
            spark_todo = spark_todo.unionByName(gone.select(key, F.lit(None).cast("string").alias("fingerprint"), F.lit(True).alias("gone")))
        spark_todo.write.parquet(f"{place}/asked")  # fails if another run is under way
        asked = spark.read.schema(spark_todo.schema).parquet(f"{place}/asked")
        counts = asked.agg(F.count_if(~F.col("gone")).alias("films"), F.count("*").alias("all")).first()
        if counts["films"] or held is None:
            own = asked.where("NOT gone").select(key)
            found = stage.run(**{name: tables[name].join(own, key, "left_semi") for name in stage.inputs})
            found.write.parquet(f"{place}/rows")
            written = film_digests(spark.read.schema(found.schema).parquet(f"{place}/rows"), key)
        else:
            written = spark.createDataFrame([], f"`{key}` {asked.schema[key].dataType.simpleString()}, rows long, digest string")
        if counts["all"] or held is None:
            both = asked.join(written, key, "full_outer")
            alien = F.when(F.col("gone").isNull(), F.raise_error(F.concat(F.lit(f"{stage.name}: not asked for "), F.col(key).cast("string"))).cast("int")).otherwise(F.lit(run))
            both.select(key, alien.alias("run"), "fingerprint", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "digest").write.parquet(f"{place}/films")
        tables[stage.name] = rows(spark, root, stage.name, key)
        digests[stage.name] = films(spark, root, stage.name, key).select(key, "digest")
    return run
