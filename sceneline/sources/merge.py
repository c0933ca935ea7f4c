"""A table that is changed by copies: upserts and deletes rewrite only the partitions that they hit.

``path/data/v<n>/part=<p>`` holds what version n wrote of partition p, and
``path/manifests/<n>`` tells for each partition which version is current, its
rows and a digest of them.  A change writes the partitions it hits as a new
version and then the manifest, whose appearance is the commit: readers see the
old table or the new one, and a writer that fails leaves the old one.  A change
states the version it was made for; it is refused if a partition that it hits
has changed since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part int, version int, rows long, digest string"


class ChangedBase(RuntimeError):
    """The partitions that a change hits are no longer those it was made for."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{n}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and done(n))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[int, tuple[int, int, str]]:
    """(version, rows, digest) of each partition; of the newest version by default."""
    known = versions(spark, path)
    version = version if version is not None else known[-1]
    if version not in known:
        raise ValueError(f"{path} has no version {version}")
    return {r["part"]: (r["version"], r["rows"], r["digest"]) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{version}").collect()}  # a row for each partition


def read(spark: SparkSession, path: str, schema: str, version: int | None = None, parts: set[int] | None = None) -> DataFrame:
    """The rows of a version with their ``part`` and the ``version`` that wrote them; with ``parts``, of these partitions only."""
    wanted: dict[int, list[int]] = {}
    for p, (v, _, _) in manifest(spark, path, version).items():
        if parts is None or p in parts:
            wanted.setdefault(v, []).append(p)
    found = spark.createDataFrame([], f"{schema}, part int, version int")
    for v, own in sorted(wanted.items()):
        folders = [f"{path}/data/v{v}/part={p}" for p in own]
        rows = spark.read.schema(f"{schema}, part int").option("basePath", f"{path}/data/v{v}").parquet(*folders)
        found = found.unionByName(rows.withColumn("version", F.lit(v)))
    return found


def digests(rows: DataFrame, columns: list[str]) -> dict[int, tuple[int, str]]:
    """Rows and digest of each partition, whatever the order of its rows: sum and exclusive-or of two hashes of each row."""
    h = lambda seed: F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    found = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(h(1).cast("decimal(38,0)")).alias("sum"), F.bit_xor(h(2)).alias("xor"))
    return {r["part"]: (r["n"], f"{int(r['sum']) % (1 << 64):016x}{r['xor'] % (1 << 64):016x}") for r in found.collect()}  # a row for each partition


def _commit(spark: SparkSession, path: str, version: int, table: dict[int, tuple[int, int, str]]) -> None:
    rows = [(p, *t) for p, t in sorted(table.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifests/{version}")  # fails if another writer was first


def _place(part: Column | str) -> Column:
    return (F.expr(part) if isinstance(part, str) else part).cast("int")


def create(rows: DataFrame, path: str, part: Column | str) -> int:
    """Version 1 of a new table, cut into partitions by ``part`` (a whole number that follows from the key, as a column or SQL)."""
    spark = rows.sparkSession
    if versions(spark, path):
        raise FileExistsError(f"{path} is a table already")
    cut = rows.withColumn("part", _place(part))
    cut.repartition("part").write.partitionBy("part").parquet(f"{path}/data/v1")
    written = spark.read.schema(cut.schema).parquet(f"{path}/data/v1")
    _commit(spark, path, 1, {p: (1, *d) for p, d in digests(written, rows.columns).items()})
    return 1


def merge(changes: DataFrame, path: str, key: list[str], part: Column | str, base: int) -> int:
    """Applies ``changes`` (the table's columns and ``op``, upsert or delete; one row for each key) made for version ``base``; the new version.

    An upsert replaces the row of its key or adds one, a delete of an unknown key does nothing, and columns
    keep their names.  Partitions without a change are neither read nor written.  A key that is
    changed twice, or an op of another name, is an error; no change at all makes no version.
    """
    spark = changes.sparkSession
    columns = [c for c in changes.columns if c != "op"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.select(*columns).schema)
    change = changes.withColumn("part", _place(part))
    wrong = change.groupBy(*key).agg(F.count("*").alias("n"), F.max(~F.coalesce(F.col("op").isin("upsert", "delete"), F.lit(False))).alias("odd")).where("n > 1 OR odd").limit(1).collect()
    if wrong:
        raise ValueError(f"more than one change, or an unknown one, of {wrong[0].asDict()}")
    hit = {r["part"] for r in change.select("part").distinct().collect()}  # partitions
    if not hit:
        return base
    known = versions(spark, path)
    now, then = manifest(spark, path), manifest(spark, path, base)
    if changed := sorted(p for p in hit if now.get(p) != then.get(p)):
        raise ChangedBase(f"partitions {changed} of {path} have changed since version {base}")
    old = read(spark, path, schema, parts=hit)
    stored = digests(old, columns)
    if broken := sorted(p for p in hit & set(now) if now[p][1:] != stored.get(p)):
        raise ChangedBase(f"partitions {broken} of {path} do not hold what its manifest says")
    version = known[-1] + 1
    left = old.drop("version").join(change.select("part", *key), ["part", *key], "left_anti").select("part", *columns)
    fresh = left.unionByName(change.where("op = 'upsert'").select("part", *columns))
    place = f"{path}/data/v{version}"
    fresh.repartition("part").write.mode("overwrite").partitionBy("part").parquet(place)  # what a failed writer left goes
    written = digests(spark.read.schema(f"{schema}, part int").parquet(place), columns)
    table = {p: t for p, t in now.items() if p not in hit} | {p: (version, *d) for p, d in written.items()}
    _commit(spark, path, version, table)
    return version
