"""Writers: write-once tables, CSV export, JSON with a guard against NaN, digests of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(rows: DataFrame) -> DataFrame:
    """``rows``; a NaN or infinite number in a top-level column fails the query."""
    out = {}
    for f in rows.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf"))
            out[f.name] = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{f.name}: no finite number")).cast(f.dataType)).otherwise(F.col(f.name))
    return rows.withColumns(out) if out else rows


def write_once_json(rows: DataFrame, path: str) -> None:
    """JSON lines at a path where nothing may be yet."""
    finite(rows).write.mode("errorifexists").json(path)


def write_once_parquet(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def flat(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The declared columns as strings for CSV: nulls empty, nested values as compact JSON."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def one(c: str) -> Column:
        text = F.to_json(c) if isinstance(kinds[c], (T.StructType, T.ArrayType, T.MapType)) else F.col(c).cast("string")
        return F.coalesce(text, F.lit("")).alias(c)

    return rows.select(*[one(c) for c in columns or rows.columns])


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    flat(rows, columns).write.mode("errorifexists").option("header", "true").option("emptyValue", "").csv(path)


def write_report(rows: DataFrame, path: str, status: str, error: str) -> None:
    """Rows as CSV and JSON, the rows with an error, and counts by status."""
    write_csv(rows, f"{path}/rows_csv")
    write_once_json(rows, f"{path}/rows_json")
    write_once_json(rows.where(F.col(error).isNotNull()), f"{path}/errors_json")
    write_once_json(rows.groupBy(status).agg(F.count("*").alias("n")), f"{path}/summary_json")


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys are not at ``path`` yet."""
    spark = rows.sparkSession
    try:
        known = spark.read.parquet(path).select(*keys)
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    (rows.join(known, keys, "left_anti") if known is not None else rows).dropDuplicates(keys).write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of each file: what a release records and checks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_problems(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, unknown or changed."""
    f = found.select("path", F.col("sha256").alias("_now"))
    both = recorded.select("path", "sha256").join(f, "path", "full_outer")
    problem = F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("_now") != F.col("sha256"), "changed")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def fingerprint(*cols: str | Column) -> Column:
    """Digest of values, the same for the same options and inputs."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def markdown(rows: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """One text for each key: its lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias("text"))
