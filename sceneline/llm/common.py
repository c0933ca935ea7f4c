"""What the corpus operators share: hold-out rule, scratch tables, checked broadcasts."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneline.sources.scratch import scratch_path, scratch_root

#: Rows up to which a table of ids may be broadcast (about 16 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for a fifth of the documents, by the CRC-32 of the id as text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a Parquet table to the shared folder and read it back (columns stay prunable)."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``small`` with a broadcast hint if it has no more than ``max_rows`` rows, else as it is.

    With ``weight``, a row counts as many times: for rows with arrays, their elements.
    ``small`` should already be materialised: it is counted here.
    """
    n = small.agg(F.coalesce(F.sum(weight if weight is not None else F.lit(1)), F.lit(0))).first()[0]
    return F.broadcast(small) if n <= max_rows else small


def trim() -> None:
    """Give memory that is free in this worker back to the system: workers are used again and would hold on to it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


class TextMap:
    """For ``mapInArrow``: passes a key column through and computes columns from the texts, a few rows at a time.

    What ``func`` keeps between texts it gives up in its method ``done``, if it has one, at the end of a task.
    """

    def __init__(self, func, fields: dict[str, str], step: int):
        self.func, self.fields, self.step = func, fields, step

    def __call__(self, batches):
        import pyarrow as pa

        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
        for batch in batches:
            for k in range(0, batch.num_rows, self.step):
                part = batch.slice(k, self.step)
                found = self.func(part.column(1).to_pylist())
                cols = [pa.array(v, type=types[t]) for v, t in zip(found, self.fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[part.schema.names[0], *self.fields])
        if hasattr(self.func, "done"):
            self.func.done()
        trim()


def map_texts(docs: DataFrame, func, fields: dict[str, str], key: str = "doc_id", text: str = "text", step: int = 256) -> DataFrame:
    """``key`` and ``fields`` of every row: ``func`` gets the texts of some rows and returns a list for each field."""
    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"{key} {kind}", *(f"{n} {t}" for n, t in fields.items())])
    return docs.select(key, text).mapInArrow(TextMap(func, fields, step), schema)


def finite_vectors(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id (null too), x (array of double) and the columns ``more`` of the rows whose vector has finite components only."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), *more).where("x IS NOT NULL")
    return rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


#: Rows of a key from which on its totals are broadcast: there are few such keys, and their rows must not meet in one task.
HOT_ROWS = 1_000_000


def attach_totals(rows: DataFrame, key: str, totals: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``totals`` (one row for each key, nulls together; ``n`` counts its rows).

    Few keys are broadcast.  Of many keys only the hot ones are (a table of N rows has at most N / HOT_ROWS
    of them), and the rows of all others are shuffled by key.
    """
    totals = materialize(totals, "totals").withColumnRenamed(key, "total_key")
    on = F.col(key).eqNullSafe(F.col("total_key"))
    if totals.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(totals), on).drop("total_key")
    hot, cold = totals.where(F.col("n") >= HOT_ROWS), totals.where(F.col("n") < HOT_ROWS)
    names = F.broadcast(hot.select("total_key"))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(names, on, "left_anti").join(cold, on)).drop("total_key")
