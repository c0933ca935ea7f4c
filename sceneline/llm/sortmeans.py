"""Centroid clustering by sort-means, in whole numbers.

Every round orders, for each centroid, the other centroids by their distance
from it.  A vector starts at the centroid it was assigned to before and meets
the others in that order; it stops at the first that lies strictly beyond twice
its distance from its own, since by the triangle inequality neither this one
nor any later one can be as near.  Equal distances go to the smaller number.

A round is one pass: each task assigns its rows and adds up its own vectors by
centroid, so only a row for each centroid and task is shuffled, and the driver
holds the centroids.  Each round's table is written, so a lost executor costs
its tasks of one round; the table of the round before is then removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneline.llm.common import finite_vectors
from sceneline.sources.scratch import discard, scratch_path

#: Components are scaled by this and rounded down.
SCALE = 1024
#: Scaled components may be so large at most: squares of differences then add up within 64 bits.
MOST = 1 << 27
#: Vectors compared with a centroid at once.
BLOCK = 8192

#: Part 0 has the rows, part 1 the sums: of a component ``d`` of a cluster, of its rows (COUNT) and of their distances (INERTIA).
SCHEMA = "vec_id long, x array<int>, cluster int, distance long, d int, total long, part int"
COUNT, INERTIA = -1, -2


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance of each row of ``x``; how many distances were computed."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    best, distance, computed = before.copy(), np.zeros(len(x), dtype=np.int64), 0
    for own in np.unique(before).tolist():
        at = np.flatnonzero(before == own)
        rows = x[at]
        start = squared(rows, centroids[own])
        near, number = start.copy(), np.full(len(at), own, dtype=np.int64)
        open_, computed = np.arange(len(at)), computed + len(at)
        for other in np.argsort(apart[own], kind="stable").tolist():
            if other == own:
                continue
            open_ = open_[apart[own, other] <= 4 * start[open_]]  # the order ascends: who stops here is done
            if not len(open_):
                break
            d = squared(rows[open_], centroids[other])
            computed += len(open_)
            better = (d < near[open_]) | ((d == near[open_]) & (other < number[open_]))
            near[open_[better]], number[open_[better]] = d[better], other
        best[at], distance[at] = number, near
    return best, distance, computed


class Assign:
    """For ``mapInArrow``: rows with cluster and distance, then the sums of each cluster met."""

    def __init__(self, centroids):
        self.centroids = centroids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = self.centroids.value
        k, dim = c.shape
        sums = np.zeros((k, dim + 2), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                packed = batch.column("x")
                x = packed.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                best, distance, _ = assign(x, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), c)
                order = np.argsort(best, kind="stable")
                met, first, size = np.unique(best[order], return_index=True, return_counts=True)
                if len(met):
                    sums[met] += np.concatenate((np.add.reduceat(x[order], first, axis=0), np.add.reduceat(distance[order], first)[:, None], size[:, None]), axis=1)
                yield self.part(0, vec_id=batch.column("vec_id"), x=packed, cluster=best, distance=distance)
        met = np.flatnonzero(sums[:, COUNT])
        if len(met):
            d = np.tile([*range(dim), INERTIA, COUNT], len(met))
            yield self.part(1, cluster=np.repeat(met, dim + 2), d=d, total=sums[met].ravel())

    def part(self, part: int, **columns) -> pa.RecordBatch:
        n = len(columns["cluster"])
        kinds = {"vec_id": pa.int64(), "x": pa.list_(pa.int32()), "cluster": pa.int32(), "distance": pa.int64(), "d": pa.int32(), "total": pa.int64(), "part": pa.int32()}
        columns["part"] = np.full(n, part)
        column = lambda v, t: pa.nulls(n, t) if v is None else v if isinstance(v, pa.Array) else pa.array(v, type=t)
        return pa.RecordBatch.from_arrays([column(columns.get(name), t) for name, t in kinds.items()], names=list(kinds))


def start_order() -> list[Column]:
    """Initial centroids are the first by the SHA-256 of the id; a null id comes last, equal ids go by their vectors."""
    return [F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), F.col("x").asc()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = SCALE) -> tuple[DataFrame, list[list[int]], dict[int, int]]:
    """Rows (vec_id, x, cluster, distance) of the kept vectors, the final centroids, and the summed distance of each cluster."""
    spark = vectors.sparkSession
    rows = finite_vectors(vectors).where(F.size("x") == dim)
    rows = rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("x"))
    rows = rows.select("vec_id", F.when(F.exists("x", lambda v: F.abs(v) > MOST), F.raise_error(F.lit("a component is too large to be clustered exactly"))).otherwise(F.col("x").cast("array<int>")).alias("x"))
    centroids = [list(r["x"]) for r in rows.orderBy(*start_order()).limit(k).collect()]  # k rows
    table, place, sums = rows.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), None, {}
    for turn in range(rounds + 1 if centroids else 0):
        shared, path = spark.sparkContext.broadcast(np.array(centroids, dtype=np.int64)), scratch_path(spark, f"sort-means-{turn}")
        table.select("vec_id", "x", "cluster").mapInArrow(Assign(shared), SCHEMA).write.partitionBy("part").parquet(path)
        if place:
            discard(spark, place)
        shared.unpersist()
        place, written = path, spark.read.schema(SCHEMA).parquet(path)
        table = written.where("part = 0")
        sums = {}
        for r in written.where("part = 1").groupBy("cluster", "d").agg(F.sum("total").alias("total")).collect():  # k times dim rows
            sums.setdefault(r["cluster"], {})[r["d"]] = r["total"]
        if turn < rounds:
            centroids = [[sums[c][d] // sums[c][COUNT] for d in range(dim)] if c in sums else old for c, old in enumerate(centroids)]
    return table.select("vec_id", "x", "cluster", "distance"), centroids, {c: own[INERTIA] for c, own in sums.items()}


def cluster_table(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Vectors that are null, have another number of components than ``dim``, or hold a null or
    non-finite component take no part; with fewer than ``k`` vectors there are as many centroids.
    A null id takes part (as an initial centroid only after all others); rows with equal ids are
    vectors each on their own.  Equal distances go to the smaller number, also between equal
    centroids.  An empty table gives an empty result; other columns are ignored.  A component
    whose scaled value is beyond 2^27 raises an error, as distances would not fit.
    """
    rows, centroids, inertia = cluster(vectors, k, rounds, dim)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    totals = [(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()]
    per_cluster = vectors.sparkSession.createDataFrame(totals, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("x").join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
