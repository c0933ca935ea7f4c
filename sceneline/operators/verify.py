"""Similarity to a gallery of vectors, its calibration and decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def normalized(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with x, the vector in double precision and of length 1; null for a zero vector."""
    v = F.transform(F.col(vector), lambda e: e.cast("double"))
    out = rows.withColumn("x", v).withColumn("_n", F.sqrt(dot(F.col("x"), F.col("x"))))
    return out.withColumn("x", F.when(F.col("_n") > 0, F.transform("x", lambda e: e / F.col("_n")))).drop("_n", vector)


#: Gallery vectors of a block, queries that meet a block in one partition key, and queries of one product, about.
GALLERY_BLOCK, QUERY_BLOCK, PRODUCT = 4096, 20_000, 512


class BlockProduct:
    """For ``mapInArrow`` over rows sorted by block, key, length and side (0 the gallery, 1 the queries): the ``k`` best of each block.

    A block of the gallery is held as a matrix; queries stream past it, some hundred to a product.
    """

    def __init__(self, k: int, keep: list[str]):
        self.k, self.keep = k, keep

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, held, gallery = None, [], [], None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "key", "length", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                own, side, rows = tuple(group[start, :3]), group[start, 3], batch.slice(start, stop - start)
                if own != name:
                    name, ids, held, gallery = own, [], [], None
                x = rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                if side == 0:
                    ids.append(rows.column("id").to_numpy(zero_copy_only=False))
                    held.append(x)
                elif held:
                    if gallery is None:
                        known = np.concatenate(ids)
                        order = np.argsort(known, kind="stable")
                        known, gallery = known[order], np.concatenate(held)[order]
                    for at in range(0, len(rows), PRODUCT):
                        yield self.best(rows.slice(at, PRODUCT), x[at : at + PRODUCT], known, gallery)

    def best(self, rows: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, gallery: np.ndarray) -> pa.RecordBatch:
        cosine = x @ gallery.T
        o = -np.round(cosine, 9)
        o[~np.isfinite(o) | (rows.column("id").to_numpy(zero_copy_only=False)[:, None] == ids[None, :])] = np.inf
        k = min(self.k, len(ids))
        row, col = np.nonzero((o <= np.partition(o, k - 1, axis=1)[:, k - 1 : k]) & np.isfinite(o))
        order = np.lexsort((col, o[row, col], row))  # columns are in the order of the ids
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        taken = rows.take(pa.array(row))
        columns = [taken.column("id"), *[taken.column(c) for c in self.keep], pa.array(o[row, col]), pa.array(ids[col]), pa.array(cosine[row, col])]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", *self.keep, "o", "found", "cosine"])


def _against(queries: DataFrame, gallery: DataFrame, vec_id: str, keep: list[str], k: int) -> DataFrame:
    """query_id, ``keep``, o (minus the rounded cosine), found, cosine: of each query and each block of the gallery the ``k`` best.

    The gallery is dealt by a hash into bounded blocks, the queries into as many keys as they
    need; both are shuffled by (block, key), so neither side is gathered or broadcast whole, and only
    the best of a block goes on.  Vectors that are null, of another length or with components that
    are not finite are not found and find nothing.  Ids are whole numbers.
    """
    blocks = max(1, -(-gallery.count() // GALLERY_BLOCK))
    keys = max(1, -(-queries.count() // QUERY_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *seed: F.pmod(F.xxhash64(F.col(vec_id), *map(F.lit, seed)), F.lit(n)).cast("int")
    types = {f.name: f.dataType for f in queries.schema}
    none = [F.lit(None).cast(types[c]).alias(c) for c in keep]
    g = gallery.select(dealt(blocks).alias("block"), each(keys).alias("key"), F.lit(0).alias("side"), F.col(vec_id).cast("long").alias("id"), "x", *none)
    q = queries.select(each(blocks).alias("block"), dealt(keys, 1).alias("key"), F.lit(1).alias("side"), F.col(vec_id).cast("long").alias("id"), "x", *keep)
    both = g.unionByName(q).where("x IS NOT NULL AND size(x) > 0 AND NOT exists(x, e -> e IS NULL)").withColumn("length", F.size("x"))
    both = both.repartition("block", "key", "length").sortWithinPartitions("block", "key", "length", "side")
    schema = T.StructType([T.StructField("query_id", T.LongType()), *[T.StructField(c, types[c]) for c in keep], T.StructField("o", T.DoubleType()), T.StructField("found", T.LongType()), T.StructField("cosine", T.DoubleType())])
    return both.mapInArrow(BlockProduct(k, keep), schema)


def gallery_top_k(queries: DataFrame, gallery: DataFrame, vec_id: str, k: int) -> DataFrame:
    """query_id, rank, id and cosine of the ``k`` most similar gallery vectors but the query itself (cosines equal to 9 digits: the smaller id)."""
    w = Window.partitionBy("query_id").orderBy("o", "found")
    found = _against(queries, gallery, vec_id, [], k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("found").alias(vec_id), "cosine", "rank")


def best_similarity(queries: DataFrame, gallery: DataFrame, vec_id: str, keep: list[str]) -> DataFrame:
    """Each query with its largest similarity to the gallery, but to itself; queries that find nothing are left out."""
    return _against(queries, gallery, vec_id, keep, 1).groupBy("query_id", *keep).agg(F.max("cosine").alias("similarity"))


def calibrate(positives: DataFrame, negatives: DataFrame, vec_id: str) -> DataFrame:
    """One row: threshold (least leave-one-out similarity of the positives), least margin over the negatives, size."""
    own = best_similarity(positives, positives, vec_id, [])
    other = best_similarity(positives, negatives, vec_id, []).withColumnRenamed("similarity", "negative")
    return own.join(other, "query_id", "left").agg(F.min("similarity").alias("threshold"), F.min(F.col("similarity") - F.col("negative")).alias("least_margin"), F.count("*").alias("gallery"))


def decide(best: DataFrame, key: str, threshold: float, near: float) -> DataFrame:
    """Two samples above the threshold verify; one, or one near it, or fewer than two samples leave it open."""
    up = F.count_if(F.col("similarity") >= threshold)
    close = F.count_if(F.abs(F.col("similarity") - threshold) <= near)
    decision = F.when(up >= 2, "verified").when((up == 1) | (close > 0) | (F.count("*") < 2), "uncertain").otherwise("not_verified")
    return best.groupBy(key).agg(decision.alias("decision"), F.count("*").alias("usable"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    at = lambda c, i: F.element_at(c, i)
    w = F.greatest(F.lit(0.0), F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)))
    h = F.greatest(F.lit(0.0), F.least(at(a, 4), at(b, 4)) - F.greatest(at(a, 2), at(b, 2)))
    area = lambda c: (at(c, 3) - at(c, 1)) * (at(c, 4) - at(c, 2))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def best_box(left: DataFrame, right: DataFrame, keys: list[str], left_box: str, right_box: str, right_id: str, least: float = 0.10) -> DataFrame:
    """``left`` with the id of the box of ``right`` of the same keys with the largest overlap, if that is at least ``least``."""
    pairs = left.join(right.select(*keys, F.col(right_box).alias("_b"), F.col(right_id).alias("_id")), keys)
    pairs = pairs.withColumn("iou", iou(F.col(left_box), F.col("_b"))).where(F.col("iou") >= least)
    names = [F.col(c) for c in left.columns]
    return pairs.groupBy(*names).agg(F.max_by("_id", F.struct("iou", -F.col("_id"))).alias(right_id), F.max("iou").alias("iou"))
