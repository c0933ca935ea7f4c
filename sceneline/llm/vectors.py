"""What the vector searches share: packed blocks of vectors and the merge of partial results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id and x (array of double) of the rows whose vector has finite components only.

    Null ids and empty vectors go too; with ``zero`` False so do zero vectors.
    """
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND size(x) > 0")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return rows if zero else rows.where(F.exists("x", lambda v: v != 0.0))


def matrix(column: pd.Series, dim: int | None = None) -> np.ndarray:
    """The vectors of a column as rows."""
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, dim or 0))


def dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner product of each row of ``x`` with ``q``, summed component by component: equal rows get equal sums."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[d]
    return out


def best_of(partial: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each query, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
