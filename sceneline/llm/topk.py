"""Exact top-k search by Fagin's threshold algorithm.

Candidates are dealt by a hash into shards of about ``SHARD`` rows.  In each
shard every dimension has a list of its rows sorted by component, made once;
the queries stream past it.  For a query the lists are read in parallel - from
the top where the query's component is positive, from the bottom where it is
negative - a few rows at first, then in growing steps; rows met for the first
time are scored in full, and reading stops once the bound (the score of an
unmet row with the components reached so far) cannot beat the kth score found.
If the next step would read more entries than there are rows unmet, these are
scored and the search ends: so a query never costs much more than a scan, also
where the bound cannot stop it (see the README for the share of rows scored).
The shards' results are merged by query.

A stated set of queries meets all rows, shard by shard; a task holds the rows
of one shard and one batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneline.llm.common import trim
from sceneline.llm.vectors import best_of, matrix, usable

#: Candidates of a shard, about.
SHARD = 4096
#: Rows of each list that are read first.
STEP = 4
#: Components are scaled by this and rounded down.
SCALE = 256


class Lists:
    """The sorted lists of a shard: rows ``x`` (whole numbers exact in double precision) with ascending ``ids``."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        up = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.rows = np.concatenate((up[::-1], up), axis=1)  # for positive components, then for negative ones
        self.values = np.take_along_axis(np.concatenate((x, x), axis=1), self.rows, axis=0)

    def search(self, q: np.ndarray, me: int, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Ids and scores of the ``k`` best rows but those with the id ``me``; depth read and number of rows scored."""
        ids, x = self.ids, self.x
        n, dim = x.shape
        used = np.flatnonzero(q)
        weights, lists = q[used], np.where(q[used] > 0, used, used + dim)
        met = ids == me
        unmet = n - int(met.sum())
        best_row, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        depth, step, scored = 0, STEP, 0
        while unmet:
            if step * len(used) >= unmet or depth >= n:
                new = np.flatnonzero(~met)
            else:
                new = self.rows[depth : depth + step][:, lists].ravel()
                new = np.unique(new[~met[new]])
                depth += step
                step *= 2
            met[new] = True
            unmet -= len(new)
            scored += len(new)
            score = x[new] @ q
            if len(score) > k:  # of the new rows only those that can be among the k best
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                new, score = new[keep], score[keep]
            best_row, best = np.concatenate((best_row, new)), np.concatenate((best, score))
            top = np.lexsort((best_row, -best))[:k]  # rows are in the order of their ids
            best_row, best = best_row[top], best[top]
            if len(best) == k and depth < n and float(self.values[depth, lists] @ weights) < best[-1]:
                break  # an unmet row cannot even tie with the kth
        return ids[best_row], best, depth, scored


class SearchShards:
    """For ``mapInPandas`` over rows sorted by shard, candidates before queries: the ``k`` best of a shard for each query."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, lists = None, [], {}
        for batch in batches:
            for name, part in batch.groupby("shard", sort=True):
                if name != shard:
                    shard, held, lists = name, [], {}
                query = part["query"].to_numpy()
                if not query.all():
                    held.append((part["vec_id"].to_numpy()[~query], part["x"][~query].tolist()))
                if query.any():
                    if held:
                        lists, held = self.sorted(held), []
                    yield self.answers(lists, part[query])
        trim()

    def sorted(self, held) -> dict[int, Lists]:
        """Lists by number of dimensions: vectors of another length are no candidates."""
        ids = np.concatenate([h[0] for h in held])
        vectors = [v for h in held for v in h[1]]
        length = np.array([len(v) for v in vectors])
        out = {}
        for dim in np.unique(length).tolist():
            at = np.flatnonzero(length == dim)
            at = at[np.argsort(ids[at], kind="stable")]
            out[dim] = Lists(ids[at], np.array([vectors[i] for i in at], dtype=np.float64))
        return out

    def answers(self, lists: dict[int, Lists], queries: pd.DataFrame) -> pd.DataFrame:
        out = [[], [], []]
        for me, x in zip(queries["vec_id"].to_numpy(), queries["x"], strict=True):
            if own := lists.get(len(x)):
                got, score, _, _ = own.search(np.asarray(x, dtype=np.float64), me, self.k)
                for column, values in zip(out, (np.full(len(got), me), got, score), strict=True):
                    column.append(values)
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in zip(("query_id", "vec_id", "score"), out, strict=True)})


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and x: floor(256 * component), as double; whole numbers, so that sums are exact."""
    return usable(vectors).withColumn("x", F.transform("x", lambda v: F.floor(v * SCALE).cast("double")))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for each row whose id is divisible by ``every``.

    Vectors that are null, empty or hold a null or non-finite component take no part; vectors
    of another length than the query's are not its candidates.  Ties go to the smaller id.  If an
    id is repeated, its rows are candidates each on their own (dealt to all shards), and as a query
    it is searched once for each different row.  An empty table gives an empty result; other
    columns are ignored.
    """
    rows = quantized(vectors)
    shards = max(1, -(-rows.count() // SHARD))
    cands = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "x", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"])
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = cands.withColumn("query", F.lit(False)).unionByName(queries.withColumn("query", F.lit(True)))
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", "query")
    found = both.mapInPandas(SearchShards(k), "query_id long, vec_id long, score double")
    return best_of(found, k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
