"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted by k-means on a
bounded sample (one row for each of ``SAMPLE`` hash buckets).  Every row is
filed in the list of its nearest centroid with the codes of its residual and how
far the codes are off.  A query has a floor, the k-th best score in the sample,
and probes each list that can reach it: the product with the centroid plus the
list's radius times the query's length.  There a table of asymmetric distances
ranks the codes, the best are scored exactly, and so is every other row whose
distance by codes, plus what these are off, can reach the k-th best.  No row is
lost, whatever the lengths and clusters of the vectors; these decide how many
lists and rows are left out.

A list is one key, and a frequent vector can make one list hold a third of all
rows, so a list of more than ``GROUP`` rows is dealt by a hash to as many groups
as it needs, and smaller lists share groups of about that size; a query goes
once to each group with rows of a list that it probes.  A task holds the rows of
one group, and the queries stream past them.  The number of lists grows with the
square root of the table up to ``MAX_LISTS``; what the driver holds, and what is
broadcast, has a row for each list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneline.llm.common import materialize, trim
from sceneline.llm.vectors import best_of, dot, matrix, usable

#: Rows that centroids and codebooks are fitted on, at most.
SAMPLE = 8192
#: Coarse lists: square root of the rows, within these limits.
MIN_LISTS, MAX_LISTS = 16, 4096
#: Subspaces of the residual and code words of each (codes fit in a byte).
SUBSPACES, WORDS = 32, 256
#: Rows of a group, about.  Each gives its best rows for each query, so small groups make many partial results.
GROUP = 8192
#: Rows scored exactly for a query in each group, before the bounds say which others have to be.
RERANK = 200
#: Added to bounds for rounding, as a share of the lengths.
SLACK = 2e-9
#: Queries worked on at once.
QUERY_BLOCK = 128


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


@dataclass
class Index:
    """Coarse centroids and, for each subspace, the code words of the residuals."""

    coarse: np.ndarray
    books: list[np.ndarray]
    spans: list[tuple[int, int]]

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([nearest(residuals[:, a:b], book) for (a, b), book in zip(self.spans, self.books, strict=True)], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def fit(sample: np.ndarray, lists: int) -> Index:
    coarse = kmeans(sample, lists)
    residuals = sample - coarse[nearest(sample, coarse)]
    edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
    spans = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return Index(coarse, [kmeans(residuals[:, a:b], WORDS) for a, b in spans], spans)


class File:
    """For ``mapInPandas``: the list and codes of each row; how far it is from the centroid, and the codes from it, at most."""

    def __init__(self, index):
        self.index = index

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = self.index.value
        for batch in batches:
            if len(batch):
                x = matrix(batch["x"])
                lists = nearest(x, index.coarse)
                residuals = x - index.coarse[lists]
                codes = index.codes(residuals)
                far, slack = lengths(residuals), SLACK * lengths(x)
                off = lengths(residuals - index.decoded(codes))
                yield batch.assign(list=lists.astype(np.int32), codes=[c.tobytes() for c in codes], far=far * (1 + SLACK) + slack, off=off * (1 + SLACK) + slack)


class Probe:
    """For ``mapInPandas``: a row for each group that a query goes to, with its floor and the lists it probes there.

    ``sample`` (ids and vectors) has rows of the table; a query's floor is the ``k``-th best score in it.
    """

    def __init__(self, index, sample, groups: dict[int, range], radius: dict[int, float], k: int):
        self.index, self.sample, self.groups, self.radius, self.k = index, sample, groups, radius, k

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coarse = self.index.value.coarse
        names = np.array(sorted(self.groups), dtype=np.intp)
        radius = np.array([self.radius[c] for c in names.tolist()])
        for batch in batches:
            for start in range(0, len(batch), QUERY_BLOCK):
                part = batch.iloc[start : start + QUERY_BLOCK]
                x = matrix(part["x"], coarse.shape[1])
                floors = self.floors(x, part["vec_id"].to_numpy())
                most = x @ coarse[names].T + lengths(x)[:, None] * radius
                at, groups, lists = [], [], []
                for i, reach in enumerate(~(most < floors[:, None])):  # a bound that is no number leaves nothing out
                    own: dict[int, list[int]] = {}
                    for c in names[reach].tolist():
                        for g in self.groups[c]:
                            own.setdefault(g, []).append(c)
                    at += [i] * len(own)
                    groups += own
                    lists += own.values()
                if at:
                    yield part.iloc[at].assign(group=np.array(groups, dtype=np.int32), probed=lists, floor=floors[at])

    def floors(self, x: np.ndarray, me: np.ndarray) -> np.ndarray:
        ids, rows = self.sample.value
        out = np.full(len(x), -np.inf)
        about = x @ rows.T
        about[me[:, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(about):
            if len(ids) > self.k:
                at = np.argpartition(row, len(row) - self.k)[len(row) - self.k :]
                if (ids[at] != me[i]).all():
                    out[i] = dot(rows[at], x[i]).min()
        return out


class Group:
    """The rows of a group, sorted by list and id."""

    def __init__(self, index: Index, rows: pd.DataFrame):
        rows = rows.sort_values(["list", "vec_id"], kind="stable")
        self.index, self.ids, self.x = index, rows["vec_id"].to_numpy(), matrix(rows["x"])
        self.off = rows["off"].to_numpy()
        self.codes = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(rows), -1).astype(np.intp)
        names, first = np.unique(rows["list"].to_numpy().astype(np.int64), return_index=True)
        self.lists = list(zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(rows)], strict=True))

    def search(self, queries: pd.DataFrame, k: int, rerank: int) -> pd.DataFrame:
        """The ``k`` best rows for each query in the lists it probes: by codes, then exactly."""
        found, ids, x = [], self.ids, self.x
        q = matrix(queries["x"])
        about = self.about(q, queries["probed"])
        most = about + lengths(q)[:, None] * self.off
        for i, (me, floor) in enumerate(zip(queries["vec_id"], queries["floor"], strict=True)):
            open_ = (about[i] != -np.inf) & (ids != me)
            at = np.flatnonzero(open_)
            if len(at) > rerank:
                at = at[np.argpartition(about[i][at], len(at) - rerank)[len(at) - rerank :]]
            score = dot(x[at], q[i])
            if len(at) >= k:
                floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
            open_[at] = False
            more = np.flatnonzero(open_ & ~(most[i] < floor))  # a bound that is no number leaves nothing out
            at, score = np.concatenate((at, more)), np.concatenate((score, dot(x[more], q[i])))
            top = np.lexsort((ids[at], -score))[:k]
            top = top[score[top] >= floor]
            found.append(pd.DataFrame({"query_id": me, "vec_id": ids[at][top], "score": score[top]}))
        return pd.concat(found)

    def about(self, q: np.ndarray, probed: pd.Series) -> np.ndarray:
        """The score of each row by its codes, minus infinity in lists that the query does not probe."""
        index = self.index
        tables = [q[:, a:b] @ book.T for (a, b), book in zip(index.spans, index.books, strict=True)]
        about = np.full((len(q), len(self.ids)), -np.inf)
        sets = [frozenset(map(int, p)) for p in probed]
        runs: list[tuple[list[int], int, int, list[int]]] = []  # lists next to each other that the same queries probe
        for name, a, b in self.lists:
            who = [i for i, p in enumerate(sets) if name in p]
            if runs and runs[-1][0] == who and runs[-1][2] == a:
                runs[-1] = (who, runs[-1][1], b, [*runs[-1][3], *[name] * (b - a)])
            elif who:
                runs.append((who, a, b, [name] * (b - a)))
        for who, a, b, names in runs:
            at = slice(None) if len(who) == len(q) else np.array(who, dtype=np.intp)
            sums = (q[at] @ index.coarse.T)[:, names]
            for s, table in enumerate(tables):
                sums += table[at][:, self.codes[a:b, s]]
            about[at, a:b] = sums
        return about


class SearchGroups:
    """For ``mapInPandas`` over rows sorted by group, those of the index before the queries."""

    def __init__(self, index, k: int, rerank: int):
        self.index, self.k, self.rerank = index, k, rerank

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held, group = None, [], None
        for batch in batches:
            for own, part in batch.groupby("group", sort=True):
                if own != name:
                    name, held, group = own, [], None
                query = part["query"].to_numpy()
                if not query.all():
                    held.append(part[~query])
                if query.any():
                    if held:
                        group, held = Group(self.index.value, pd.concat(held)), []
                    asked = part[query]
                    for k in range(0, len(asked) if group else 0, QUERY_BLOCK):
                        yield group.search(asked.iloc[k : k + QUERY_BLOCK], self.k, self.rerank)
        trim()


def pack(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """From the rows of each list: (list, first group, number of groups) of each."""
    table, group, filled = [], 0, 0
    for name, n in sorted(sizes.items()):
        parts = -(-n // GROUP)
        if filled and filled + n > GROUP:
            group, filled = group + 1, 0
        table.append((name, group, parts))
        if parts > 1:
            group, filled = group + parts, 0
        else:
            filled += n
    return table


def search(vectors: DataFrame, k: int = 20, every: int = 20, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows for each row whose id is divisible by ``every``.

    Nearness is the inner product in double precision.  Vectors that are null, empty, zero or
    hold a null or non-finite component take no part, nor do those of another length than the
    table's commonest (all have one length in a sound table).  Ties go to the smaller id.  A
    repeated id is a candidate for each of its rows and one query (its least vector).  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, zero=False)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("x") == dim)
    h = F.xxhash64("vec_id")
    sample = rows.groupBy(F.pmod(h, F.lit(SAMPLE)).alias("b")).agg(F.min(F.struct(h.alias("h"), "vec_id", "x")).alias("m")).select("m.vec_id", "m.x")
    got = sample.toPandas().sort_values("vec_id")  # SAMPLE rows
    lists = min(MAX_LISTS, max(MIN_LISTS, math.isqrt(total)))
    index = spark.sparkContext.broadcast(fit(matrix(got["x"]), lists))

    filed = materialize(rows.mapInPandas(File(index), "vec_id long, x array<double>, list int, codes binary, far double, off double"), "ivf-lists")
    of_lists = filed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # MAX_LISTS rows
    table = pack({r["list"]: r["n"] for r in of_lists})
    groups = {name: range(first, first + parts) for name, first, parts in table}
    of_list = F.broadcast(spark.createDataFrame(table, "list int, first int, parts int"))  # MAX_LISTS rows
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts"))
    filed = filed.join(of_list, "list").select("vec_id", "x", "list", "codes", "off", (F.col("first") + dealt).cast("int").alias("group"), F.lit(False).alias("query"))
    known = spark.sparkContext.broadcast((got["vec_id"].to_numpy(), matrix(got["x"])))
    radius = {r["list"]: r["radius"] for r in of_lists}
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    probed = queries.mapInPandas(Probe(index, known, groups, radius, k), "vec_id long, x array<double>, group int, probed array<int>, floor double")
    both = filed.unionByName(probed.withColumn("query", F.lit(True)), allowMissingColumns=True)
    n_groups = max(first + parts for _, first, parts in table)
    both = both.repartition(n_groups, "group").sortWithinPartitions("group", "query")
    return best_of(both.mapInPandas(SearchGroups(index, k, rerank), "query_id long, vec_id long, score double"), k)
