"""Vector code compression: product codes whose codebooks come from the filtering form of Lloyd's algorithm.

Vectors are cut into equal parts.  Rows are packed into blocks, and each block
holds a kd-tree over its parts at each position: bounding boxes with the sum
and the count of what they hold, made once.  In a round the entries of a
codebook go down the tree together.  An entry leaves at a box all of which is
nearer to the entry that is nearest to the box's middle; a box with one entry
left is assigned whole, by its sum and count, and only leaves with several
entries are looked at point by point.  Equal distances go to the lower entry,
so all counts, sums and codes are those of the plain algorithm.

The blocks are written once; every round reads them and shuffles a row for each
entry and task.  The driver holds the codebooks.  What a task has in memory is
a few blocks, and no step needs the rows of one key together.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneline.llm.common import attach_totals, finite_vectors, materialize, trim

#: Components are scaled by this and rounded down.
SCALE = 4096
#: Scaled components may be so large at most: squares of differences then add up within 64 bits.
MOST = 1 << 27
#: Rows of a block, and points of a leaf, at most.
BLOCK, LEAF = 2048, 16


class Tree:
    """A kd-tree over the rows of ``x``: nodes are spans of a permutation with box, sum and left child (right is the next)."""

    def __init__(self, x: np.ndarray):
        x = x.astype(np.int64)
        order = np.arange(len(x))
        spans, left, at = [(0, len(x))], [], 0
        while at < len(spans):
            a, b = spans[at]
            own = x[order[a:b]]
            wide = np.ptp(own, axis=0)
            if b - a > LEAF and wide.any():
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide.argmax()], half)]
                left.append(len(spans))
                spans += [(a, a + half), (a + half, b)]
            else:
                left.append(-1)
            at += 1
        self.order, self.x, self.left = order.astype(np.int32), x[order].astype(np.int32), np.array(left, dtype=np.int32)
        self.spans = np.array(spans, dtype=np.int32)
        self.low, self.high = (np.array([f(self.x[a:b], axis=0) for a, b in spans], dtype=np.int32) for f in (np.min, np.max))
        total = np.concatenate((np.zeros((1, x.shape[1]), dtype=np.int64), np.cumsum(self.x, axis=0, dtype=np.int64)))
        self.sums = total[self.spans[:, 1]] - total[self.spans[:, 0]]

    def dumps(self) -> bytes:
        return pickle.dumps((self.order, self.x, self.left, self.spans, self.low, self.high, self.sums), protocol=5)

    @classmethod
    def loads(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.order, tree.x, tree.left, tree.spans, tree.low, tree.high, tree.sums = pickle.loads(data)
        return tree

    def filter(self, entries: np.ndarray):
        """Yields whole nodes (nodes, entry of each) and, of undecided leaves, points (places in the permutation, entry of each)."""
        k = len(entries)
        nodes, open_ = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
        while len(nodes):
            low, high = self.low[nodes].astype(np.int64), self.high[nodes].astype(np.int64)
            middle = ((low + high)[:, None, :] - 2 * entries[None, :, :]) ** 2
            middle = np.where(open_, middle.sum(axis=2), np.iinfo(np.int64).max)
            best = middle.argmin(axis=1)  # the lowest of equal ones
            lead = entries[best]
            corner = np.where(entries[None, :, :] > lead[:, None, :], high[:, None, :], low[:, None, :])  # of the box, the one most in favour of the entry
            own, led = ((corner - entries[None]) ** 2).sum(axis=2), ((corner - lead[:, None, :]) ** 2).sum(axis=2)
            open_ = open_ & ((own < led) | ((own == led) & (np.arange(k)[None, :] <= best[:, None])))
            whole = open_.sum(axis=1) == 1
            yield nodes[whole], best[whole], None
            leaf = ~whole & (self.left[nodes] < 0)
            if leaf.any():
                spans = self.spans[nodes[leaf]].astype(np.int64)
                size = spans[:, 1] - spans[:, 0]
                places = np.arange(size.sum()) + np.repeat(spans[:, 0] - np.cumsum(size) + size, size)
                d = ((self.x[places].astype(np.int64)[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
                d = np.where(np.repeat(open_[leaf], size, axis=0), d, np.iinfo(np.int64).max)
                yield None, d.argmin(axis=1), places
            down = ~whole & ~leaf
            first = self.left[nodes[down]].astype(np.int64)
            nodes, open_ = np.concatenate((first, first + 1)), np.concatenate((open_[down], open_[down]))

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the points of each entry."""
        n, sums = np.zeros(len(entries), dtype=np.int64), np.zeros(entries.shape, dtype=np.int64)
        for nodes, entry, places in self.filter(entries):
            if places is None:
                np.add.at(n, entry, self.spans[nodes, 1] - self.spans[nodes, 0])
                np.add.at(sums, entry, self.sums[nodes])
            else:
                np.add.at(n, entry, 1)
                np.add.at(sums, entry, self.x[places])
        return n, sums

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row."""
        place = np.zeros(len(self.x), dtype=np.int64)
        for nodes, entry, places in self.filter(entries):
            if places is None:
                for (a, b), e in zip(self.spans[nodes].tolist(), entry.tolist(), strict=True):
                    place[a:b] = e
            else:
                place[places] = entry
        code, error = np.empty_like(place), np.empty_like(place)
        code[self.order], error[self.order] = place, ((self.x - entries[place]) ** 2).sum(axis=1)
        return code, error


class Pack:
    """For ``mapInArrow`` over vec_id, label, x: blocks of rows, each with the tree of every part position."""

    def __init__(self, parts: int):
        self.parts = parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                held.append(whole.slice(at, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield self.block(held)
                    held, n = [], 0
        if n:
            yield self.block(held)
        trim()

    def block(self, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        column = lambda name: table.column(name).chunk(0)
        x = column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, self.parts, -1)
        trees = [Tree(x[:, p, :]).dumps() for p in range(self.parts)]
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, n], type=pa.int32()), v)
        return pa.RecordBatch.from_arrays([one(column("vec_id")), one(column("label")), pa.array([trees], type=pa.list_(pa.binary()))], names=["vec_ids", "labels", "trees"])


class Totals:
    """For ``mapInArrow`` over blocks: count and sum of each part position and entry met."""

    def __init__(self, books):
        self.books = books

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = self.books.value
        n, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for row in batch.column("trees"):
                for p, data in enumerate(row):
                    more, total = Tree.loads(data.as_py()).totals(books[p])
                    n[p] += more
                    sums[p] += total
        p, e = np.nonzero(n)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])
        trim()


class Encode:
    """For ``mapInArrow`` over blocks: code and error of every row."""

    def __init__(self, books):
        self.books = books

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = self.books.value
        for batch in batches:
            for i in range(batch.num_rows):
                codes, errors = zip(*(Tree.loads(d.as_py()).codes(books[p]) for p, d in enumerate(batch.column("trees")[i])), strict=True)
                text = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[i].values, batch.column("labels")[i].values, pa.array(text, pa.string()), pa.array(sum(errors), pa.int64())], names=["vec_id", "label", "code", "error"])
        trim()


def fit_and_encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error) of the kept vectors, and the codebooks (part, entry, component)."""
    if entries > 256:
        raise ValueError("a code is a byte: 256 entries at most")
    spark = vectors.sparkSession
    kind = vectors.schema["label"].dataType.simpleString()
    rows = finite_vectors(vectors, "label").where("size(x) > 0")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), np.zeros((parts, 0, 1), dtype=np.int64)
    dim = common[0]["d"]
    if dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("x") == dim).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("x"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()  # as many rows as entries
    books = np.array([list(r["x"]) for r in first], dtype=np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    x = F.when(F.exists("x", lambda v: F.abs(v) > MOST), F.raise_error(F.lit("a component is too large to be coded exactly"))).otherwise(F.col("x").cast("array<int>"))
    blocks = materialize(rows.select("vec_id", "label", x.alias("x")).mapInArrow(Pack(parts), f"vec_ids array<long>, labels array<{kind}>, trees array<binary>"), "code-blocks")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        parted = blocks.select("trees").mapInArrow(Totals(shared), "part int, entry int, n long, total array<long>")
        sums = parted.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(dim // parts)))
        for r in sums.collect():  # a row for each entry
            books[r["part"], r["entry"]] = [r[f"t{d}"] // r["n"] for d in range(dim // parts)]
        shared.unpersist()
    return blocks.mapInArrow(Encode(spark.sparkContext.broadcast(books)), f"vec_id long, label {kind}, code string, error long"), books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor do those of
    another length than the table's commonest (all have one length in a sound table).  With fewer
    vectors than ``entries`` a codebook has as many entries.  Null ids come last in the order of ids,
    equal ids go by their vectors, and each row is coded on its own.  Null labels are one label.
    Equal distances go to the lower entry, also between equal entries.  An empty table gives an empty
    result; other columns are ignored.  A component whose scaled value is beyond 2^27 raises an error.
    """
    coded, books = fit_and_encode(vectors, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = materialize(coded, "codes")
    found = attach_totals(coded, "label", coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
