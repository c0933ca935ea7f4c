"""Exact Jaccard join of word-shingle sets by universe partition and the pigeonhole principle.

Two sets that link differ in at most H tokens, H being fixed by the threshold
and the larger size in their size band.  A hash deals the token universe into
m segments.  Each segment gets 1 (its two parts must be equal) or 2 (they may
differ by one token: the part itself and all its one-deletion neighbours are
indexed); if these numbers add up to H + 1, linked sets agree in at least one
segment.  How many segments get 2 is decided by band from a cost model: rows
indexed against the pairs that chance agreement of small segments would make.

Two empty parts agree without telling anything.  There are some more segments
of number 1 than needed, so that nearly all sets have H + 1 without the empty
ones; these sets do not index their empty parts.  The few other sets do, so
that two of them still meet.

A set of a band is indexed in the scheme of its band, and also in the scheme
of the band below if it is small enough to link there.  Equal sets are one
node.  Signatures are packed by hash range; within a task copies and frequent
signatures are combined before the shuffle, so no key gathers unbounded rows.

Signatures shared by up to ``SMALL`` nodes give all their pairs.  Of a frequent
signature the nodes are dealt into blocks.  First each block gives the pairs of
a minimum spanning forest over what sizes and parity bitmaps (a lower bound of
the difference) leave possible: no more pairs than nodes, which contract a group
of near copies, however large, to a few components.  After that all nodes of
different components are compared, block against block, by size and bitmap, so
nothing is lost.  Every candidate is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneline.llm.common import checked_broadcast, map_texts, materialize, trim
from sceneline.llm.components import components
from sceneline.llm.shingles import bitmaps, fingerprints, folded, mix, sum_by, token_sets

#: Nodes of a signature up to which all pairs are taken.
SMALL = 8
#: Signatures held by a task before they are combined and handed on.
BUFFER = 500_000
#: Signatures of a hash range, about.
RANGE = 150_000
#: Nodes of a block when frequent signatures are compared.
BLOCK = 1024
#: Rows of blocks that are worked on together, about.
PACK = 20_000
#: Frequent signatures that a node carries, its smallest, by which a pair is given in one of those it shares.
CARRIED = 16
#: For the cost model: share of a text's tokens that are common, and share of the sets that have one of them.
COMMON, PARTNERS = 0.1, 0.001

_U = np.uint64
_C = _U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Scheme:
    """Segments of a size band: the first ``twos`` allow one difference, the ``ones`` after them none.

    ``needed`` of the ones have to be non-empty for a set to leave out its empty ones.
    """

    low: int
    high: int
    ones: int
    twos: int
    needed: int

    @property
    def segments(self) -> int:
        return self.ones + self.twos


def difference(size: int, num: int, den: int) -> int:
    """Most tokens in which a set of ``size`` and a linked one that is not smaller can differ."""
    return (den - num) * size // num


def _ones(needed: int, twos: int, low: int) -> int:
    """Segments of which at least ``needed`` are non-empty in nearly every set of ``low`` tokens."""
    n = needed
    while n and n < 8 * needed:
        filled = n * (1 - math.exp(-low / (n + twos)))
        if filled - 2 * math.sqrt(filled) >= needed:
            break
        n += max(1, n // 16)
    return n


def allocate(low: int, high: int, sets: float, num: int, den: int) -> Scheme:
    """The cheapest way to H + 1: rows of a set plus its expected chance partners."""
    need = difference(high, num, den) + 1
    if need == 1:
        return Scheme(low, high, 0, 0, 0)  # only equal sets link
    best = None
    most = -(-need // 2)
    for twos in sorted({0, most // 4, most // 2, 3 * most // 4, most}):
        needed = max(0, need - 2 * twos)
        ones = _ones(needed, twos, low)
        m = ones + twos
        rows = ones * (1 - math.exp(-high / m)) + twos * (1 + high / m)
        # Partners by parts made of common tokens only, and by parts that are empty in both sets.
        common = PARTNERS * sets * ones * (math.exp(-(1 - COMMON) * low / m) - math.exp(-low / m))
        empty = sets * twos * math.exp(-2 * low / m)
        if best is None or rows + common + empty < best[0]:
            best = (rows + common + empty, Scheme(low, high, ones, twos, needed))
    return best[1]


def bands(largest: int, num: int, den: int) -> list[tuple[int, int]]:
    """Size bands; a set links only within its band and the one below or above."""
    ratio = (den / num) ** max(1, round(math.log(1.4) / math.log(den / num)))
    out, low = [], 1
    while low <= largest:
        high = max(low, den * low // num, int(low * ratio))
        out.append((low, high))
        low = high + 1
    return out


class Sketch:
    """For :func:`map_texts`: size, fingerprint and parity bitmap of each set."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, texts):
        at, tokens, sizes = token_sets(texts, self.k)
        fp = fingerprints(at, tokens, sizes)
        return [sizes, [int(f) if n else None for f, n in zip(fp, sizes, strict=True)], bitmaps(at, tokens, sizes)]


class Sets:
    """For :func:`map_texts`: fingerprint and tokens of each set."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, texts):
        at, tokens, sizes = token_sets(texts, self.k)
        fp = fingerprints(at, tokens, sizes)
        parts = np.split(tokens, np.cumsum(sizes)[:-1])
        return [[int(f) if n else None for f, n in zip(fp, sizes, strict=True)], [np.sort(p).tobytes() for p in parts]]


def signatures(schemes: list[Scheme], num: int, den: int, at: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, node) rows of the sets in the schemes of their own band and the one below."""
    lows = np.array([s.low for s in schemes])
    own_band = np.searchsorted(lows, sizes, side="right") - 1
    first = np.cumsum(sizes) - sizes
    value = mix(tokens + _C)
    out_sig, out_fp = [], []
    for step in (0, 1):
        band = own_band - step
        use = (sizes > 0) & (band >= 0)
        if step:
            highs = np.array([s.high for s in schemes])
            use &= sizes * num <= highs[np.maximum(band, 0)] * den  # else too large to link there
        m = np.array([s.segments for s in schemes])[np.maximum(band, 0)]
        twos = np.array([s.twos for s in schemes])[np.maximum(band, 0)]
        needed = np.array([s.needed for s in schemes])[np.maximum(band, 0)]
        use &= m > 0
        ids = np.flatnonzero(use)
        if not len(ids):
            continue
        tok = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in ids])
        doc = np.repeat(np.arange(len(ids)), sizes[ids])
        m, twos, band = m[ids], twos[ids], band[ids]
        begin = np.cumsum(m) - m
        seg = ((tokens[tok] >> _U(17)) % m[doc].astype(_U)).astype(np.int64)
        cell = begin[doc] + seg
        sums = sum_by(cell, value[tok], int(m.sum()))
        cell_doc = np.repeat(np.arange(len(ids)), m)
        cell_seg = np.arange(int(m.sum())) - begin[cell_doc]
        salt = mix((band[cell_doc].astype(_U) << _U(40)) + cell_seg.astype(_U) + _U(1))
        one = cell_seg >= twos[cell_doc]
        filled = np.bincount(cell, minlength=len(sums)) > 0
        short = np.bincount(cell_doc, one & filled, len(ids)) < needed[ids]
        told = ~one | filled | short[cell_doc]
        out_sig.append(mix(sums ^ salt)[told])
        out_fp.append(fp[ids][cell_doc][told])
        lose = seg < twos[doc]
        if lose.any():
            c = cell[lose]
            out_sig.append(mix((sums[c] - value[tok[lose]]) ^ salt[c]))
            out_fp.append(fp[ids][doc[lose]])
    if not out_sig:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_sig), np.concatenate(out_fp)


def _runs(sig: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows sorted by signature and node; start and length of the run of each signature."""
    order = np.lexsort((fp, sig))
    sig, fp = sig[order], fp[order]
    keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1]))) if len(sig) else np.zeros(0, dtype=bool)
    sig, fp = sig[keep], fp[keep]
    start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, dtype=np.int64)
    return sig, fp, start, np.diff(np.concatenate((start, [len(sig)])))


def _parts(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the rows that have it."""
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order])) + 1
    for at in np.split(order, edges):
        if len(at):
            yield int(key[at[0]]), at


class Index:
    """For ``mapInPandas``: texts to packed signatures (range, signatures, nodes).

    Ranges from ``ranges`` on hold rows of signatures that were frequent within a task; these
    rows need not meet, so they are dealt out by the node.  Of such a signature a task hands on
    ``small`` + 1 nodes in the range proper, which marks it as frequent.
    """

    def __init__(self, k: int, num: int, den: int, schemes: list[Scheme], ranges: int, small: int):
        self.k, self.num, self.den, self.schemes, self.ranges, self.small = k, num, den, schemes, ranges, small
        self.marked = np.zeros(0, dtype=_U)  # signatures that this task has marked as frequent

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        self.marked = np.zeros(0, dtype=_U)
        for batch in batches:
            for k in range(0, len(batch), 256):
                texts = [t if isinstance(t, str) else None for t in batch["text"].iloc[k : k + 256]]
                at, tokens, sizes = token_sets(texts, self.k)
                rows = signatures(self.schemes, self.num, self.den, at, tokens, sizes, fingerprints(at, tokens, sizes))
                held.append(rows)
                n += len(rows[0])
                if n >= BUFFER:
                    yield self.pack(held)
                    n = 0
        if n:
            yield self.pack(held)
        trim()

    def pack(self, held) -> pd.DataFrame:
        sig, fp, start, length = _runs(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        held.clear()
        out = []
        known = np.isin(sig[start], self.marked)
        frequent = (length > self.small + 1) | known
        if frequent.any():
            row = np.repeat(np.arange(len(start)), length)
            place = np.arange(len(sig)) - start[row]
            extra = frequent[row] & ((place > self.small) | known[row])
            self.marked = np.union1d(self.marked, sig[start][frequent])
            s, f = sig[extra], fp[extra]
            for r, at in _parts((mix(f.view(_U)) % _U(self.ranges)).astype(np.int64)):
                out.append((self.ranges + r, s[at].astype("<u8").tobytes(), f[at].astype("<i8").tobytes()))
            sig, fp = sig[~extra], fp[~extra]
        for r, at in _parts((sig % _U(self.ranges)).astype(np.int64)):
            out.append((r, (sig[at] // _U(self.ranges)).astype("<u4").tobytes(), fp[at].astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["range", "sigs", "nodes"])


class Meet:
    """Called by grouped ``applyInPandas``: a hash range to candidate pairs (kind 0) and rows of frequent signatures (kind 1)."""

    def __init__(self, ranges: int, small: int):
        self.ranges, self.small = ranges, small

    def __call__(self, packed: pd.DataFrame) -> pd.DataFrame:
        r = int(packed["range"].iloc[0])
        fp = np.frombuffer(b"".join(packed["nodes"]), dtype="<i8")
        if r >= self.ranges:
            sig = np.frombuffer(b"".join(packed["sigs"]), dtype="<u8")
            part = sig % _U(self.ranges)
            short = (sig // _U(self.ranges)) & _U(0xFFFFFFFF)
            return pd.DataFrame({"kind": 1, "a": ((part << _U(32)) | short).view(np.int64), "b": fp})
        sig = np.frombuffer(b"".join(packed["sigs"]), dtype="<u4")
        sig, fp, start, length = _runs(sig, fp)
        a, b = [], []
        for n in range(2, self.small + 1):
            s = start[length == n]
            if len(s):
                i, j = np.triu_indices(n, 1)
                a.append(fp[(s[:, None] + i).ravel()])
                b.append(fp[(s[:, None] + j).ravel()])
        pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0) if a else np.zeros((0, 2), dtype=np.int64)
        row = np.repeat(length > self.small, length)
        bucket = ((_U(r) << _U(32)) | sig[row].astype(_U)).view(np.int64)
        return pd.DataFrame(
            {"kind": np.repeat([0, 1], [len(pairs), len(bucket)]), "a": np.concatenate((pairs[:, 0], bucket)), "b": np.concatenate((pairs[:, 1], fp[row]))}
        )


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which each bitmap of ``x`` differs from each of ``y``."""
    out = np.zeros((len(x), len(y)), dtype=np.int32)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


class Near:
    """For ``mapInPandas``: the pairs that sizes and bitmaps leave possible."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for n1, n2, x, y in zip(batch["n_a"], batch["n_b"], batch["bits_a"], batch["bits_b"], strict=True):
                ok = min(n1, n2) * self.den >= max(n1, n2) * self.num
                if ok:
                    words = min(len(x), len(y)) // 8
                    differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                    ok = differ * (self.den + self.num) <= (n1 + n2) * (self.den - self.num)
                keep.append(ok)
            yield batch.loc[keep, ["a", "b"]]


def _shares_smaller(sig: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of ``x`` and ``y``, carried signatures, whether they have one in common below ``sig``."""
    out = np.zeros(len(x), dtype=bool)
    for k in range(0, len(x), BLOCK):
        a, b = x[k : k + BLOCK], y[k : k + BLOCK]
        out[k : k + BLOCK] = ((a[:, :, None] == b[:, None, :]) & (a < sig)[:, :, None]).any(axis=(1, 2))
    return out


def spanning_forest(far: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a minimum spanning forest of the graph with lengths ``far`` (negative: no edge); nodes of one root count as joined."""
    n, none = len(far), np.iinfo(np.int32).max
    d = np.where(far < 0, none - 1, far).astype(np.int32)
    d[root[:, None] == root[None, :]] = -1
    best, came = np.full(n, none - 1, dtype=np.int32), np.full(n, -1)
    i_out, j_out = [], []
    for _ in range(n):
        j = int(best.argmin())
        if 0 <= best[j] < none - 1:
            i_out.append(came[j])
            j_out.append(j)
        best[j] = none  # done
        nearer = (d[j] < best) & (best != none)
        best[nearer] = d[j][nearer]
        came[nearer] = j
    return np.array(i_out, dtype=np.intp), np.array(j_out, dtype=np.intp)


class CompareBlocks:
    """Called by grouped ``applyInPandas``: nodes of frequent signatures, two blocks of each, to pairs of different components that may link.

    With ``contract`` only the pairs of a spanning forest, within one block.  Without, all of them;
    a pair that shares a smaller signature is left to that one, where it meets as well.
    """

    def __init__(self, num: int, den: int, contract: bool):
        self.num, self.den, self.contract = num, den, contract

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sig", "lo", "hi", "node"], kind="stable", ignore_index=True)
        key = rows[["sig", "lo", "hi"]].to_numpy()
        edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        found = [self.one(rows.iloc[a:b]) for a, b in zip([0, *edges], [*edges, len(rows)], strict=True) if b - a > 1]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
        trim()
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    def one(self, rows: pd.DataFrame) -> np.ndarray:
        sig, lo, hi = (int(rows[c].iloc[0]) for c in ("sig", "lo", "hi"))
        root, block = rows["root"].to_numpy(), rows["block"].to_numpy()
        if (root == root[0]).all():
            return np.zeros((0, 2), dtype=np.int64)
        node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
        words = min(map(len, rows["bits"])) // 8
        bits = np.array([folded(b, words) for b in rows["bits"]], dtype=_U).reshape(-1, words)
        x, y = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        far = _differ(bits[x], bits[y]) * (self.den + self.num)
        most = (self.den - self.num) * (n[x][:, None] + n[y][None, :])
        if self.contract:
            i, j = spanning_forest(np.where(far <= most, (far << 10) // np.maximum(most, 1), -1), root)
        else:
            near = (far <= most) & (root[x][:, None] != root[y][None, :])
            if lo == hi:
                near &= node[x][:, None] < node[y][None, :]
            i, j = np.nonzero(near)
            i, j = x[i], y[j]
            carried = np.array([[*c, *[sig] * (CARRIED - len(c))] for c in rows["carried"]], dtype=np.int64).reshape(-1, CARRIED)
            first = ~_shares_smaller(sig, carried[i], carried[j])
            i, j = i[first], j[first]
        return np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), axis=1)


class Verify:
    """For ``mapInPandas``: the pairs whose whole sets reach the threshold."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                a, b = np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U)
                both = np.concatenate((a, b))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(self.den * inter >= self.num * (len(a) + len(b) - inter))
            yield batch.loc[keep, ["a", "b"]]


@dataclass
class Join:
    """A run of the join over ``docs`` (doc_id, text)."""

    docs: DataFrame
    k: int
    num: int
    den: int
    small: int = SMALL
    block: int = BLOCK

    def __post_init__(self):
        # Equal texts are known by a hash, so that rows without an id are found again.
        self.docs = self.docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
        keyed = self.docs.select(F.struct("doc_id", "text_key").alias("row"), "text")
        sketched = map_texts(keyed, Sketch(self.k), {"n": "long", "node": "long", "bits": "binary"}, key="row")
        self.sketch = materialize(sketched.select("row.*", "n", "node", "bits"), "jac-sketch")
        per_node = self.sketch.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.max("n").alias("n"), F.max("bits").alias("bits"))
        self.nodes = materialize(per_node, "jac-nodes")

    def schemes(self) -> tuple[list[Scheme], int]:
        """Schemes by size band and the number of hash ranges; from counts by size class."""
        classes = self.nodes.groupBy(F.floor(F.log2("n") * 4).alias("c")).agg(F.count("*").alias("sets"), F.max("n").alias("n"), F.sum("n").alias("tokens")).collect()  # some 4 rows for each doubling of the size
        if not classes:
            return [], 1
        count = {r["c"]: r["sets"] for r in classes}
        out = []
        for low, high in bands(max(r["n"] for r in classes), self.num, self.den):
            sets = sum(v for c, v in count.items() if 2 ** (c / 4) <= high * self.den / self.num and 2 ** ((c + 1) / 4) >= low)
            out.append(allocate(low, high, sets, self.num, self.den))
        rows = sum(r["tokens"] for r in classes) * 2.0 * (self.den - self.num) / self.num
        return out, max(8, math.ceil(rows / RANGE))

    def candidates(self) -> DataFrame:
        """(kind, a, b): pairs of nodes, and (signature, node) of frequent signatures."""
        schemes, ranges = self.schemes()
        packed = self.docs.select("text").mapInPandas(Index(self.k, self.num, self.den, schemes, ranges, self.small), "range long, sigs binary, nodes binary")
        meet = Meet(ranges, self.small)

        def per_range(rows: pd.DataFrame) -> pd.DataFrame:
            return meet(rows)

        return materialize(packed.groupBy("range").applyInPandas(per_range, "kind int, a long, b long"), "jac-candidates")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The distinct ``pairs`` (a, b) of nodes that link: by size and bitmap first, then on the whole sets."""
        nodes = self.nodes.select("node", "n", "bits")
        sides = [nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in ("a", "b")]
        sized = pairs.distinct().join(sides[0], "a").join(sides[1], "b")
        near = materialize(sized.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInPandas(Near(self.num, self.den), "a long, b long"), "jac-near")
        wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
        wanted = materialize(wanted.join(self.nodes.select("node", "text_key"), "node").select("text_key"), "jac-wanted")
        texts = self.docs.select("text_key", "text").where("text IS NOT NULL").join(checked_broadcast(wanted), "text_key", "left_semi")
        # Of equal texts, one; texts of one set that differ are already one in ``wanted``, but for equal keys.
        sets = map_texts(texts, Sets(self.k), {"node": "long", "tokens": "binary"}, key="text_key").where("node IS NOT NULL")
        sets = materialize(sets.dropDuplicates(["node"]).select("node", "tokens"), "jac-sets")
        of = lambda s: sets.select(F.col("node").alias(s), F.col("tokens").alias(f"set_{s}"))
        return materialize(near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b").mapInPandas(Verify(self.num, self.den), "a long, b long"), "jac-links")

    def members(self, found: DataFrame) -> DataFrame:
        """Each node of a frequent signature with its signatures and the number of blocks of each: as many as its text gives."""
        frequent = materialize(found.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("node")).distinct(), "jac-frequent")
        blocks = F.ceil(F.count("*") / self.block).cast("int").alias("blocks")
        wide = materialize(frequent.groupBy("sig").agg(blocks).where("blocks > 1"), "jac-wide")  # one in ``block`` rows at most
        of = F.struct("sig", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        sigs = frequent.join(checked_broadcast(wide), "sig", "left").groupBy("node").agg(F.array_sort(F.collect_list(of)).alias("sigs"))
        return materialize(self.nodes.select("node", "n", "bits").join(sigs, "node"), "jac-members")

    def compared(self, members: DataFrame, root: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b) of different components that may link, from the blocks of the frequent signatures; without ``root`` those of forests."""
        contract = root is None
        rows = members.withColumn("root", F.col("node")) if contract else members.join(root.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        carried = F.slice(F.transform("sigs", lambda s: s["sig"]), 1, CARRIED) if not contract else F.array().cast("array<long>")
        rows = rows.withColumn("carried", carried).withColumn("s", F.explode("sigs")).drop("sigs").select("*", "s.*")
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if not contract else block
        rows = rows.withColumn("block", block).withColumn("other", other)
        rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        packs = max(1, math.ceil(self.rows / PACK))
        rows = rows.withColumn("pack", F.pmod(F.xxhash64("sig", "lo", "hi"), F.lit(packs)))
        compare = CompareBlocks(self.num, self.den, contract)

        def per_pack(group: pd.DataFrame) -> pd.DataFrame:
            return compare(group)

        rows = rows.select("pack", "sig", "lo", "hi", "block", "node", "root", "n", "bits", "carried")
        return rows.groupBy("pack").applyInPandas(per_pack, "a long, b long")

    def links(self) -> DataFrame:
        """Links that connect the nodes as all links do."""
        found = self.candidates()
        pairs = found.where("kind = 0").select("a", "b")
        self.rows = found.where("kind = 1").count()
        if not self.rows:
            return self.verified(pairs)
        members = self.members(found)
        first = self.verified(pairs.union(self.compared(members)))
        return first.union(self.verified(self.compared(members, components(first))))

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        root = materialize(components(self.links()), "jac-components").withColumnRenamed("u", "node")
        rooted = materialize(self.nodes.select("node", "doc_id").join(root, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "jac-rooted")
        least = materialize(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "jac-least")
        own = materialize(rooted.join(least, "root").select("node", "component_id"), "jac-own")
        found = self.sketch.select("doc_id", "node", F.col("n").alias("n_shingles")).join(own, "node", "left")
        return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def join_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of ``docs``.

    Two rows link if den * |intersection| >= num * |union| of their sets of ``k``-word shingles.
    A text with fewer words has one shingle; a null text, or one without words, has none and
    links with nothing.  Repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result.  Tokens are 54-bit hashes and sets are known by 64-bit
    fingerprints: results are exact but for collisions of these.
    """
    return Join(docs, k, num, den).classes()


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all columns, whose doc_id is the smallest of its component.

    Rows with a null doc_id stay, as do null and empty texts.  Of repeated rows with that doc_id
    all stay.  Columns keep their values, whatever their names; an empty table gives an empty result.
    """
    found = join_components(docs, k, num, den)
    dropped = materialize(found.where("component_id < doc_id").select("doc_id").distinct(), "jac-dropped")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    kept = rows.join(checked_broadcast(dropped), F.col("row.doc_id") == dropped["doc_id"], "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
