"""Benchmark decontamination: an FM-index for each shard of training documents.

The words of a task's documents go into shards.  A shard's text holds every run
of words that benchmark items use (no phrase of a benchmark can occur outside
one), each different run once with the places where it occurs, closed by a
separator.  Its index has a Burrows-Wheeler transform in a wavelet matrix and
sampled suffix positions.  All phrases whose words the shard has are searched
backwards at once by wavelet ranks; every occurrence is located by walking back
to a sampled suffix; the places found become spans, and overlapping spans are
merged.

Benchmark items are cut into overlapping slices and dealt into blocks of about
``BLOCK_WORDS`` words, so what is broadcast is bounded; each block is one pass
over the documents, and a later pass adds to the spans of an earlier one.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneline.llm.common import materialize, trim

#: Words of a phrase; an item with fewer is one phrase.
WINDOW = 10
#: Words of a shard's index, about, and characters of its documents, at most (but for one document).
SHARD_WORDS, SHARD_CHARS = 1 << 19, 1 << 24
#: Words of a slice of an item, and of the slices that are broadcast at once.
SLICE, BLOCK_WORDS = 1024, 2_000_000
#: One suffix position in so many is kept.
SAMPLE = 16

#: Fixed: a word is a run of these, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPELLED = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


class Bits:
    """A bit vector with ranks: words of 64 bits, and the ones before each."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-(len(bits) + 1) % 64 + len(bits) + 1, dtype=np.uint8)
        pad[: len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(ones[:-1], dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before ``i``."""
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix over whole numbers from 0 to ``top``."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = range(max(1, int(top).bit_length()) - 1, -1, -1)
        self.levels, self.zeros = [], []
        for b in self.bits:
            one = (values >> b) & 1
            self.levels.append(Bits(one))
            self.zeros.append(int(len(values) - one.sum()))
            values = np.concatenate((values[one == 0], values[one == 1]))
        self.first = self.walk(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))

    def walk(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, level, zeros in zip(self.bits, self.levels, self.zeros, strict=True):
            ones = level.rank(i)
            i = np.where((value >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, value: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Number of ``value`` before ``i``."""
        return self.walk(value, i) - self.first[value]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at ``i`` and how often it stands before."""
        value = np.zeros(len(i), dtype=np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = level.get(i), level.rank(i)
            value = value * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return value, i - self.first[value]


def suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, whose runs end with 0: each 0 ends a suffix and counts as smaller than the next 0.

    The first words of every suffix are packed into one number; suffixes that are still equal are ordered
    by doubling, those alone.
    """
    n, width = len(text), max(1, int(text.max()).bit_length())
    known = min(n, max(1, 62 // width))
    key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(known):
        word = np.zeros(n, dtype=np.int64)
        word[: n - j] = text[j:]
        key = (key << width) | np.where(alive, word, 0)
        alive &= word != 0
    order = np.argsort(key, kind="stable")  # equal suffixes that end are in the order of their 0
    key = key[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | ~alive[order[1:]]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = head
    size = np.diff(np.concatenate((np.flatnonzero(new), [n])))
    slots = np.flatnonzero(np.repeat(size > 1, size))
    while len(slots):
        mine = order[slots]
        group, after = rank[mine], rank[mine + known]
        by = np.lexsort((after, group))
        order[slots] = mine[by]
        group, after = group[by], after[by]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(slots)])))
        slots = slots[np.repeat(size > 1, size)]
        known *= 2
    return order


class Index:
    """FM-index of a text of word numbers from 1, whose runs end with 0."""

    def __init__(self, text: np.ndarray):
        order, top = suffixes(text), int(text.max())
        self.wavelet = Wavelet(text[order - 1], top)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)  # a walk never leaves its run
        self.kept, self.samples, self.n = Bits(kept.astype(np.uint8)), order[kept], len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all rows of ``phrases``: the rows that occur, with first and last + 1 of their suffixes."""
        at, low = np.arange(len(phrases)), np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[at, j].astype(np.int64)
            both = self.wavelet.rank(np.concatenate((word, word)), np.concatenate((low, high)))
            low, high = self.start[word] + both[: len(at)], self.start[word] + both[len(at) :]
            left = low < high
            at, low, high = at[left], low[left], high[left]
        return at, low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes ``i``."""
        found, open_, steps = np.zeros(len(i), dtype=np.int64), np.arange(len(i)), 0
        while len(open_):
            kept = self.kept.get(i)
            found[open_[kept]] = self.samples[self.kept.rank(i[kept])] + steps
            open_, i = open_[~kept], i[~kept]
            word, before = self.wavelet.access(i)
            i, steps = self.start[word] + before, steps + 1
        return found


@dataclass
class Phrases:
    """A block of benchmark slices: numbers of the words, the slices one after another (0 between), phrases by length."""

    number: dict[bytes, int]
    text: np.ndarray
    starts: dict[int, np.ndarray]
    owners: dict[int, np.ndarray]
    items: list[str | None]

    @classmethod
    def of(cls, slices: list[tuple[str | None, list[str]]]) -> Phrases:
        number, text, starts, owners, items, known = {}, [], {}, {}, [], {}
        for item, words in slices:
            if item not in known:
                known[item] = len(items)
                items.append(item)
            length = min(WINDOW, len(words))
            for k in range(len(words) - length + 1):
                starts.setdefault(length, []).append(len(text) + k)
                owners.setdefault(length, []).append(known[item])
            text += [number.setdefault(w.encode(), len(number) + 1) for w in words]
            text.append(0)
        arrays = [{length: np.array(v, dtype=np.int32) for length, v in d.items()} for d in (starts, owners)]
        return cls(number, np.array(text, dtype=np.int32), *arrays, items)


class Shard:
    """Documents' words as numbers, the runs among them, and what is found in them."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.docs = phrases, []
        self.shortest, self.longest = min(phrases.starts), max(phrases.starts)
        self.runs: dict[bytes, list[tuple[int, int]]] = {}
        self.words = 0

    def add(self, text: str | None) -> int:
        """Takes a document; returns its number of words."""
        get, words = self.phrases.number.get, words_of(text)
        ids = np.array([get(w, 0) for w in words], dtype=np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        me = len(self.docs)
        self.docs.append(len(words))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            for k in range(a, max(a + 1, b - self.longest + 1), SHARD_WORDS):  # a longer run in overlapping parts
                run = ids[k : min(b, k + SHARD_WORDS + self.longest - 1)]
                if len(run) >= self.shortest:
                    places = self.runs.setdefault(run.tobytes(), [])
                    if not places:
                        self.words += len(run) + 1
                    places.append((me, k))
        return len(words)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of document, first word and end of each span that a phrase has; rows of document and item number."""
        spans, pairs = [np.zeros((0, 3), dtype=np.int64)], [np.zeros((0, 2), dtype=np.int64)]
        if self.runs:
            pieces = [np.frombuffer(r + bytes(4), dtype=np.int32) for r in self.runs]
            text, first = np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])
            copies = np.array([len(p) for p in self.runs.values()])
            place = np.array([q for p in self.runs.values() for q in p], dtype=np.int64)  # of all runs, one after another
            used = np.zeros(len(self.phrases.number) + 1, dtype=np.int64)
            used[text] = 1
            used[0] = 0
            number = np.cumsum(used) * used  # the words of this shard, from 1
            index = Index(number[text])
            have = np.concatenate(([0], np.cumsum(used[self.phrases.text])))
            for length, starts in self.phrases.starts.items():
                ask = np.flatnonzero(have[starts + length] - have[starts] == length)
                if not len(ask):
                    continue
                asked, back = np.unique(number[self.phrases.text[starts[ask][:, None] + np.arange(length)]], axis=0, return_inverse=True)
                back = back.ravel()
                phrase, low, high = index.search(asked)
                phrase, suffix = spread(phrase, low, high - low)
                where = index.locate(suffix)
                run = np.searchsorted(first, where, side="right") - 1
                at, copy = spread(np.arange(len(run)), (np.cumsum(copies) - copies)[run], copies[run])
                doc, begin, phrase = place[copy, 0], place[copy, 1] + (where - first[run])[at], phrase[at]
                spans.append(np.stack((doc, begin, begin + length), axis=1))
                met = np.unique(np.stack((doc, phrase), axis=1), axis=0)
                n_items = np.bincount(back, minlength=len(asked))
                doc, slot = spread(met[:, 0], (np.cumsum(n_items) - n_items)[met[:, 1]], n_items[met[:, 1]])
                pairs.append(np.stack((doc, self.phrases.owners[length][ask[np.argsort(back, kind="stable")]][slot]), axis=1))
        return np.unique(np.concatenate(spans), axis=0), np.unique(np.concatenate(pairs), axis=0)


def spread(value: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value ``n`` times, and beside it the numbers from its start on."""
    return np.repeat(value, n), np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; spans that touch are one."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Search:
    """For ``mapInArrow``: n_words, and spans and items added to those of the passes before."""

    def __init__(self, phrases):
        self.phrases = phrases

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = self.phrases.value
        for batch in batches:
            texts, begin = batch.column("text"), 0
            shard, chars = Shard(phrases), 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                shard.add(text)
                chars += len(text or "")
                if shard.words >= SHARD_WORDS or chars >= SHARD_CHARS:
                    yield self.part(batch.slice(begin, i + 1 - begin), shard)
                    shard, chars, begin = Shard(phrases), 0, i + 1
            if begin < batch.num_rows:
                yield self.part(batch.slice(begin), shard)
        trim()

    def part(self, batch: pa.RecordBatch, shard: Shard) -> pa.RecordBatch:
        spans = [[(s["first"], s["end"]) for s in v] for v in batch.column("spans").to_pylist()]
        items = [set(v) for v in batch.column("items").to_pylist()]
        found, pairs = shard.found()
        for d, a, b in found.tolist():
            spans[d].append((a, b))
        for d, k in pairs.tolist():
            if shard.phrases.items[k] is not None:
                items[d].add(shard.phrases.items[k])
        spans = [[{"first": a, "end": b} for a, b in merged(s)] for s in spans]
        new = {"n_words": pa.array(shard.docs, pa.int64()), "spans": pa.array(spans, SPANS), "items": pa.array([sorted(s) for s in items], pa.list_(pa.string()))}
        return pa.RecordBatch.from_arrays([new.get(name, batch.column(name)) for name in batch.schema.names], names=batch.schema.names)


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def slices_of(benchmark: DataFrame) -> DataFrame:
    """item (id as text) and words of overlapping slices: every phrase of an item stands whole in one of them."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)), F.lit(SLICE))
    return items.select("item", F.explode(F.transform(starts, lambda k: F.slice("words", k + 1, SLICE + WINDOW - 1))).alias("words"))


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_words, spans (first and end of the merged runs of hit words) and items (ids as text, sorted).

    The columns of ``docs`` other than ``doc_id`` and ``text`` are left out.
    """
    spark = docs.sparkSession
    slices = materialize(slices_of(benchmark), "benchmark-slices")
    total = slices.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_WORDS))
    empty: list[Column] = [F.lit(None).cast("long").alias("n_words"), F.array().cast("array<struct<first:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items")]
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"), *empty)
    if not total:
        lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return frame.withColumn("n_words", F.coalesce(F.regexp_count(lower, F.lit(WORD)), F.lit(0)).cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_words long, spans array<struct<first:long,end:long>>, items array<string>"
    for b in range(blocks):
        own = slices.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        held = Phrases.of([(r["item"], r["words"]) for r in own.collect()])  # about BLOCK_WORDS words
        if held.starts:
            frame = frame.mapInArrow(Search(spark.sparkContext.broadcast(held)), schema)
            if b < blocks - 1:
                frame = materialize(frame, f"decontaminated-{b}")
    return frame


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans of every document.

    A word is hit if it lies in an occurrence of any ten consecutive words of an item, or of a whole
    item with fewer.  Null and empty texts have no words and are not hit; rows with equal ids are
    looked at each on their own and null ids stay.  Items without words occur nowhere.  Items with
    one id count once; texts of items with a null id hit words, but are no item in ``n_items`` and
    ``items_sha256``.  An empty table gives an empty result; an empty benchmark hits nothing; other
    columns are ignored.
    """
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return marked(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans"
    )


class Cut:
    """For ``mapInArrow``: texts without the characters from the first to the last word of each span."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                whole = text.as_py()
                if len(spans):
                    places = [m.span() for m in _SPELLED.finditer(whole)]
                    at, left = 0, []
                    for s in spans.as_py():
                        left.append(whole[at : places[s["first"]][0]])
                        at = places[s["end"] - 1][1]
                    whole = "".join([*left, whole[at:]])
                out.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and text of every document, without the spans that ``decontaminate`` finds; null texts stay null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked(docs, benchmark).mapInArrow(Cut(), f"doc_id {kind}, text string")
