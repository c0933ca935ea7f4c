"""Language identification by the nearest centroid.

A text becomes a normalised TF-IDF vector of hashed letter bigrams and
trigrams.  Each language has several centroids, found by spherical k-means on
a bounded sample of labelled rows; a text gets the language of the centroid
with the largest cosine, and is rejected if it is too far even from that one.
How far is too far depends on the evidence: cosines grow with the number of
n-grams, so a language has a limit for each class of that number (powers of
two), from beginnings of the sample's texts against centroids fitted without
them.

Document frequencies are counted over all labelled training rows.  The sample
has at most ``SAMPLE_PER_LANG`` rows of each language (one for each hash
bucket, so a language with a third of all rows weighs no more in any task), of
the ``MOST_LANGS`` languages with the most rows.  Each language is fitted in a
task of its own; the driver gets a few centroids per language only, so the
model is small whatever the corpus size and however many values ``lang`` has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneline.llm.common import cut, held_out, map_texts

#: Hash buckets of n-grams.
DIM = 4096
#: Labelled rows of each language that the centroids are fitted on, at most.
SAMPLE_PER_LANG = 256
#: Languages that are learned, at most: those with the most labelled rows, ties to the first by code point.
MOST_LANGS = 1024
#: Centroids of each language.
CENTROIDS = 4
#: A text is rejected below this share of the cosine that 99.5 % of the sample of its class reaches.
REJECT_SHARE = 0.85
#: Classes of the number of n-grams (powers of two); one with fewer texts than LEAST_CLASS has the limit of the class below (only what is rejected depends on it).
CLASSES, LEAST_CLASS = 32, 20
#: Parts of the sample: the limits of each come from centroids of the others.
FOLDS = 4
#: Code points turned into vectors at once.
CHUNK = 1 << 19

UNDETERMINED = "und"

#: Classes of the code points: 0 is no letter, all else the (lower-case) letter itself.
_LETTER = np.array([c if chr(c).isalpha() else 0 for c in range(0x3000)], dtype=np.uint32)


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, with 0 for everything else."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if codes.size and codes.max() >= 0x3000:
        far = codes >= 0x3000
        table = {int(c): int(c) if chr(c).isalpha() else 0 for c in np.unique(codes[far])}
        out = _LETTER[np.where(far, 0, codes)]
        out[far] = [table[int(c)] for c in codes[far]]
        return out
    return _LETTER[codes]


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts (rows x DIM, float32) and whether a text has a letter; a text is cut into chunks that are summed."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    has = np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        for k in range(0, len(text), CHUNK):
            a = letters(text[max(0, k - 2) : k + CHUNK])
            if not a.any():
                continue
            has[i] = True
            # Later chunks begin with two letters of the one before; the text's own ends are padded.
            p = np.concatenate(([0, 0][: 2 * (k == 0)], a, [0][: k + CHUNK >= len(text)])).astype(np.uint32)
            two = (p[:-1] * np.uint32(0x9E3779B1)) ^ (p[1:] * np.uint32(0x85EBCA6B))
            three = (two[:-1] * np.uint32(0xC2B2AE35)) ^ (p[2:] * np.uint32(0x27D4EB2F))
            pair = (p[:-1] | p[1:]) != 0
            pair[: k > 0] = False  # counted with the chunk before
            for h, keep in ((two, pair), (three, p[1:-1] != 0)):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                out[i] += np.bincount((h >> np.uint32(20))[keep], minlength=DIM)
    return out, has


def evidence(x: np.ndarray) -> np.ndarray:
    """Class of the number of n-grams of each row of counts."""
    return np.clip(np.log2(np.maximum(x.sum(axis=1, dtype=np.float64), 1.0)).astype(int), 0, CLASSES - 1)


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, has = counts(texts)
    size = evidence(x)
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9), has, size


@dataclass
class Model:
    """langs[i] is the language of row i of ``centroids``, least[i] its limits by class of evidence."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray
    fallback: str

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine with its nearest centroid (0 to 1), rejected."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        x, has, size = vectors(texts, self.idf)
        cosines = x @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0).astype(float)
        score[~has] = 0.0
        langs = [(self.langs[b] if s > 0 else self.fallback) if h else UNDETERMINED for b, h, s in zip(best, has, score, strict=True)]
        return langs, score, ~has | (score < self.least[best, size])


def _partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document frequencies of what a task has read: one row for each bucket; bucket -1 counts the documents."""
    total, rows = np.zeros(DIM, dtype=np.int64), 0
    for batch in batches:
        for k in range(0, len(batch), 256):
            x, has = counts(batch["text"].iloc[k : k + 256].tolist())
            total += (x > 0).sum(axis=0)
            rows += int(has.sum())
    yield pd.DataFrame({"bucket": np.arange(-1, DIM), "n": np.concatenate(([rows], total))})


def _sample_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), 256):
            part = batch.iloc[k : k + 256]
            for doc, lang, text in zip(part["doc_id"].astype(str), part["lang"], part["text"], strict=True):
                ends = [n for n in (8 << i for i in range(CLASSES)) if n < len(text)]
                whole = [False] * len(ends) + [True]
                rows = []
                for n, w in zip([*ends, len(text)], whole, strict=True):
                    x, has = counts([text[:n]])
                    if has[0]:
                        rows.append((lang, doc, w, np.flatnonzero(x[0]).astype("<u2").tobytes(), x[0][x[0] > 0].astype("<f4").tobytes()))
                yield pd.DataFrame(rows, columns=["lang", "doc", "whole", "at", "n"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        new = [x[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]
        centres = np.stack([v / max(np.linalg.norm(v), 1e-9) for v in new])
    return centres


def limits(near: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least cosine of each class of evidence."""
    out = np.full(CLASSES, np.nan)
    for c in range(CLASSES):
        if (size == c).sum() >= LEAST_CLASS:
            out[c] = REJECT_SHARE * float(np.quantile(near[size == c], 0.005))
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):  # a small sample: one limit
        return np.full(CLASSES, REJECT_SHARE * float(np.quantile(near, 0.005)))
    below = np.searchsorted(known, np.arange(CLASSES), side="right") - 1
    return np.where(below >= 0, out[known[np.maximum(below, 0)]], min(out[known[0]], REJECT_SHARE * float(near.min())))


def fit(train: DataFrame) -> Model:
    """Model from ``train`` (doc_id, text, lang); rows without language or letters teach nothing."""
    rows = train.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    totals = rows.select("text").mapInPandas(_partials, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1)
    for r in totals:  # DIM + 1 rows
        df[r["bucket"] + 1] = r["n"]
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1.0).astype(np.float32)

    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ids = cut(
        hashed.groupBy("lang", F.pmod("h", F.lit(SAMPLE_PER_LANG)).alias("b"))
        .agg(F.min(F.struct("h", "doc_id")).alias("m"), F.count("*").alias("n"))
        .select("lang", F.col("m.doc_id").alias("doc_id"), "n")
    )
    most = ids.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).select("lang")
    ids = cut(ids.join(F.broadcast(most), "lang", "left_semi").select("lang", "doc_id"))  # MOST_LANGS * SAMPLE_PER_LANG rows
    sample = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    sample = sample.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # of an id that is repeated, one row
    counted = sample.select("doc_id", "lang", "text").mapInPandas(_sample_counts, "lang string, doc string, whole boolean, at binary, n binary")
    got = counted.groupBy("lang").applyInPandas(fit_language(idf), "lang string, rows long, centroids binary, least binary").collect()  # MOST_LANGS rows of CENTROIDS vectors
    got.sort(key=lambda r: r["lang"])
    centroids = [np.frombuffer(r["centroids"], "<f4").reshape(-1, DIM) for r in got]
    langs = [r["lang"] for r, c in zip(got, centroids, strict=True) for _ in c]
    least = [np.frombuffer(r["least"], "<f8") for r, c in zip(got, centroids, strict=True) for _ in c]
    largest = min(got, key=lambda r: -r["rows"])["lang"] if got else UNDETERMINED
    return Model(idf, np.concatenate(centroids) if got else np.zeros((0, DIM), np.float32), langs, np.array(least).reshape(-1, CLASSES), largest)


def fit_language(idf: np.ndarray):
    """For ``applyInPandas`` over the counted sample of a language (SAMPLE_PER_LANG texts and their beginnings): its centroids and limits."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(length=own["at"].str.len()).sort_values(["doc", "whole", "length", "at"], kind="stable")
        x = np.zeros((len(own), DIM), dtype=np.float32)
        for i, (at, n) in enumerate(zip(own["at"], own["n"], strict=True)):
            x[i, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<f4")
        size = evidence(x)
        x = np.log1p(x) * idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        whole = own["whole"].to_numpy(dtype=bool)
        fold = np.array([zlib.crc32(d.encode()) % FOLDS for d in own["doc"]])
        centres = spherical_kmeans(x[whole], CENTROIDS)
        near = (x @ centres.T).max(axis=1)
        for k in range(FOLDS):
            if (fold == k).any() and (whole & (fold != k)).any():
                near[fold == k] = (x[fold == k] @ spherical_kmeans(x[whole & (fold != k)], CENTROIDS).T).max(axis=1)
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "rows": [int(whole.sum())], "centroids": [centres.astype("<f4").tobytes()], "least": [limits(near, size).astype("<f8").tobytes()]})

    return one


class Predict:
    """For :func:`map_texts`."""

    def __init__(self, model):
        self.model = model

    def __call__(self, texts: list[str | None]):
        return self.model.value.predict(texts)


class Keep:
    """For ``mapInArrow``: the rows whose text is not rejected, with the language found."""

    def __init__(self, model):
        self.model = model

    def __call__(self, batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                langs, _, rejected = self.model.value.predict(part.column("text").to_pylist())
                at = part.schema.get_field_index("lang")
                part = part.set_column(at, part.schema.field(at), pa.array(langs, type=part.schema.field(at).type))
                yield part.filter(pa.array(~rejected))


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and rejected for every row of ``docs``.

    Only the text counts.  A null text, or one without a letter, is ``und`` with score 0 and
    rejected; so is every text if there is nothing to learn from.  A text with letters gets the
    nearest language even if it is rejected as too far from all.  Equal cosines go to the
    language first by code point.  Repeated rows give repeated results, null ids stay null,
    other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(train))
    return map_texts(docs, Predict(model), {"lang_pred": "string", "score": "double", "rejected": "boolean"})


def identify_table(docs: DataFrame) -> DataFrame:
    """:func:`identify`, learning from the four fifths of ``docs`` that are not held out."""
    found = identify(docs, docs.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns and ``lang`` as found, whose language is not rejected."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out())))
    return docs.mapInArrow(Keep(model), docs.schema)
