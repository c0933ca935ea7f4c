"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded by statistics of its
characters and words and a small learned layer; a gated attention gives each
passage a weight; the weighted mean of the encodings is scored.  Only document
labels are needed: the attention learns which passages tell.

Training uses a bounded sample of labelled rows (``SAMPLE_PER_CLASS`` of each
label, one for each hash bucket) and of a very long one ``SAMPLE_PASSAGES``
passages spread over it, so that what the driver holds follows neither the
number of rows nor their length.  Scoring is a map over whole texts; no text
is cut off, long ones just have more passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneline.llm.common import checked_broadcast, cut, held_out, map_texts

#: Code points of a passage.
PASSAGE = 400
#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 1500
#: Passages of each of these rows that the model is fitted on, at most: evenly spread over the whole text.
SAMPLE_PASSAGES = 256
#: Width of the passage encoding and of the attention.
HIDDEN, ATTENTION = 16, 8
#: Score from which a document counts as good.
THRESHOLD = 0.3
#: Hash buckets of neighbouring characters, by which repetition within a passage is seen.
BUCKETS = 256
#: Code points worked on at once.
CHUNK = 1 << 20

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _QUOTE, _BRACKET, _SYMBOL, _OTHER = range(10)
_KINDS = 10
FEATURES = _KINDS + 8


def _kinds() -> np.ndarray:
    table = np.full(0x3000, _OTHER, dtype=np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        if ch == "\n":
            table[c] = _LINE
        elif ch.isspace():
            table[c] = _SPACE
        elif ch.isupper():
            table[c] = _UPPER
        elif ch.isalpha():
            table[c] = _LOWER
        elif ch.isdigit():
            table[c] = _DIGIT
        elif ch in ".,;:?":
            table[c] = _STOP
        elif ch in "'\"-’“”«»":
            table[c] = _QUOTE
        elif ch in "()[]{}<>/|\\":
            table[c] = _BRACKET
        elif c < 0x100:
            table[c] = _SYMBOL
    return table


_KIND = _kinds()


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each text; an empty or null text has one empty passage."""
    found, sizes = [], np.ones(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        n = 0
        for k in range(0, max(1, len(text or "")), CHUNK):
            f = _chunk_features((text or "")[k : k + CHUNK])
            found.append(f)
            n += len(f)
        sizes[i] = n
    return (np.concatenate(found) if found else np.zeros((0, FEATURES), np.float32)), sizes


def _chunk_features(text: str) -> np.ndarray:
    if not text:
        return np.zeros((1, FEATURES), dtype=np.float32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = -(-len(codes) // PASSAGE)
    if n > 1 and len(codes) - (n - 1) * PASSAGE < PASSAGE // 2:
        n -= 1  # a short rest joins the last passage
    own = np.minimum(np.arange(len(codes)) // PASSAGE, n - 1)
    kind = _KIND[np.minimum(codes, 0x2FFF)]
    size = np.bincount(own, minlength=n).astype(np.float32)
    by_kind = np.bincount(own * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float32)
    out = np.empty((n, FEATURES), dtype=np.float32)
    out[:, :_KINDS] = by_kind / size[:, None]
    # Words: their number, length and spread of length; a word equal to the one before it.
    gap = (kind == _SPACE) | (kind == _LINE)
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
    words = np.zeros(n, dtype=np.float32)
    mean = np.zeros(n, dtype=np.float32)
    spread = np.zeros(n, dtype=np.float32)
    same = np.zeros(n, dtype=np.float32)
    capital = np.zeros(n, dtype=np.float32)
    odd = np.zeros(n, dtype=np.float32)
    if len(starts):
        at, length = own[starts], np.minimum(ends - starts, 60).astype(np.float32)
        words = np.bincount(at, minlength=n).astype(np.float32)
        per = np.maximum(words, 1)
        mean = np.bincount(at, length, n).astype(np.float32) / per
        spread = np.sqrt(np.maximum(np.bincount(at, length * length, n).astype(np.float32) / per - mean * mean, 0))
        mixed = np.cumsum(np.concatenate(([0], (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20))), dtype=np.uint64)
        key = mixed[ends] - mixed[starts]
        same = np.bincount(at[1:], key[1:] == key[:-1], n).astype(np.float32) / per
        capital = np.bincount(at, kind[starts] == _UPPER, n).astype(np.float32) / per
        odd = np.bincount(at, kind[ends - 1] == _SYMBOL, n).astype(np.float32) / per
    pair = ((codes[:-1] * np.uint32(31) + codes[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    seen = np.bincount(own[1:] * BUCKETS + pair, minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, _KINDS:] = np.stack(
        [np.log1p(size) / 6, words / np.maximum(size, 1) * 5, mean / 10, spread / 5, same, capital, odd, (seen > 0).sum(axis=1) / np.minimum(size, BUCKETS)], axis=1
    )
    return out


def _segment_sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first, axis=0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    prior: float

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        a = np.exp(e - np.maximum.reduceat(e, first)[doc])
        a /= _segment_sum(a, first)[doc]
        z = _segment_sum(a[:, None] * h, first)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": s, "first": first, "doc": doc}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.p:
            return np.full(len(texts), self.prior)
        # The order of sums depends on the texts scored together; the digits it touches are rounded off.
        return np.round(self.forward(*passages(texts))["s"].astype(float), 12)


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 60, batch: int = 256, seed: int = 11) -> Model:
    """Adam on the weighted log loss; gradients written out."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float64)
    p = {"W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}
    model = Model(mean, scale, p, float((y * weight).sum() / max(weight.sum(), 1e-9)))
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            ids = order[k : k + batch]
            rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in ids])
            f = model.forward(x[rows], sizes[ids])
            d_s = (f["s"] - y[ids]) * weight[ids] / weight[ids].sum()
            grad = {"c": f["z"].T @ d_s, "d": np.array([d_s.sum()])}
            d_z = d_s[:, None] * p["c"]
            doc, a, h = f["doc"], f["a"], f["h"]
            d_h = a[:, None] * d_z[doc]
            d_a = (d_z[doc] * h).sum(axis=1)
            d_e = a * (d_a - _segment_sum(a * d_a, f["first"])[doc])
            grad["w"] = (f["t"] * f["g"]).T @ d_e
            d_t = d_e[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
            d_g = d_e[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
            grad["V"], grad["U"] = h.T @ d_t, h.T @ d_g
            d_h += d_t @ p["V"].T + d_g @ p["U"].T
            d_pre = d_h * (1 - h**2)
            grad["W"], grad["b"] = f["x"].T @ d_pre, d_pre.sum(axis=0)
            step += 1
            for name, g in grad.items():
                g = g + 1e-5 * p[name]
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.999 * m2[name] + 0.001 * g * g
                p[name] -= rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
    return model


def spread(x: np.ndarray) -> np.ndarray:
    """Rows of ``x``, ``SAMPLE_PASSAGES`` at most, the first and the last among them."""
    return x if len(x) <= SAMPLE_PASSAGES else x[np.linspace(0, len(x) - 1, SAMPLE_PASSAGES).round().astype(int)]


def _sample_passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), 64):
            part = batch.iloc[k : k + 64]
            x, sizes = passages(part["text"].tolist())
            cuts = [spread(c) for c in np.split(x.astype("<f2"), np.cumsum(sizes)[:-1])]
            yield pd.DataFrame({"doc_id": part["doc_id"], "quality": part["quality"], "x": [c.tobytes() for c in cuts]})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the texts of ``docs`` (doc_id, text) whose rows in ``labels`` (doc_id, quality) are 0 or 1."""
    marks = labels.select("doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    ids = cut(
        marks.groupBy("quality", F.pmod("h", F.lit(SAMPLE_PER_CLASS)).alias("bucket"))
        .agg(F.min(F.struct("h", "doc_id")).alias("m"))
        .select(F.col("m.doc_id").alias("doc_id"), "quality")
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL").join(checked_broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # of an id that is repeated, one row
    got = rows.select("doc_id", "text", "quality").mapInPandas(_sample_passages, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x binary").toPandas()  # 2 x SAMPLE_PER_CLASS rows of SAMPLE_PASSAGES passages at most
    y = got["quality"].to_numpy(dtype=float)
    if len(got) == 0 or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(y[0]) if len(got) else 0.5)
    got = got.sort_values(["doc_id", "quality"]).reset_index(drop=True)
    y = got["quality"].to_numpy(dtype=float)
    xs = [np.frombuffer(b, "<f2").reshape(-1, FEATURES).astype(float) for b in got["x"]]
    # The sample is balanced by bucket; weights bring back the share of each class among all labels.
    share = dict(marks.groupBy("quality").count().collect())  # two rows
    weight = np.array([share[int(q)] / (y == q).sum() for q in y])
    return train(np.concatenate(xs), np.array([len(v) for v in xs]), y, weight / weight.mean())


class Score:
    """For :func:`map_texts`."""

    def __init__(self, model):
        self.model = model

    def __call__(self, texts: list[str | None]):
        return [self.model.value.score(texts)]


def score(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``.

    Only the text counts.  A null text is scored as an empty one.  Without labels of both
    classes every score is the share of label 1 (0.5 without any).  Repeated rows give
    repeated results, null ids stay null, other columns are ignored; a document with two
    different labels teaches both.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(train_docs, labels))
    return map_texts(docs, Score(model), {"score": "double"}, step=64)


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`score` learning from the labels that are not held out, with the verdict at ``THRESHOLD``."""
    found = score(docs, docs, labels.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
