"""Decontamination against a plain search for every phrase; the index against plain ranks and suffixes."""

import hashlib
import random
import re

import numpy as np
import pytest

from sceneline.llm import fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    phrases = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit |= set(range(k, k + n))
                    found |= phrases[tuple(w[k : k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, -1, "x") for r in docs], "doc_id long, text string, n_words int, spans string").repartition(3)
    return d, spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, items int")


def got(spark, docs, items):
    return sorted(str(tuple(r)[:6]) for r in fmindex.decontaminate(*frames(spark, docs, items)).collect())


def corpus(seed, vocabulary, n_docs=120):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 40, 90]))) for k in range(12)]
    items += [(3, items[5][1]), (None, text(25)), (20, ""), (21, None), (22, "--- ..."), (23, items[7][1].upper())]
    docs = []
    for k in range(n_docs):
        parts = [text(rng.randrange(0, 60))]
        if k % 3 == 0:
            parts.append("; ".join(rng.choice(items[:13])[1].split()))
        if k % 7 == 0:
            parts.append("Ünknown ÉTÉ " + text(5))
        docs.append((k, " ".join([*parts, text(rng.randrange(0, 9))])))
    docs += [(500, None), (501, ""), (502, "?!"), (None, docs[3][1]), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(600 + k, docs[0][1]) for k in range(40)]  # exact copies
    docs += [(700, items[6][1] + " " + items[6][1]), (701, text(3000) + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("vocabulary", [["a", "b"], list("abcdefgh"), [f"w{k}" for k in range(300)]])
def test_same_as_plain(spark, monkeypatch, vocabulary):
    docs, items = corpus(len(vocabulary), vocabulary)
    if len(vocabulary) < 8:  # else everything is hit by the items of one word
        items = [i for i in items if len(words(i[1])) > 8]
    want = plain(docs, items)
    assert got(spark, docs, items) == want
    monkeypatch.setattr(fmindex, "SHARD_WORDS", 64)
    monkeypatch.setattr(fmindex, "SHARD_CHARS", 2000)
    assert got(spark, docs, items) == want
    monkeypatch.setattr(fmindex, "SLICE", 7)
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", 150)  # several passes
    assert got(spark, docs, items) == want


def test_edges(spark):
    docs, items = corpus(1, list("abc"), 9)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, [], items) == [] and got(spark, [], []) == []
    assert got(spark, [(1, "one two"), (2, None)], []) == [str((1, 2, 0, 0, empty, False)), str((2, 0, 0, 0, empty, False))]
    assert got(spark, [(1, "One Two")], [(4, "."), (5, None)]) == [str((1, 2, 0, 0, empty, False))]
    assert got(spark, [(1, "x ONE-two y")], [(4, "one two")]) == plain([(1, "x ONE-two y")], [(4, "one two")])


def test_remove(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = [(1, f"Before: «{item.title()}», after."), (2, "nothing here"), (3, None), (4, item), (5, "the quick brown fox")]
    left = {r["doc_id"]: r["text"] for r in fmindex.remove(*frames(spark, docs, [(9, item)])).collect()}
    # « and » are word characters (not ASCII), so the phrase is found from its second word to its last but one
    assert left == {1: "Before: «The  Again», after.", 2: "nothing here", 3: None, 4: "", 5: "the quick brown fox"}


@pytest.mark.parametrize("top", [1, 2, 5, 200])
def test_index(top):
    """Ranks, suffix order, search and places against plain ones, also for repeated runs and one long run."""
    rng = np.random.default_rng(top)
    runs = [rng.integers(1, top + 1, n) for n in (1, 2, 30, 700)] + [np.ones(200, dtype=np.int64)] * 3
    runs += [runs[3], runs[3][:-1]]
    text = np.concatenate([np.concatenate((r, [0])) for r in runs])
    order = fmindex.suffixes(text)
    ends = np.flatnonzero(text == 0)
    key = lambda i: (text[i : ends[np.searchsorted(ends, i)]].tolist() + [0], i)
    assert order.tolist() == sorted(range(len(text)), key=key)
    wavelet = fmindex.Wavelet(text, int(text.max()))
    at = rng.integers(0, len(text) + 1, 50)
    for v in {1, int(text.max()), 0}:
        assert wavelet.rank(np.full(50, v), at).tolist() == [int((text[:i] == v).sum()) for i in at]
    value, before = wavelet.access(np.arange(len(text)))
    assert (value == text).all() and before.tolist() == [int((text[:i] == text[i]).sum()) for i in range(len(text))]
    index = fmindex.Index(text)
    for n in (1, 2, 6):
        asked = np.unique(np.array([text[i : i + n] for i in range(0, len(text) - n, 17) if (text[i : i + n] > 0).all()] + [np.full(n, 1)]), axis=0)
        rows, low, high = index.search(asked)
        found = {r: sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(rows.tolist(), low.tolist(), high.tolist(), strict=True)}
        for r, phrase in enumerate(asked):
            assert found.get(r, []) == [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrase).all()]
