"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from sceneline.llm import jaccard, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * inter >= num * (len(sets[i]) + len(sets[j]) - inter):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(ids[find(i)]) if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed, n_base=40, edits=12, words=400):
    """Bases of many lengths, near copies at every distance, copies, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    texts = [None, "", "  \n", "One", "one", "one two", "One  two ", "a b c", "a b c d"]
    for _ in range(n_base):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 12, 20, 40, 80, 200, 400]))]
        texts.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(edits)):
                at = rng.randrange(len(v))
                v[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [v[at], rng.choice(vocabulary)]])
                v = v or ["x"]
            texts.append((" " if rng.random() < 0.5 else "\t").join(v))
        if rng.random() < 0.3:
            texts += [texts[-1].upper()] * 3
    # One large group of near copies of one text, far and near from each other.
    w = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(70):
        v = list(w)
        for _ in range(rng.randrange(6)):
            v[rng.randrange(len(v))] = rng.choice(vocabulary)
        texts.append(" ".join(v))
    return [(1000 + i * 7 % 991, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_equals_brute_force(spark, k, num, den):
    rows = corpus(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.join_components(docs, k, num, den).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, k, num, den)


def test_frequent_signatures(spark):
    """Small limits, so that combining within a task, stars and blocks are all used; linked and unlinked members."""
    rows = corpus(9, n_base=5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in jaccard.Join(docs, 3, 85, 100, small=2, block=8).classes().select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, 3, 85, 100)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join_components(empty).count() == 0
    rows = [(5, "x y z w"), (5, "x y z w"), (None, "x y z w"), (2, None), (3, None)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, component_id string, node int")
    got = sorted(((r[0] is None, r[0] or 0), r[1], r[2]) for r in jaccard.join_components(docs).collect())
    assert [(g[1], g[2]) for g in got] == [(0, 2), (0, 3), (2, 5), (2, 5), (2, 5)]
    kept = jaccard.keep_one(docs, 3, 90, 100)
    assert kept.columns == docs.columns
    assert kept.count() == 5


def test_link_through_rows_without_id(spark):
    """Texts a - b - c, of which only b links with both others, and b has no id."""
    w = [f"w{i}" for i in range(200)]
    texts = [" ".join(w), " ".join([*w[:190], *[f"x{i}" for i in range(10)]]), " ".join([*w[:180], *[f"y{i}" for i in range(10)], *[f"x{i}" for i in range(10)]])]
    assert [c for _, _, c in brute(list(enumerate(texts)), 3, 88, 100)] == [0, 0, 0]
    assert [c for _, _, c in brute([(0, texts[0]), (2, texts[2])], 3, 88, 100)] == [0, 2]
    docs = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2])], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in jaccard.join_components(docs, 3, 88, 100).collect())
    assert got == [(0, 1), (0, 1), (1, 1), (3, 1)]


def near_copies(n, edits, seed=0, words=120):
    rng = np.random.default_rng(seed)
    base = shingles.mix(rng.integers(1, 2**60, words).astype(np.uint64))
    sets = []
    for _ in range(n):
        s = base.copy()
        at = rng.choice(words, edits, replace=False)
        s[at] = shingles.mix(rng.integers(1, 2**60, edits).astype(np.uint64))
        sets.append(s)
    return sets


@pytest.mark.parametrize(("n", "edits"), [(200, 3), (1000, 3), (200, 7), (1000, 7)])
def test_pairs_of_a_group_grow_with_its_size(n, edits):
    """A block of near copies that all link, or hardly any, gives no more pairs than it has nodes."""
    sets = near_copies(n, edits)
    at = np.repeat(np.arange(n), [len(s) for s in sets])
    maps = shingles.bitmaps(at, np.concatenate(sets), np.array([len(s) for s in sets]))
    rows = pd.DataFrame({"sig": 5, "lo": 0, "hi": 0, "block": 0, "node": np.arange(n), "root": np.arange(n), "n": 120, "bits": maps, "carried": [[]] * n})
    forest = jaccard.CompareBlocks(90, 100, True)(rows)
    every = jaccard.CompareBlocks(90, 100, False)(rows)
    assert len(forest) < n
    # The forest connects what all pairs connect, so with its roots nothing is left to compare.
    root = np.arange(n)
    for _ in range(n):
        low = np.minimum(root[forest["a"]], root[forest["b"]])
        new = root.copy()
        np.minimum.at(new, forest["a"], low)
        np.minimum.at(new, forest["b"], low)
        if (new == root).all():
            break
        root = new
    assert (root[every["a"]] == root[every["b"]]).all()
    assert len(jaccard.CompareBlocks(90, 100, False)(rows.assign(root=root))) == 0


@pytest.mark.parametrize("more", [0, 3, 30])
@pytest.mark.parametrize("twos", [0, 1, 3])
def test_pigeonhole(twos, more):
    """Sets that differ in no more than allowed share a signature, whatever the split into ones and twos."""
    rng = np.random.default_rng(twos)
    need = jaccard.difference(60, 90, 100) + 1
    scheme = [jaccard.Scheme(1, 39, 0, 0, 0), jaccard.Scheme(40, 60, need - 2 * twos + more, twos, need - 2 * twos)]
    for _ in range(200):
        base = shingles.mix(rng.integers(1, 2**60, 60).astype(np.uint64))
        drop = int(rng.integers(0, need))
        other = np.concatenate((base[: 60 - drop // 2], shingles.mix(rng.integers(1, 2**60, (drop - drop // 2) // 2).astype(np.uint64))))
        found = []
        for i, s in enumerate((base, other)):
            at = np.zeros(len(s), dtype=np.int64)
            found.append(set(jaccard.signatures(scheme, 90, 100, at, s, np.array([len(s)]), np.array([i]))[0].tolist()))
        assert found[0] & found[1]


def test_long_texts_are_whole(monkeypatch):
    """Cut into pieces or not, a text has the same words."""
    text = " ".join(f"w{i % 977}é" for i in range(5000)) + "\n" + "x" * 3000 + "\tend"
    whole = shingles.token_sets([text, "a b"], 3)
    monkeypatch.setattr(shingles, "CHUNK", 512)
    cut = shingles.token_sets([text, "a b"], 3)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    assert whole[2][0] == len(shingle_set(text, 3))


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)
    for n, m in ((10, 12), (400, 600), (700, 2000), (3000, 3100)):
        pool = shingles.mix(rng.integers(1, 2**60, 4000).astype(np.uint64))
        sets = [rng.choice(pool, k, replace=False) for k in (n, m)]
        at = np.repeat([0, 1], [n, m])
        maps = shingles.bitmaps(at, np.concatenate(sets), np.array([n, m]))
        words = min(map(len, maps)) // 8
        bits = int(np.bitwise_count(shingles.folded(maps[0], words) ^ shingles.folded(maps[1], words)).sum())
        assert bits <= len(set(sets[0].tolist()) ^ set(sets[1].tolist()))
        assert len(maps[0]) * 8 >= n and (shingles.folded(maps[1], 4) == shingles.folded(shingles.folded(maps[1], 8).tobytes(), 4)).all()
