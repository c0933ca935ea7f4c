"""Centroid clustering and vector codes against plain versions of Lloyd's algorithm."""

import hashlib

import numpy as np
import pytest

from sceneline.llm import codebooks, common, sortmeans

INF, NAN = float("inf"), float("nan")


def nearest(v, entries):
    return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), c) for c, e in enumerate(entries))


def lloyd(rows, entries, rounds):
    """(distance, entry) of each row, and the entries."""
    for _ in range(rounds):
        own = [nearest(v, entries)[1] for v in rows]
        groups = {c: [v for v, o in zip(rows, own, strict=True) if o == c] for c in set(own)}
        entries = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else e for c, e in enumerate(entries)]
    return [nearest(v, entries) for v in rows], entries


def table(dim, n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = (np.round(rng.normal(0, 0.4, (n, dim)) * 8) / 8).astype(np.float32)  # few values: many equal distances
    x[50:200] = x[50]
    x[300:310] *= 50
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    rows[3] = (3, None)
    rows[4] = (4, [*rows[4][1][1:], NAN])
    rows[5] = (5, [*rows[5][1][1:], None])
    rows[6] = (6, [*rows[6][1][1:], -INF])
    rows[7] = (7, [])
    return [*rows, (None, rows[60][1]), (9, rows[9][1]), (9, rows[10][1])]


def sound(rows, scale, dim):
    return [(i, [int(np.floor(scale * e)) for e in v]) for i, v in rows if v and len(v) == dim and all(e is not None and np.isfinite(e) for e in v)]


def frame(spark, rows, extra=0):
    label = lambda k: [None, 1, 2, 7][k % 4]
    rows = [(*r, label(k), "clash", k) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, cluster int").repartition(3)


def plain_clusters(rows, dim, k, rounds):
    kept = sound(rows, 1024, dim)
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    found, centroids = lloyd([v for _, v in kept], [v for _, v in order[:k]], rounds)
    inertia = {c: sum(d for d, o in found if o == c) for c in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, found, strict=True)]


@pytest.mark.parametrize(("dim", "k", "rounds"), [(8, 8, 5), (3, 5, 3), (2, 30, 4)])
def test_sort_means(spark, monkeypatch, dim, k, rounds):
    monkeypatch.setattr(sortmeans, "BLOCK", 37)
    rows = table(dim)
    got = sorted(map(str, map(tuple, sortmeans.cluster_table(frame(spark, rows), k, rounds, dim).collect())))
    assert got == sorted(map(str, plain_clusters(rows, dim, k, rounds)))


def test_sort_means_edges(spark):
    assert sortmeans.cluster_table(frame(spark, [])).count() == 0
    assert sortmeans.cluster_table(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    same = [(i, [0.5] * 64) for i in range(20)]  # one point: equal centroids, all rows in the first
    assert [tuple(r)[1:5] for r in sortmeans.cluster_table(frame(spark, same)).collect()] == [(0, 0, 0, 0)] * 20
    assert {r["cluster"] for r in sortmeans.cluster_table(frame(spark, same[:3])).collect()} == {0}
    with pytest.raises(Exception, match="too large"):
        sortmeans.cluster_table(frame(spark, [(1, [1e20] * 64), (2, [0.0] * 64)])).collect()


def test_sort_means_skips(spark):
    """Of well separated clusters most distances are never computed."""
    rng = np.random.default_rng(0)
    centroids = rng.integers(-100_000, 100_000, (40, 6))
    own = rng.integers(0, 40, 3000)
    x = centroids[own] + rng.integers(-50, 50, (3000, 6))
    best, distance, computed = sortmeans.assign(x, own, centroids)
    assert (best == own).all() and (distance == ((x - centroids[own]) ** 2).sum(axis=1)).all()
    assert computed < 2 * len(x)


def plain_codes(rows, dim, parts, k, rounds):
    kept = [(*r, label) for r, label in ((r, [None, 1, 2, 7][n % 4]) for n, r in enumerate(rows))]
    kept = [(i, sound([(i, v)], 4096, dim)[0][1], label) for i, v, label in kept if sound([(i, v)], 4096, dim)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:k]
    step = dim // parts
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        cut = lambda v, p=p: v[p * step : (p + 1) * step]
        found, entries = lloyd([cut(v) for _, v, _ in kept], [cut(v) for _, v, _ in order], rounds)
        books += [str(x) for e in entries for x in e]
        codes = [c + f"{e:02x}" for c, (_, e) in zip(codes, found, strict=True)]
        errors = [a + d for a, (d, _) in zip(errors, found, strict=True)]
    label_error = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        label_error[label] = label_error.get(label, 0) + e
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    return [(i, c, e, label_error[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)]


@pytest.mark.parametrize(("dim", "parts", "k", "rounds"), [(8, 4, 16, 4), (6, 2, 5, 3), (4, 4, 40, 2)])
def test_codes(spark, monkeypatch, dim, parts, k, rounds):
    monkeypatch.setattr(codebooks, "BLOCK", 90)
    rows = table(dim)
    want = sorted(map(str, plain_codes(rows, dim, parts, k, rounds)))
    assert sorted(map(str, map(tuple, codebooks.compress(frame(spark, rows), parts, k, rounds).collect()))) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)  # many labels, two of them hot
    monkeypatch.setattr(common, "HOT_ROWS", 101)
    assert sorted(map(str, map(tuple, codebooks.compress(frame(spark, rows), parts, k, rounds).collect()))) == want


def test_codes_edges(spark):
    assert codebooks.compress(frame(spark, [])).count() == 0
    assert codebooks.compress(frame(spark, [(1, None), (2, [])])).count() == 0
    assert [tuple(r)[:4] for r in codebooks.compress(frame(spark, [(5, [0.25] * 16)])).collect()] == [(5, "00" * 8, 0, 0)]
    same = [(i, [0.5] * 16) for i in range(40)]
    assert {tuple(r)[1:4] for r in codebooks.compress(frame(spark, same)).collect()} == {("00" * 8, 0, 0)}
    with pytest.raises(ValueError, match="equal parts"):
        codebooks.compress(frame(spark, [(5, [0.25] * 12)]))


def test_filter_takes_whole_boxes():
    """Clusters far apart are assigned as boxes: hardly any point is looked at."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-(10**6), 10**6, (16, 8))
    x = entries[rng.integers(0, 16, 2000)] + rng.integers(-9, 9, (2000, 8))
    tree = codebooks.Tree.loads(codebooks.Tree(x).dumps())
    points = sum(len(places) for _, _, places in tree.filter(entries) if places is not None)
    code, error = tree.codes(entries)
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    assert points < 1000
    n, sums = tree.totals(entries)
    assert n.tolist() == np.bincount(code, minlength=16).tolist()
    assert all((sums[e] == x[code == e].sum(axis=0)).all() for e in range(16))
