"""Vector searches against brute force."""

import numpy as np
import pytest

from sceneline.llm import ivfpq, topk

INF, NAN = float("inf"), float("nan")


def vectors(n=600, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, dim))
    x[100:140] = x[100]  # ties
    rows = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(n)]
    rows[50] = (50, None)
    rows[51] = (51, [NAN] + rows[51][1][1:])
    rows[52] = (52, [None] + rows[52][1][1:])
    rows[53] = (53, [INF] + rows[53][1][1:])
    rows[54] = (54, [0.0] * dim)
    rows[55] = (55, [])
    return [*rows, (None, rows[1][1])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<float>, rank int, query_id string")


def brute(rows, k, every, scale=None, zero=True):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(e is not None and np.isfinite(e) for e in v) and (zero or any(v))]
    if scale:
        ok = [(i, np.floor(scale * v)) for i, v in ok]
    out = []
    for q, v in ok:
        if q % every == 0:
            s = sorted((-float(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in ok if i != q)[:k]
            out += [(q, r, i, -m) for r, (m, i) in enumerate(s, 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(topk, "SHARD", 100)
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, rows), 5, 20).collect())
    assert got == [(q, r, i, int(s)) for q, r, i, s in brute(rows, 5, 20, 256)]


def plain(x, q, me, k):
    return sorted((-float(v @ q), i) for i, v in enumerate(x) if i != me)[:k]


@pytest.mark.parametrize("dim", [2, 3, 5])
def test_threshold_stops_early(dim):
    """In few dimensions the bound ends the search well before all rows are scored, and the result is exact."""
    rng = np.random.default_rng(dim)
    x = np.floor(256 * rng.normal(0, 1, (4000, dim)))
    lists = topk.Lists(np.arange(4000), x)
    for q, me in [*[(x[i], i) for i in range(0, 4000, 200)], (-np.eye(dim)[0], -1)]:
        ids, score, depth, scored = lists.search(q, me, 5)
        assert [(-s, i) for s, i in zip(score, ids, strict=True)] == plain(x, q, me, 5)
        assert depth < 1000 and scored < 3000


def test_threshold_without_a_bound():
    """In many dimensions nearly all rows are met before the bound can bite: each is scored once, none is read twice as often as there are rows."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(0, 0.125, (1000, 64)))
    lists = topk.Lists(np.arange(1000), x)
    for i in range(0, 1000, 100):
        ids, score, depth, scored = lists.search(x[i], i, 5)
        assert [(-s, j) for s, j in zip(score, ids, strict=True)] == plain(x, x[i], i, 5)
        assert scored <= 999 and depth * 64 <= 2000
    ids, score, _, scored = lists.search(np.zeros(64), 0, 3)
    assert ids.tolist() == [1, 2, 3] and score.tolist() == [0.0] * 3


def test_top_k_repeated_id(spark, monkeypatch):
    """Copies of one id are spread over the shards; each is a candidate, and as a query they are one."""
    monkeypatch.setattr(topk, "SHARD", 64)
    rows = [(50, [1.0, 0.5])] * 300 + [(i, [i / 100, 1.0]) for i in range(1, 40)]
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, rows), 3, 50).collect())
    want = sorted(((-(256 * int(256 * v[0] // 1) + 128 * int(256 * v[1] // 1)), i) for i, v in rows if i != 50))[:3]
    assert got == [(50, r, i, -s) for r, (s, i) in enumerate(want, 1)]


def test_top_k_edges(spark):
    assert topk.top_k(frame(spark, []), 5, 50).count() == 0
    assert [tuple(r) for r in topk.top_k(frame(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5])]), 5, 50).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert topk.top_k(frame(spark, [(0, [1.0, 2.0])]), 5, 50).count() == 0


def test_ann(spark):
    rows = vectors(1500, 32)
    got = [tuple(r) for r in ivfpq.search(frame(spark, rows), 20, 20).collect()]
    want = brute(rows, 20, 20, zero=False)
    assert len(got) == len(want)
    best = {(q, i): s for q, _, i, s in want}
    assert np.mean([(q, i) in best for q, _, i, _ in got]) >= 0.9
    assert all(abs(best[(q, i)] - s) < 1e-12 for q, _, i, s in got if (q, i) in best)
    for q in {g[0] for g in got}:
        own = sorted(g for g in got if g[0] == q)
        assert [g[1] for g in own] == list(range(1, len(own) + 1))
        assert [(-g[3], g[2]) for g in own] == sorted((-g[3], g[2]) for g in own)


def test_ann_split_lists(spark, monkeypatch):
    """A list with a third of all rows is cut into parts; ties still go to the smaller ids."""
    monkeypatch.setattr(ivfpq, "GROUP", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 8)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    got = sorted(tuple(r)[:3] for r in ivfpq.search(frame(spark, rows), 5, 60).collect())
    want = [w[:3] for w in brute(rows, 5, 60)]
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) >= 0.9
    assert [g for g in got if g[0] % 3 == 0] == [w for w in want if w[0] % 3 == 0]


def test_ann_edges(spark):
    assert ivfpq.search(frame(spark, [])).count() == 0
    assert ivfpq.search(frame(spark, [(0, [1.0, 0.0])])).count() == 0
    assert [tuple(r) for r in ivfpq.search(frame(spark, [(0, [1.0, 0.0]), (3, [0.5, 2.0])])).collect()] == [(0, 1, 3, 0.5)]


def test_ann_repeated_ids(spark):
    """An id with many rows: one query, by its least vector, whatever the order of the rows; the rows of one list fill several groups."""
    rng = np.random.default_rng(8)
    rows = [(20, [float(v) for v in rng.normal(0, 1, 4)]) for _ in range(3000)] + [(i, [float(v) for v in rng.normal(0, 1, 4)]) for i in range(1, 19)]
    one = sorted(tuple(r) for r in ivfpq.search(frame(spark, rows), 5, 20).collect())
    two = sorted(tuple(r) for r in ivfpq.search(frame(spark, rows[::-1]), 5, 20).collect())
    assert len(one) == 5 and one == two and all(r[0] == 20 and r[2] != 20 for r in one)
    table = ivfpq.pack({0: 10, 1: 20_000, 2: 20, 3: 8100, 4: 5})
    spans = [range(first, first + parts) for _, first, parts in table]
    assert [len(s) for s in spans] == [1, 3, 1, 1, 1] and not set(spans[1]) & {s[0] for s in (spans[0], *spans[2:])}


@pytest.mark.parametrize("kind", ["lengths", "few long", "two components", "shifted", "clusters", "heavy tails"])
def test_ann_kinds_of_vectors(spark, monkeypatch, kind):
    """The largest inner products are of long vectors in any list: the bounds find them all, whatever the table looks like."""
    monkeypatch.setattr(ivfpq, "GROUP", 500)
    monkeypatch.setattr(ivfpq, "SAMPLE", 256)
    rng = np.random.default_rng(11)
    n, dim = 1200, 2 if kind == "two components" else 16
    x = rng.normal(0, 1, (n, dim))
    if kind in ("lengths", "two components"):
        x *= np.exp(rng.normal(0, 1.5, (n, 1)))
    elif kind == "few long":
        x[1:40] *= 50
    elif kind == "shifted":
        x += 5
    elif kind == "clusters":
        x = rng.normal(0, 1, (60, dim))[rng.integers(0, 60, n)] + 0.1 * x
    elif kind == "heavy tails":
        x = np.exp(2 * x) * rng.choice([-1, 1], (n, dim))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    got = sorted(tuple(r) for r in ivfpq.search(frame(spark, rows), 5, 60, 10).collect())
    want = brute(rows, 5, 60, zero=False)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) <= 1e-9 * max(1.0, abs(w[3])) for g, w in zip(got, want, strict=True))
