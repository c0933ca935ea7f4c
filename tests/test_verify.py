"""Block products against plain cosines."""

import random

import pytest

from sceneline.operators import verify as vf


@pytest.mark.parametrize("block", [3, 4096])
def test_top_k(spark, monkeypatch, block):
    """Ties, repeated ids, null, zero, odd and non-finite vectors, more blocks than vectors in one."""
    monkeypatch.setattr(vf, "GALLERY_BLOCK", block)
    monkeypatch.setattr(vf, "QUERY_BLOCK", 4)
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(40)]
    rows += [(40, None), (41, [0.0, 0.0, 0.0]), (42, [1.0, 2.0]), (43, [float("nan"), 1.0, 0.0]), (44, [1.0, None, 0.0]), (45, []), (3, rows[3][1])]
    df = vf.normalized(spark.createDataFrame(rows, "vec_id long, v array<double>"), "v")
    assert "x" in df.columns
    plain = {}
    for i, v in rows:
        if v and None not in v and any(v) and all(e == e for e in v):
            n = sum(e * e for e in v) ** 0.5
            plain.setdefault(i, []).append([e / n for e in v])
    flat = [(i, v) for i, vs in plain.items() for v in vs]
    want = {}
    for i, v in flat:
        if i % 2 == 1:
            own = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)), 9) + 0.0, j) for j, w in flat if j != i and len(w) == len(v))
            want.setdefault(i, []).extend(own)
    got = {}
    for r in vf.gallery_top_k(df.where("vec_id % 2 = 1"), df, "vec_id", 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["cosine"], 6)))
    assert set(got) == {i for i, own in want.items() if own}
    for i, found in got.items():
        best = sorted(want[i])[:5]
        assert [(k, j, c + 0.0) for k, j, c in sorted(found)] == [(k, j, round(-o, 6) + 0.0) for k, (o, j) in enumerate(best, 1)]
    near = {r["query_id"]: r["similarity"] for r in vf.best_similarity(df.where("vec_id % 2 = 1"), df, "vec_id", []).collect()}
    assert near == {i: pytest.approx(-min(own)[0], abs=1e-8) for i, own in want.items() if own}


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, x array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, x array<double>")
    for q, g in ((none, some), (some, none), (some, some)):
        assert vf.gallery_top_k(q, g, "vec_id", 3).count() == vf.best_similarity(q, g, "vec_id", []).count() == 0
