"""Targets against plain resharing; what is drawn against the targets."""

import math
import re
from collections import Counter, defaultdict

import pytest

from sceneline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, rest, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            target.update({s: rest * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.fixture(scope="module")
def rows():
    out, n = [], 0
    for source, k in (("a", 1200), ("b", 150), ("é", 3), ("z", 40), (None, 80), ("Z", 1), ("empty", 2)):
        for i in range(k):
            text = None if source == "empty" or i % 37 == 36 else " ".join(["w"] * (1 + (i * 7) % 23))
            out.append((n, text, source, "clash"))
            n += 1
    return out


def test_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string")
    got = mixing.mix(docs).collect()
    size = {d: len(WORD.findall(t or "")) for d, t, *_ in rows}
    source = {d: s for d, _, s, _ in rows}
    sizes = Counter()
    for d in size:
        sizes[source[d]] += size[d]
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    taken, shards = Counter(), defaultdict(Counter)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s])
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"])
        assert len({d["copy"] for d in r["draws"]}) == len(r["draws"])
        taken[s] += r["taken"]
        for d in r["draws"]:
            shards[d["shard"]][s] += d["words"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2
    assert len(shards) == 2**mixing.LEVELS
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, got)) != sorted(map(str, mixing.mix(docs, seed=2).collect()))


def hypergeometric(total, own, drawn):
    """Probabilities of 0..drawn of the ``own`` ones among ``drawn`` of ``total``."""
    return [math.comb(own, k) * math.comb(total - own, drawn - k) / math.comb(total, drawn) if drawn - k <= total - own else 0.0 for k in range(min(own, drawn) + 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_is_multivariate_hypergeometric(spark, seed):
    """Shards get equal numbers of places; what a source has in them is spread as a draw without replacement spreads it."""
    own = {f"s{i:02}": 20 + 5 * i for i in range(40)}
    places = spark.createDataFrame([(sk, at) for sk, n in own.items() for at in range(1, n + 1)], "_sk string, _at int")
    got = mixing.tree(places, seed).collect()
    assert sorted((r["_sk"], r["_at"]) for r in got) == sorted((sk, at) for sk, n in own.items() for at in range(1, n + 1))
    shards = Counter(r["shard"] for r in got)
    assert sorted(shards) == list(range(16)) and max(shards.values()) - min(shards.values()) <= 1
    cell = Counter((r["_sk"], r["shard"]) for r in got)
    total, squares, var = sum(own.values()), 0.0, 0.0
    for sk, n in own.items():
        p = hypergeometric(total, n, total // 16)
        mean = sum(k * q for k, q in enumerate(p))
        var += 16 * sum(k * k * q for k, q in enumerate(p)) - 16 * mean * mean
        for shard in range(16):
            k = cell[sk, shard]
            squares += (k - mean) ** 2
            assert sum(p[: k + 1]) > 1e-6 and sum(p[k:]) > 1e-6  # 640 cells: one in a thousand runs at most
    assert 0.8 < squares / var < 1.2  # the spread is that of the draw: 640 cells know it within about 6 %


def test_odd_and_small_nodes(spark):
    for n in (0, 1, 2, 3, 17):
        places = spark.createDataFrame([("0a", at) for at in range(1, n + 1)], "_sk string, _at int")
        shards = Counter(r["shard"] for r in mixing.tree(places, 3, levels=2).collect())
        assert sum(shards.values()) == n and (not n or max(shards.values()) - min([*shards.values(), *[0] * (4 - len(shards))]) <= 2)


def test_documents(spark, rows):
    docs = spark.createDataFrame([(d, t, s, len(t or "")) for d, t, s, _ in rows], "doc_id long, text string, source string, n_chars long")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words, text = Counter(), {d: t for d, t, *_ in rows}
    for r in out.collect():
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    assert words == Counter({d: n for d, n in taken.items() if n})


def test_order_and_clashing_names(spark):
    """The mix is in the order of shards and places, which is not that of the documents; columns keep their values, whatever their names."""
    names = ["doc_id", "text", "source", "_row", "_size", "_spans", "target", "source_size", "draws", "shard", "row", "_sk"]
    docs = spark.createDataFrame([(i, f"a b c {i}", f"s{i % 3}", *[f"{n}{i}" for n in names[3:]]) for i in range(300)], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = mixing.mixed_documents(docs).collect()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in out for n in names[3:])
    draws = sorted((d["shard"], d["place"], r["doc_id"]) for r in mixing.mix(docs).collect() for d in r["draws"])
    assert [r["doc_id"] for r in out] == [d for _, _, d in draws]
    inside = [d for s, _, d in draws if s == 0]
    assert inside != sorted(inside) and len({s for s, _, _ in draws}) == 16


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 2
    same = mixing.mix(spark.createDataFrame([(1, "a b c", "x")] * 10 + [(None, "d e", "x"), (2, "f", "y")], schema)).collect()
    assert len(same) == 12 and abs(sum(r["taken"] for r in same) - 33) <= 12
