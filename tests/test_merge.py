"""Copy-on-write merges and plugs."""

import random

import pytest
from pyspark.sql import functions as F

from sceneline.operators import plugs as pg
from sceneline.sources import merge as mg

SCHEMA = "id long, name string, score double"
PART = "pmod(id, 4)"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", op string")


def held(spark, path, version=None):
    return sorted(tuple(r)[:3] for r in mg.read(spark, path, SCHEMA, version).collect())


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "t")
    plain = {i: (i, f"n{i}" if i % 5 else None, i / 2) for i in range(40)}
    version = mg.create(table(spark, list(plain.values())), path, PART)
    history = {1: sorted(plain.values())}
    for _ in range(4):
        ids = rng.sample([i for i in range(60) if i % 4 in (1, 2)], 9)
        rows = [(i, f"m{i}", rng.random(), rng.choice(["upsert", "delete"])) for i in ids]
        before = mg.manifest(spark, path)
        version = mg.merge(changes(spark, rows), path, ["id"], PART, version)
        for i, name, score, op in rows:
            plain.pop(i, None)
            if op == "upsert":
                plain[i] = (i, name, score)
        history[version] = sorted(plain.values())
        after = mg.manifest(spark, path)
        assert {p for p in after if after[p] != before.get(p)} <= {i % 4 for i in ids}
        assert all(after[p] == before[p] for p in (0, 3))  # not touched
    assert {v: held(spark, path, v) for v in history} == history


def test_partitions_come_and_go(spark, tmp_path):
    path = str(tmp_path / "t")
    mg.create(table(spark, [(1, "a", 0.0), (5, "b", 0.0), (2, "c", 0.0)]), path, PART)
    assert mg.merge(changes(spark, [(1, None, None, "delete"), (5, None, None, "delete"), (9, None, None, "delete")]), path, ["id"], PART, 1) == 2
    assert held(spark, path) == [(2, "c", 0.0)] and set(mg.manifest(spark, path)) == {2}
    assert mg.merge(changes(spark, [(3, "d", 1.0, "upsert")]), path, ["id"], PART, 2) == 3
    assert held(spark, path) == [(2, "c", 0.0), (3, "d", 1.0)]
    assert mg.merge(changes(spark, []), path, ["id"], PART, 3) == 3
    assert held(spark, path, 1) == [(1, "a", 0.0), (2, "c", 0.0), (5, "b", 0.0)]


def test_refusals(spark, tmp_path):
    path = str(tmp_path / "t")
    mg.create(table(spark, [(i, "a", 0.0) for i in range(8)]), path, PART)
    with pytest.raises(FileExistsError):
        mg.create(table(spark, []), path, PART)
    mg.merge(changes(spark, [(1, "b", 1.0, "upsert")]), path, ["id"], PART, 1)
    with pytest.raises(mg.ChangedBase, match=r"\[1\]"):
        mg.merge(changes(spark, [(5, "c", 1.0, "upsert")]), path, ["id"], PART, 1)
    assert mg.merge(changes(spark, [(2, "c", 1.0, "upsert")]), path, ["id"], PART, 1) == 3  # another partition
    for bad in ([(4, "x", 0.0, "upsert"), (4, "y", 0.0, "delete")], [(4, "x", 0.0, "insert")], [(4, "x", 0.0, None)]):
        with pytest.raises(ValueError, match="4"):
            mg.merge(changes(spark, bad), path, ["id"], PART, 3)
    table(spark, [(0, "z", 9.0)]).write.mode("append").parquet(f"{path}/data/v1/part=0")  # someone wrote past the table
    with pytest.raises(mg.ChangedBase, match="manifest"):
        mg.merge(changes(spark, [(4, "c", 1.0, "upsert")]), path, ["id"], PART, 3)
    with pytest.raises(ValueError, match="no version 9"):
        mg.read(spark, path, SCHEMA, 9)


def test_digest_ignores_order(spark):
    rows = [(i, None if i % 3 else "x", float(i)) for i in range(50)]
    one, two = (mg.digests(table(spark, r).withColumn("part", F.expr(PART).cast("int")), ["id", "name", "score"]) for r in (rows, rows[::-1]))
    other = mg.digests(table(spark, [*rows[:-1], (49, None, 1.0)]).withColumn("part", F.expr(PART).cast("int")), ["id", "name", "score"])
    assert one == two and {p for p in one if one[p] != other[p]} == {1}


@pytest.mark.parametrize("n", [1, 24, 25, 50, 74, 75, 76, 100, 101, 230])
def test_windows(n):
    """Every place is predicted once, from the window in whose middle it is."""
    seen = []
    plug = pg.Windows(lambda w: seen.append(list(w)) or w, "m", "k", "v")
    row = lambda k: {"m": 7, "k": k, "v": float(k)}
    out = [r for k in range(n) for r in plug.feed(row(k))] + list(plug.finish())
    assert out == [(7, k, float(k)) for k in range(n)]
    padded = [0.0] * 25 + [float(k) for k in range(n)] + [float(n - 1)] * 200
    assert seen == [padded[i : i + 100] for i in range(0, 50 * len(seen), 50)] and len(seen) == -(-n // 50)


def test_resolver(spark):
    rows = [("m", 1, [{"block": 4}]), ("m", 2, [])]
    asked = spark.createDataFrame(rows, "movie_key string, request_id long, candidates array<struct<block:long>>")
    answers = "movie_key string, request_id long, decision string, blocks array<long>"
    run = lambda f: sorted(tuple(r) for r in pg.through(asked, lambda: pg.Resolver(f), ["movie_key"], ["request_id"], answers).collect())
    assert run(lambda r: [c["block"] for c in r["candidates"]]) == [("m", 1, "match", [4]), ("m", 2, "no_match", [])]
    with pytest.raises(Exception, match="no candidates"):
        run(lambda r: [9])
    assert pg.through(asked.limit(0), lambda: pg.Resolver(lambda r: []), ["movie_key"], ["request_id"], answers).count() == 0
