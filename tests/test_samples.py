"""Samples for review against a plain version."""

import random

from pyspark.sql import functions as F

from sceneline.operators import samples as sm


def plain(rows, strata, total):
    """One key's sample: label after label, the first items that are not taken yet."""
    taken = []
    for label, met, order, limit in strata:
        for r in sorted((r for r in rows if met(r) and r["item"] is not None), key=lambda r: (*order(r), r["item"])):
            if sum(t[1] == label for t in taken) < limit and r["item"] not in [t[0] for t in taken]:
                taken.append((r["item"], label))
    return taken[:total]


def test_take_unique(spark):
    rnd = random.Random(5)
    rows = [{"film": rnd.choice("abcd"), "item": rnd.choice([None, *range(40)]), "x": rnd.choice([None, 1, 2, 3]), "y": rnd.randint(0, 4)} for _ in range(600)] + [{"film": "e", "item": 1, "x": 1, "y": 1}]
    table = spark.createDataFrame(rows, "film string, item long, x long, y long").withColumn("place", F.lit("clash"))
    strata = [
        ("low", lambda r: r["x"] == 1, lambda r: (r["y"],), 4), ("odd", lambda r: r["y"] % 2 == 1, lambda r: (-r["y"],), 3),
        ("never", lambda r: False, lambda r: (), 3), ("all", lambda r: True, lambda r: (-r["y"],), 9),
    ]
    y = F.col("y")
    same = [sm.Stratum("low", F.col("x") == 1, (y,), 4), sm.Stratum("odd", y % 2 == 1, (-y,), 3), sm.Stratum("never", F.lit(False), (y,), 3), sm.Stratum("all", F.lit(True), (-y,), 9)]
    for total in (3, 12, 30):
        found = sm.take_unique(table, "film", "item", same, total)
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r["film"], r["ordinal"])):
            got.setdefault(r["film"], []).append((r["item"], r["stratum"]))
            assert r["ordinal"] == len(got[r["film"]])
        assert got == {f: plain([r for r in rows if r["film"] == f], strata, total) for f in "abcde"}
    planned = sm.take_unique(table, "film", "item", same, 12)  # a plan that has run is printed twice
    assert planned._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sm.take_unique(table.limit(0), "film", "item", same, 5).count() == 0


def test_spread(spark):
    """The first of each scene by time, then the others by rank; a null scene is one."""
    rows = [("m", 1, "p", 9.0, 1), ("m", 2, "p", 1.0, 5), ("m", 3, "q", 4.0, 2), ("m", 4, None, 0.5, 4), ("m", 5, None, 2.0, 3), ("m", 6, "r", 0.0, 0)]
    table = spark.createDataFrame(rows, "film string, item long, scene string, time double, rank long").withColumn("fit", F.col("item") < 6)
    order = sm.spread(F.col("fit"), "film", "scene", ["time"], ["rank"])
    got = sm.take_unique(table, "film", "item", [sm.Stratum("s", F.col("fit"), order, 9)], 9).orderBy("ordinal").collect()
    assert [r["item"] for r in got] == [4, 2, 3, 1, 5]
