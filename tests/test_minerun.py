"""Runs that resume: what is computed again, and what is not."""

import pytest
from pyspark.sql import functions as F

from sceneline.operators import minerun as mr
from sceneline.plans import mining_queries as mq

SF = "/root/testdata/sf0.001"


def stages(seen, factor=2):
    def double(shots):
        seen.append(("double", sorted({r["movie_key"] for r in shots.collect()})))
        return shots.select("movie_key", "shot", (F.abs("x") * factor).alias("y"))

    def total(double, frames):
        seen.append(("total", sorted({r["movie_key"] for r in double.collect()})))
        return double.groupBy("movie_key").agg(F.sum("y").alias("y")).join(frames.groupBy("movie_key").agg(F.count("*").alias("n")), "movie_key", "left")

    return [mr.Stage("double", ("shots",), double, {"factor": factor}), mr.Stage("total", ("double", "frames"), total)]


def tables(spark, shots, frames):
    return {"shots": spark.createDataFrame(shots, "movie_key string, shot long, x long, note string"), "frames": spark.createDataFrame(frames, "movie_key string, f long")}


SHOTS = [("a", 1, 1, None), ("a", 2, 2, "n"), ("b", 1, 3, None), ("b", 1, 3, None), ("c", 1, 5, ""), (None, 1, 9, None)]
FRAMES = [("a", 1), ("a", 2), ("c", 7), ("z", 1)]


def result(spark, root):
    return {r["movie_key"]: (r["y"], r["n"]) for r in mr.rows(spark, root, "total").collect()}


def test_only_what_changed(spark, tmp_path):
    root, seen = f"file://{tmp_path}/run", []
    go = lambda shots=SHOTS, frames=FRAMES, factor=2: (seen.clear(), mr.resume(spark, root, tables(spark, shots, frames), stages(seen, factor)), list(seen))[2]
    assert go() == [("double", ["a", "b", "c"]), ("total", ["a", "b", "c"])]
    assert result(spark, root) == {"a": (6, 2), "b": (12, None), "c": (10, 1)}
    assert go(list(reversed(SHOTS)), list(reversed(FRAMES))) == []  # the order of rows does not matter
    # One film changed: one film touched, in both stages.
    shots = [("a", 1, 1, None), ("a", 2, 4, "n"), *SHOTS[2:]]
    assert go(shots) == [("double", ["a"]), ("total", ["a"])]
    assert result(spark, root)["a"] == (10, 2) and {r["movie_key"]: r["run"] for r in mr.films(spark, root, "total").collect()} == {"a": 3, "b": 1, "c": 1}
    # An input that changes nothing in the rows: later stages are left alone.
    shots = [("a", 1, -1, "another note"), *shots[1:]]
    assert go(shots) == [("double", ["a"])]
    # A repeated row less, other frames, a film gone, a new film.
    assert go([*shots[:3], *shots[4:]], [*FRAMES[1:], ("b", 1)]) == [("double", ["b"]), ("total", ["a", "b"])]
    assert go([s for s in shots if s[0] != "c"] + [("d", 1, 7, None)], FRAMES) == [("double", ["b", "d"]), ("total", ["a", "b", "d"])]
    assert result(spark, root) == {"a": (10, 2), "b": (12, None), "d": (14, None)}
    # Other options: all films of the stage.
    assert go([s for s in shots if s[0] != "c"], FRAMES, 3) == [("double", ["a", "b"]), ("total", ["a", "b"])]
    assert result(spark, root) == {"a": (15, 2), "b": (18, None)}
    assert go([], FRAMES, 3) == [] and result(spark, root) == {}
    assert go(SHOTS, FRAMES, 3)[0] == ("double", ["a", "b", "c"])


def test_failures_and_lost_rows(spark, tmp_path):
    root, seen = f"file://{tmp_path}/run", []
    first = stages(seen)
    mr.resume(spark, root, tables(spark, SHOTS, FRAMES), first)
    broken = [first[0], mr.Stage("total", ("double", "frames"), lambda double, frames: double.select("movie_key", F.raise_error(F.lit("lost")).cast("long").alias("y"), F.lit(1).cast("long").alias("n")))]
    more = [*SHOTS, ("e", 1, 1, None)]
    with pytest.raises(Exception, match="lost"):
        mr.resume(spark, root, tables(spark, more, FRAMES), broken)
    assert set(result(spark, root)) == {"a", "b", "c"}
    seen.clear()
    assert mr.resume(spark, root, tables(spark, more, FRAMES), first) == 3
    assert seen == [("total", ["e"])] and result(spark, root)["e"] == (2, None)  # the finished stage is not done again
    # Rows that were changed behind its back are computed again.
    place = f"{root}/double/run=1/rows"
    odd = [tuple(r) for r in spark.read.parquet(place).withColumn("y", F.when(F.col("movie_key") == "b", 0).otherwise(F.col("y"))).collect()]
    spark.createDataFrame(odd, "movie_key string, shot long, y long").write.mode("overwrite").parquet(place)
    seen.clear()
    mr.resume(spark, root, tables(spark, more, FRAMES), first)
    assert seen == [("double", ["b"])] and result(spark, root)["b"] == (12, None)
    alien = [mr.Stage("double", ("shots",), lambda shots: shots.select(F.lit("q").alias("movie_key"), "shot"), {"v": 2})]
    with pytest.raises(Exception, match="not asked for q"):
        mr.resume(spark, root, tables(spark, more, FRAMES), alien)


def test_mining_run(spark):
    """Films with other texts are computed again in the first stage, films with other frames from the second on."""
    root = mq.twice(spark, SF)
    films = {s: {r["movie_key"]: r["run"] for r in mr.films(spark, root, s).collect()} for s in ("evidence", "selection", "grouping")}
    assert films["evidence"] and films["evidence"] == {m: 2 if m % 7 == 3 else 1 for m in films["evidence"]}
    assert {m for m, run in films["selection"].items() if run == 2} <= {m for m in films["selection"] if m % 7 in (3, 5)}
    assert {m for m, run in films["grouping"].items() if run == 2} <= {m for m, run in films["selection"].items() if run == 2}
