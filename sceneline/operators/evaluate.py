"""Evaluation of decisions against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_predictions(gold: DataFrame, pred: DataFrame, keys: list[str], expected: str, actual: str, missing: str = "missing") -> DataFrame:
    """``gold`` with ``actual`` of the prediction with the same keys, ``missing`` where there is none."""
    p = pred.select(*keys, F.col(actual).alias("actual"))
    return gold.select(*keys, F.col(expected).alias("expected"), *[c for c in gold.columns if c not in (*keys, expected)]).join(p, keys, "left").withColumn("actual", F.coalesce("actual", F.lit(missing)))


def confusion(rows: DataFrame, expected: list[str], actual: list[str]) -> DataFrame:
    """A row for each expected value, a column for each actual one; fixed value lists, so no extra pass."""
    got = rows.groupBy("expected").agg(*[F.count_if(F.col("actual") == a).alias(a) for a in actual])
    names = rows.sparkSession.createDataFrame([(e,) for e in expected], "expected string")
    return names.join(got, "expected", "left").na.fill(0, actual)


def share(good: Column, where: Column | None = None) -> Column:
    """Share of rows for which ``good`` holds among those for which ``where`` does; null if there are none."""
    where = F.lit(True) if where is None else where
    return F.try_divide(F.count_if(good & where), F.count_if(where))


def binary_metrics(rows: DataFrame, positive: str) -> DataFrame:
    """One row: n, accuracy (0 if empty), precision and recall (null on empty denominators)."""
    e, a = F.col("expected") == positive, F.col("actual") == positive
    return rows.agg(
        F.count("*").alias("n"),
        F.coalesce(share(F.col("expected") == F.col("actual")), F.lit(0.0)).alias("accuracy"),
        share(e, a).alias("precision"),
        share(a, e).alias("recall"),
    )


def stratified(rows: DataFrame, stratum: str) -> DataFrame:
    return rows.groupBy(stratum).agg(F.count("*").alias("n"), share(F.col("expected") == F.col("actual")).alias("accuracy"))


def weighted_mean(strata: DataFrame, weights: DataFrame, stratum: str) -> DataFrame:
    """Mean accuracy of the strata that have one and a positive weight, by weight."""
    j = strata.join(weights, stratum).where("accuracy IS NOT NULL AND weight > 0")
    return j.agg((F.sum(F.col("accuracy") * F.col("weight")) / F.sum("weight")).alias("weighted_accuracy"))


def gates(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``metrics`` with a boolean for each limit and their conjunction; a null metric does not pass."""
    passed = {f"{m}_ok": F.coalesce(F.col(m) >= limit, F.lit(False)) for m, limit in limits.items()}
    out = metrics.withColumns(passed)
    return out.withColumn("passed", F.forall(F.array(*passed), lambda p: p))


def coverage(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose responses are missing, foreign or duplicate: (keys, problem)."""
    r = responses.groupBy(*keys).agg(F.count("*").alias("_n"))
    q = requests.select(*keys).distinct().withColumn("_asked", F.lit(True))
    both = q.join(r, keys, "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_asked").isNull(), "foreign").when(F.col("_n") > 1, "duplicate")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "problem")


def partition_report(whole: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """One row: rows of the whole, of the part, of the rest, and whether the two are disjoint and complete."""
    rest = whole.join(part.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("rest"))
    foreign = part.join(whole.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("foreign"))
    n = whole.agg(F.count("*").alias("whole")).join(part.agg(F.count("*").alias("part"))).join(rest).join(foreign)
    return n.withColumn("exact", (F.col("part") + F.col("rest") == F.col("whole")) & (F.col("foreign") == 0))


def overlay(base: DataFrame, patch: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``base`` with the non-null ``cols`` of ``patch`` in place of its own, and whether a row was patched."""
    p = patch.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in cols], F.lit(True).alias("_p"))
    out = base.join(p, keys, "left")
    return out.select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns], F.coalesce("_p", F.lit(False)).alias("patched"))
