"""Audits of sequences and of decisions against candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence_regressions(rows: DataFrame, key: str, order: list[str], first: str, last: str, by: str) -> DataFrame:
    """Mapped rows that begin or end before the mapped row before them, with the row to blame.

    Blamed is the one of the two whose ``by`` is true (decided by a model), the later one if
    both are or neither is.
    """
    w = Window.partitionBy(key).orderBy(*order)
    ident = F.struct(*order)
    mapped = rows.where(F.col(first).isNotNull()).withColumn("_p", F.lag(F.struct(F.col(first).alias("f"), F.col(last).alias("l"), F.col(by).alias("by"), ident.alias("id"))).over(w))
    start, end = F.col(first) < F.col("_p.f"), F.col(last) < F.col("_p.l")
    blame_previous = F.col("_p.by") & ~F.col(by)
    return mapped.where(start | end).select(
        key, *order, start.alias("start_regression"), end.alias("end_regression"), F.when(blame_previous, F.col("_p.id")).otherwise(ident).alias("target"), F.col("_p.id").alias("previous")
    )


def sequence_events(rows: DataFrame, key: str, order: list[str], scene: str, first: str, last: str, basis: str, reorder_basis: str = "reorder", bounded: int = 3) -> DataFrame:
    """Events between a non-empty selection and the non-empty one before it.

    Another scene (high risk); the same span (info); backward when start or end decreases, large
    above ``bounded``: high risk if large or in another scene, info on the reorder basis, else a
    warning; and only if not backward, a forward jump above ``bounded`` (warning).
    """
    w = Window.partitionBy(key).orderBy(*order)
    prev = F.lag(F.struct(F.col(scene).alias("s"), F.col(first).alias("f"), F.col(last).alias("l"))).over(w)
    rows = rows.where(F.col(first).isNotNull()).withColumn("_p", prev).where("_p IS NOT NULL")
    other = F.col(scene) != F.col("_p.s")
    distance = F.greatest(F.lit(0), F.col("_p.f") - F.col(first), F.col("_p.l") - F.col(last))
    back = distance > 0
    severity = F.when((distance > bounded) | other, "high_risk").when(F.col(basis) == reorder_basis, "info").otherwise("warning")
    event = lambda kind, sev, d: F.struct(F.lit(kind).alias("event"), sev.alias("severity"), d.cast("long").alias("distance"))
    zero, jump = F.lit(0), F.col(first) - F.col("_p.l")
    found = F.array(
        F.when(other, event("cross_scene", F.lit("high_risk"), zero)),
        F.when((F.col(first) == F.col("_p.f")) & (F.col(last) == F.col("_p.l")), event("repeat", F.lit("info"), zero)),
        F.when(back, event("backward", severity, distance)),
        F.when(~back & (jump > bounded), event("forward_jump", F.lit("warning"), jump)),
    )
    return rows.select(key, *order, F.explode(F.array_compact(found)).alias("e")).select(key, *order, "e.*")


def no_match_risk(shared: DataFrame, key: str) -> DataFrame:
    """Class of each unmatched line from its evidence columns (phrase, n_tokens, shared, share, near, moderate)."""
    c = F.col
    strong = (c("phrase") & (c("n_tokens") >= 4)) | ((c("shared") >= 2) & (c("share") >= 2 / 3))
    outside = c("near") & ((c("phrase") & (c("n_tokens") >= 3)) | ((c("shared") >= 2) & (c("share") >= 0.75)))
    cls = F.when(c("supplied") & strong, "reviewer_selection_risk").when(~c("supplied") & outside, "candidate_recall_risk").when(c("moderate") & (c("shared") >= 2) & (c("share") >= 0.5), "ambiguous").otherwise("probable_true_no_match")
    return shared.select(key, cls.alias("risk"))
