"""Claim verification: independent chains, status ladder, supersession and conflicts of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def families_by_stance(evidence: DataFrame) -> DataFrame:
    """Distinct families of each stance per claim; evidence: claim_id, family, stance, has_primary."""

    def n(*stances: str) -> Column:
        return F.countDistinct(F.when(F.col("stance").isin(*stances), F.col("family")))

    return evidence.groupBy("claim_id").agg(n("supports").alias("supports"), n("reports").alias("reports"), n("refutes").alias("refutes"), n("disputes").alias("disputes"), n("supports", "reports").alias("chains"), F.bool_or((F.col("stance") == "refutes") & F.col("has_primary")).alias("primary_refutes"))


def status(superseded: Column, conflict: Column, statement: Column, party: Column) -> Column:
    """The ladder of statuses over the columns of families_by_stance."""
    s, rep, ref, dis = F.col("supports"), F.col("reports"), F.col("refutes"), F.col("disputes")
    return (
        F.when(superseded, "outdated").when(conflict | (dis > 0), "disputed").when((ref >= 2) | F.col("primary_refutes"), "refuted").when(ref == 1, "disputed")
        .when(statement & (s >= 1), F.when(s >= 2, "corroborated").otherwise("reported")).when(s >= 2, "corroborated").when(s == 1, "partially_corroborated")
        .when(rep > 0, F.when(party, "unverified").otherwise("reported")).otherwise("unverified")
    )


def supersession(claims: DataFrame) -> DataFrame:
    """Older figures that a later one of the same attribution and unit replaces. claims: claim_id, actor, unit, number, at.

    The latest supersedes only when it is the only one of its time and its figure differs.
    """
    last = claims.groupBy("actor", "unit").agg(F.max("at").alias("last"))
    j = claims.join(last, ["actor", "unit"])
    top = j.where("at = last").groupBy("actor", "unit").agg(F.count("*").alias("n"), F.min("claim_id").alias("by"), F.min("number").alias("figure"))
    return j.where("at < last").join(top.where("n = 1"), ["actor", "unit"]).where("number <> figure").select("claim_id", F.col("by").alias("superseded_by"))


def number_range(number: Column, qualifier: Column) -> tuple[Column, Column]:
    low = F.when(qualifier.isin("at_least", "exact"), number).when(qualifier == "more_than", number + 1).when(qualifier == "about", number * 0.85).otherwise(0.0)
    high = F.when(qualifier.isin("up_to", "exact"), number).when(qualifier == "about", number * 1.15).otherwise(float("inf"))
    return low, high


def conflicts(claims: DataFrame, hours: int = 48, relative: float = 0.1, absolute: float = 1.0) -> DataFrame:
    """Pairs of figures of one unit by different actors, close in time, whose ranges exclude each other.

    claims: claim_id, actor, unit, at (seconds), low, high. A range-bucketed join: each claim lies in its own time bucket
    of ``hours`` and is also looked up from the bucket before, so the join has equality keys and no nested loop.
    """
    step = hours * 3600
    a = claims.select(*(F.col(c).alias(f"a_{c}") for c in claims.columns)).withColumn("bucket", F.floor(F.col("a_at") / step))
    b = claims.select(*(F.col(c).alias(f"b_{c}") for c in claims.columns)).withColumn("bucket", F.explode(F.array(*(F.floor(F.col("b_at") / step) + i for i in (-1, 0, 1)))))
    gap = F.greatest(F.col("a_low") - F.col("b_high"), F.col("b_low") - F.col("a_high"))
    scale = F.greatest(F.least(F.col("a_low"), F.col("b_low")), F.lit(1.0))
    apart = (gap > absolute) & (gap / scale > relative)
    near = (F.col("a_unit") == F.col("b_unit")) & (F.col("a_claim_id") < F.col("b_claim_id")) & (F.col("a_actor") != F.col("b_actor")) & (F.abs(F.col("a_at") - F.col("b_at")) <= step)
    return a.join(b, (a.bucket == b.bucket) & near & apart).select(F.col("a_claim_id").alias("left_id"), F.col("b_claim_id").alias("right_id"))
