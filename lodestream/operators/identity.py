"""One identity for articles that share a key: canonical or normalised address, or a source's own id. Versions of each identity.

Keys make a graph of articles; its components are the identities, however long the chain of keys that holds one
together. Rounds spread the smallest id over keys and then jump to the smallest id's own, so that a chain halves with
every round; a key that very many articles share is summed before the shuffle, and its least id is joined back as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Articles of an identity that one task puts in order.
RUN = 100_000


def keys_of(articles: DataFrame) -> DataFrame:
    """(article_id, key); articles: article_id, canonical_url, normalized_url, source_id, guid. Empty keys are none."""
    own = F.when((F.coalesce("guid", F.lit("")) != "") & F.col("source_id").isNotNull(), F.concat(F.lit("guid:"), F.length(F.col("source_id").cast("string")).cast("string"), F.lit(":"), F.col("source_id").cast("string"), F.lit(":"), "guid"))
    urls = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("url:"), c)) for c in ("canonical_url", "normalized_url")]
    return articles.select("article_id", F.explode(F.array_distinct(F.array_compact(F.array(*urls, own)))).alias("key"))


def identities(articles: DataFrame) -> DataFrame:
    """(article_id, identity): the smallest article_id that is reached by shared keys; an article without keys is its own."""
    edges = keys_of(articles)
    shared = edges.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    edges = written(edges.join(shared.select("key"), "key", "left_semi"))
    held = edges.withColumn("low", F.col("article_id"))  # each article's keys with what it has found so far
    while True:
        by_key = held.groupBy("key").agg(F.min("low").alias("found"))
        spread = held.join(by_key, "key").groupBy("article_id").agg(F.min("low").alias("old"), F.min("found").alias("low"))
        # what the smallest id itself has found is found by all that hold it
        jump = spread.select(F.col("article_id").alias("low"), F.col("low").alias("further"))
        at = written(spread.join(jump, "low", "left").select("article_id", "old", F.least("low", F.coalesce("further", "low")).alias("low")))
        if not at.where("low <> old").limit(1).count():
            at = at.drop("old")
            return articles.select("article_id").distinct().join(at, "article_id", "left").select("article_id", F.coalesce("low", "article_id").alias("identity"))
        held = edges.join(at.drop("old"), "article_id")


def arrivals(articles: DataFrame, found: DataFrame) -> DataFrame:
    """article_id, identity, kind (new, exact or update) and version of each article as it arrives in the order of ids.

    An update has another content, title or time of change than the article of its identity before it; where one of
    two contents or times is missing, they do not differ. articles also hold content_hash, title_norm and changed_at. An identity's articles are
    put in order in runs of ids, and a run begins with the last article of the run before.
    """
    state = F.struct("content_hash", "title_norm", "changed_at")
    rows = written(articles.join(found, "article_id").select("article_id", "identity", state.alias("state"), F.floor(F.col("article_id") / RUN).alias("run")))
    ends = rows.groupBy("identity", "run").agg(F.max_by("state", "article_id").alias("end"))
    ends = ends.withColumn("before_run", F.lag("end").over(W.partitionBy("identity").orderBy("run"))).drop("end")
    inside = W.partitionBy("identity", "run").orderBy("article_id")
    j = rows.withColumn("before", F.lag("state").over(inside)).join(ends, ["identity", "run"]).withColumn("before", F.coalesce("before", "before_run"))

    def other(c: str, either: bool) -> Column:
        a, b = F.col(f"before.{c}"), F.col(f"state.{c}")
        return F.coalesce(a != b, F.lit(False)) if either else ~a.eqNullSafe(b)

    changed = other("content_hash", True) | other("title_norm", False) | other("changed_at", True)
    kinds = written(j.select("article_id", "identity", "run", F.when(F.col("before").isNull(), "new").when(changed, "update").otherwise("exact").alias("kind")))
    step = (F.col("kind") != "exact").cast("long")
    sums = kinds.groupBy("identity", "run").agg(F.sum(step).alias("n"))
    sums = sums.select("identity", "run", (F.sum("n").over(W.partitionBy("identity").orderBy("run")) - F.col("n")).alias("earlier"))
    counted = kinds.withColumn("here", F.sum(step).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return counted.join(sums, ["identity", "run"]).select("article_id", "identity", "kind", (F.col("here") + F.col("earlier")).alias("version"))
