"""The registry of sources: what names an endpoint, faults of a seed list, its merge into the table, probe counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def endpoint(adapter: Column, feed_url: Column, config: Column, source_id: Column) -> Column:
    """One name per endpoint, equal for sources that would fetch the same; ``config`` is a map of strings."""

    def of(key: str, default: str = "") -> Column:
        return F.coalesce(F.try_element_at(config, F.lit(key)), F.lit(default))

    return (
        F.when(F.coalesce(feed_url, F.lit("")) != "", F.concat(F.lit("feed:"), F.lower(feed_url)))
        .when(adapter == "mastodon", F.lower(F.concat_ws(":", F.lit("mastodon"), of("instance"), of("acct"))))
        .when(adapter == "bluesky", F.lower(F.concat(F.lit("bluesky:"), of("actor"))))
        .when(adapter == "telegramweb", F.lower(F.concat(F.lit("telegram:"), of("channel"))))
        .when(adapter == "gdelt", F.concat_ws(":", F.lit("gdelt"), of("query"), of("timespan", "1d")))
        .otherwise(F.concat_ws(":", adapter, source_id))
    )


def faults(families: DataFrame, sources: DataFrame) -> DataFrame:
    """fault, key, n of a seed list; none when it may be loaded. sources: id, family_id and endpoint.

    Three counts and one anti join; each count combines on the map side.
    """

    def twice(df: DataFrame, column: str, fault: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).where("n > 1 OR key IS NULL").select(F.lit(fault).alias("fault"), F.col("key").cast("string"), "n")

    lost = sources.join(families.select(F.col("id").alias("family_id")), "family_id", "left_anti").groupBy("family_id").agg(F.count("*").alias("n"))
    out = twice(families, "id", "family twice").unionByName(twice(sources, "id", "source twice")).unionByName(twice(sources, "endpoint", "endpoint twice"))
    return out.unionByName(lost.select(F.lit("family unknown").alias("fault"), F.col("family_id").cast("string").alias("key"), "n"))


def sync(table: DataFrame, seeds: DataFrame, key: str = "id") -> DataFrame:
    """The table after the seed list was merged in; both have ``key``, enabled, and health in the table alone.

    Described columns come from the seed, running state stays. A source that is switched off is disabled; one switched on
    again starts as unknown. Sources that the list does not name stay as they are.
    """
    said = [c for c in seeds.columns if c != key]
    kept = [c for c in table.columns if c not in (*said, key, "health")]
    old = table.select(key, *(F.col(c).alias(f"_old_{c}") for c in said), *kept, "health", F.lit(True).alias("_was"))
    new = seeds.select(key, *said, F.lit(True).alias("_said"))
    j = old.join(new, key, "full_outer")
    on = F.when(F.col("health") == "disabled", "unknown").otherwise(F.coalesce("health", F.lit("unknown")))
    health = F.when(F.col("_said").isNull(), F.col("health")).when(~F.col("enabled"), "disabled").otherwise(on)
    return j.select(key, *(F.when(F.col("_said"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in said), *kept, health.alias("health"))


def probe_counts(probes: DataFrame) -> DataFrame:
    """One row: how many probed sources answered with items, answered without, or failed."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    states = {"failed": failed, "empty": ~failed & (F.coalesce("n_items", F.lit(0)) == 0), "ok": ~failed & (F.col("n_items") > 0)}
    return probes.agg(*(F.count_if(c).alias(n) for n, c in states.items()))
