"""Alerts of events: those that break and those that a watch waits for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAKING_FROM = 85


def evaluate(events: DataFrame, watches: list[dict], sent: DataFrame | None = None) -> DataFrame:
    """event_id, level, reason and dedupe_key of alerts not yet sent.

    events: event_id, version, importance, track_mode, hay (text that terms are looked for in). watches: rules with name,
    terms, least (importance) and enabled. A key is per event and version, so an unchanged event alerts once; ``sent``
    holds keys that exist already. Rules are one array expression per event, so there is no join with them.
    """
    breaks = F.col("track_mode") == "breaking"
    level = F.when(breaks, "breaking").otherwise("notable")
    hay, version = F.lower(F.coalesce("hay", F.lit(""))), F.concat(F.lit(":v"), "version")
    found = [F.when(breaks | (F.col("importance") >= BREAKING_FROM), F.struct(F.lit("breaking").alias("level"), F.lit("importance").alias("reason"), F.concat(F.lit("breaking:"), "event_id", version).alias("dedupe_key")))]
    for w in watches:
        wanted = [x.strip().lower() for x in w["terms"] if x.strip()]
        if w.get("enabled", True) and wanted:
            hit = F.lit(False)
            for x in wanted:
                hit = hit | hay.contains(x)
            found.append(F.when(hit & (F.col("importance") >= w["least"]), F.struct(level.alias("level"), F.lit(f"watch {w['name']}").alias("reason"), F.concat(F.lit(f"watch:{w['name']}:"), "event_id", version).alias("dedupe_key"))))
    rows = events.select("event_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("a")).select("event_id", "a.*")
    return rows if sent is None else rows.join(sent.select("dedupe_key"), "dedupe_key", "left_anti").select("event_id", "level", "reason", "dedupe_key")
