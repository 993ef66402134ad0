"""Fenced writes and runs: summaries saved against a version, briefings, watchlists, retention, leases of runs.

Each takes the table as it is and the rows that come, and returns rows with the outcome; nothing is written here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Channels a watchlist may name, and its limits.
CHANNELS = ("web", "telegram", "email", "push")
MOST_TERMS, MOST_NAME = 50, 100


def save_summaries(events: DataFrame, coming: DataFrame) -> DataFrame:
    """id, outcome, version, summary, engine and old_version of every summary that comes; one a key.

    events: id, version, last_update, summary, engine. coming: id, summary, engine, seen_version, seen_update (null: no
    fence). ``stale``: the event moved on since it was read, and stays. ``unchanged``: same summary and engine, so the
    version stays too. ``saved``: the version grows and the old summary is to be appended as version ``old_version``.
    ``missing``: no such event.
    """
    new = coming.select("id", F.col("summary").alias("_s"), F.col("engine").alias("_e"), "seen_version", "seen_update")
    j = new.join(events.select("id", "version", "last_update", "summary", "engine"), "id", "left")
    moved = F.col("seen_version").isNotNull() & ~(F.col("seen_version").eqNullSafe(F.col("version")) & F.col("seen_update").eqNullSafe(F.col("last_update")))
    same = F.col("summary").isNotNull() & F.col("summary").eqNullSafe(F.col("_s")) & F.col("engine").eqNullSafe(F.col("_e"))
    outcome = F.when(F.col("version").isNull(), "missing").when(moved, "stale").when(same, "unchanged").otherwise("saved")
    saved = F.col("outcome") == "saved"
    return j.withColumn("outcome", outcome).select(
        "id", "outcome", F.when(saved, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(saved, F.col("_s")).otherwise(F.col("summary")).alias("summary"), F.when(saved, F.col("_e")).otherwise(F.col("engine")).alias("engine"),
        F.when(saved, F.col("version")).alias("old_version"),
    )


def save_briefings(table: DataFrame, coming: DataFrame) -> DataFrame:
    """The table of briefings after those that come: one per type and period, the last one wins, prev_id is kept once set.

    table: id, type, period, created_at, content, prev_id; coming: the same without id and prev_id. A new briefing's
    prev_id is the latest one of its type before it. The window is over the briefings of one type: a few a day.
    """
    key = ["type", "period"]
    last = coming.groupBy(*key).agg(F.max(F.struct("created_at", "content")).alias("r")).select(*key, F.col("r.created_at").alias("_at"), F.col("r.content").alias("_c"))
    j = table.join(last, key, "full_outer")
    name = F.concat(F.lit("brf_"), F.substring(F.sha2(F.concat_ws(":", *key), 256), 1, 20))
    rows = j.select(F.coalesce("id", name).alias("id"), *key, F.coalesce("_at", "created_at").alias("created_at"), F.coalesce("_c", "content").alias("content"), "prev_id", F.col("id").isNull().alias("_new"))
    before = F.lag("id").over(W.partitionBy("type").orderBy("created_at", "period"))
    return rows.withColumn("prev_id", F.when(F.col("_new"), before).otherwise(F.col("prev_id"))).drop("_new")


def clean_watchlists(rows: DataFrame) -> DataFrame:
    """Watchlists as they are stored: terms trimmed, none empty, 50 at most; importance from 0 to 100, 40 unless said; known channels only."""

    def terms(name: str) -> Column:
        some = F.filter(F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
        return F.slice(some, 1, MOST_TERMS)

    channels = F.filter(F.coalesce("channels", F.array(F.lit("web"))), lambda c: c.isin(*CHANNELS))
    return rows.withColumns({
        "name": F.substring("name", 1, MOST_NAME), "keywords": terms("keywords"), "entities": terms("entities"), "channels": channels,
        "min_importance": F.least(F.greatest(F.coalesce("min_importance", F.lit(40)), F.lit(0)), F.lit(100)), "enabled": F.coalesce("enabled", F.lit(True)),
    })


def retain(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days; rows without a time are kept. On a table laid out by day the filter prunes folders."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= now - F.make_dt_interval(days=F.lit(days))))


def run_id(event: Column, inputs: Column, rules: str) -> Column:
    """Same event, inputs and rules: same run."""
    return F.concat(F.lit("wfr_"), F.substring(F.sha2(F.concat_ws("\n", event.cast("string"), inputs, F.lit(rules)), 256), 1, 24))


def backoff_seconds(attempt: Column) -> Column:
    """Wait after a failed attempt: 30 s, doubled each time, an hour at most."""
    return F.least(F.lit(3600.0), 30.0 * F.pow(F.lit(2.0), F.least(attempt, F.lit(20)) - 1)).cast("long")


def acquire_runs(asked: DataFrame, runs: DataFrame, now: Column, lease_seconds: int = 300) -> DataFrame:
    """event_id, run_id, attempt, goes, reason and lease_until of each run that is asked for.

    asked: event_id, run_id, active_run_id (null: none), one row an event. runs: run_id, status, attempt, lease_until,
    next_attempt_at. Another run of the event that holds a lease, or this one, is not taken over; a finished run is not
    repeated; a failed one waits for its time. Two joins by run_id.
    """
    states = [F.col(c) for c in ("status", "attempt", "lease_until", "next_attempt_at")]
    mine = runs.select("run_id", F.struct(*states).alias("_m"))
    other = runs.select(F.col("run_id").alias("active_run_id"), F.struct(*states).alias("_a"))
    j = asked.join(mine, "run_id", "left").join(other, "active_run_id", "left")

    def held(r: str) -> Column:
        return F.coalesce((F.col(f"{r}.status") == "running") & (F.col(f"{r}.lease_until") > now), F.lit(False))

    blocked = held("_a") & (F.col("active_run_id") != F.col("run_id"))
    reason = (
        F.when(blocked, "leased").when(F.col("_m").isNull(), "new").when(F.col("_m.status").isin("completed", "remanded"), "already-finished")
        .when(held("_m"), "leased").when(F.col("_m.next_attempt_at") > now, "backoff").otherwise("retry")
    )
    goes = F.col("reason").isin("new", "retry")
    attempt = F.when(blocked, F.col("_a.attempt")).when(F.col("reason") == "new", 1).otherwise(F.col("_m.attempt") + F.when(goes, 1).otherwise(0))
    return j.withColumn("reason", reason).select(
        "event_id", F.when(blocked, F.col("active_run_id")).otherwise(F.col("run_id")).alias("run_id"), attempt.alias("attempt"), goes.alias("goes"), "reason",
        F.when(goes, now + F.make_dt_interval(secs=F.lit(lease_seconds))).alias("lease_until"),
    )
