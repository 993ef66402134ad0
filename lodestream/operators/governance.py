"""Cases under review: fingerprints of their evidence, the log of their states, readiness of reports, summaries, heat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import sinks

#: States that may follow each state of a case.
NEXT = {
    "pending": ["proposed", "failed"], "proposed": ["remanded", "approved", "failed"], "remanded": ["proposed", "failed"], "approved": ["dispatched", "failed"],
    "dispatched": ["completed", "failed"], "completed": ["proposed", "failed"], "failed": ["proposed"],
}
#: Claim states that a summary shows as not yet confirmed, and as disputed.
OPEN, DISPUTED = ("reported", "unverified", "partially_corroborated"), ("disputed", "refuted")
FALLBACK_ARTICLES = 4


def fingerprint(rows: DataFrame, key: str, columns: list[str], rules: str) -> DataFrame:
    """key, fingerprint: equal for equal multisets of rows in any order and for the same version of the rules.

    Two sums over slices of each row's SHA-256, which combine on the map side, so a key of any size costs no sort and
    no list. Null and the empty string count as different.
    """
    one = F.sha2(F.concat_ws("\x1f", F.lit(rules), *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns)), 256)

    def lane(at: int) -> Column:
        return F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")

    hashed = rows.select(key, one.alias("_h"))
    return hashed.groupBy(key).agg(F.concat_ws(":", F.count("*").cast("string"), lane(1), lane(16)).alias("fingerprint"))


def violations(log: DataFrame) -> DataFrame:
    """event_id, seq and fault of steps that the rules forbid. log: event_id, seq (gapless from 1), from_state, to_state.

    A step is joined with the one before it by (event_id, seq), so a case with a long log is no task of its own.
    """
    allowed = F.create_map(*(x for k, v in NEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    before = log.select("event_id", (F.col("seq") + 1).alias("seq"), F.col("to_state").alias("was"))
    j = log.join(before, ["event_id", "seq"], "left")
    forbidden = ~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("from_state")), F.col("to_state")), F.lit(False))
    fault = F.when(~F.col("from_state").eqNullSafe(F.coalesce("was", F.lit("pending"))), "broken chain").when(forbidden, "forbidden step")
    return j.withColumn("fault", fault).where("fault IS NOT NULL").select("event_id", "seq", "fault")


def append_steps(log: DataFrame, coming: DataFrame) -> DataFrame:
    """Steps to append: one per run, attempt, department and action, and none that the log has already."""
    name = F.concat_ws(":", "run_id", F.lit("attempt"), "attempt", "department", "action")
    return sinks.insert_absent(log.withColumn("step_key", name), coming.withColumn("step_key", name), ["step_key"], ["at"])


def reports_ready(reports: DataFrame, assigned: DataFrame, desks: int) -> DataFrame:
    """run_id, attempt, ready: every desk has reported, completed where it was assigned and blocked where not."""
    a = assigned.select("run_id", "desk").distinct().withColumn("_a", F.lit(True))
    j = reports.join(a, ["run_id", "desk"], "left")
    right = F.col("status") == F.when(F.col("_a"), "completed").otherwise("blocked")
    return j.groupBy("run_id", "attempt").agg(((F.count("*") == desks) & F.bool_and(F.coalesce(right, F.lit(False)))).alias("ready"))


def summary_items(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """event_id, section, party, item and text: what a summary of each event says, one row an item.

    A party's claims are its statements; others are confirmed or open by their status; disputed and refuted ones are also
    listed as disputes. An event without any claim shows its first four articles as open. claims: event_id, id, text,
    status, party; articles: event_id, id, title, excerpt, at.
    """
    status, party = F.col("status"), F.nullif(F.col("party"), F.lit(""))
    main = F.when(party.isNotNull(), "statements").when(status == "corroborated", "confirmed").when(status.isin(*OPEN), "unverified")
    sections = F.array_compact(F.array(main, F.when(status.isin(*DISPUTED), "disputed")))
    told = claims.select("event_id", F.explode(sections).alias("section"), party.alias("party"), F.col("id").cast("string").alias("item"), "text")
    bare = articles.join(claims.select("event_id").distinct(), "event_id", "left_anti")
    first = bare.withColumn("_k", F.row_number().over(W.partitionBy("event_id").orderBy("at", "id"))).where(F.col("_k") <= FALLBACK_ARTICLES)
    said = F.coalesce(F.nullif(F.trim("excerpt"), F.lit("")), F.col("title"))
    return told.unionByName(first.select("event_id", F.lit("unverified").alias("section"), F.lit(None).cast("string").alias("party"), F.concat(F.lit("article:"), "id").alias("item"), said.alias("text")))


def heat(articles: DataFrame, importance: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """event_id, recent, heat and track_mode from the articles of the last hours. articles: event_id, at, family; importance: event_id, importance, families."""
    n = articles.groupBy("event_id").agg(F.count_if(F.col("at") >= now - F.make_dt_interval(hours=F.lit(hours))).alias("recent"), F.count("*").alias("n"))
    j = importance.join(n, "event_id", "left").withColumn("recent", F.coalesce("recent", F.lit(0)))
    score = F.least(F.lit(100.0), F.floor(F.col("recent") * 10 + F.col("families") * 5 + F.col("importance") * 0.25 + 0.5)).cast("int")
    busy = F.col("recent") >= 2
    mode = F.when(busy & (F.col("importance") >= 80), "breaking").when(busy, "active").when(F.col("n") > 5, "normal").otherwise("slow")
    return j.select("event_id", "recent", score.alias("heat"), mode.alias("track_mode"))
