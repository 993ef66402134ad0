"""Queries over feeds and writes with their SQL: feeds that are written and read back, inserts, upserts, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sinks
from ..sources import feeds
from .text_queries import t


def _turns(s, d):
    c = t(s, d, "conversations")
    return c.select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("https://example.org/"), "conv_id", F.lit("?turn="), "turn", F.lit("&a=1")).alias("url"), F.concat_ws("-", "conv_id", "turn").alias("guid"), F.col("role").alias("title"), F.regexp_replace("text", r"\s+", " ").alias("summary_html"))


def _back(df):
    return df.select("conv_id", "url", "guid", "title", F.trim(F.coalesce("summary_html", F.lit(""))).alias("summary"))


def feed_rss_round_trip(s, d):
    return _back(feeds.parse_xml(feeds.render_rss(_turns(s, d), "conv_id")))


def feed_json_round_trip(s, d):
    return _back(feeds.parse_json_feed(feeds.render_json_feed(_turns(s, d), "conv_id")))


ROUND_TRIP = r"SELECT conv_id, 'https://example.org/' || conv_id || '?turn=' || turn || '&a=1' AS url, conv_id || '-' || turn AS guid, role AS title, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS summary FROM conversations WHERE role <> ''"


def sink_insert_absent(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "event_type")
    return sinks.insert_absent(e.where("event_type IN ('view', 'click') AND event_id < 100").select("user_id"), e.where("event_id >= 100"), ["user_id"], ["event_id"])


INSERT = "SELECT min(event_id) AS event_id, user_id, arg_min(event_type, event_id) AS event_type FROM events WHERE event_id >= 100 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type IN ('view', 'click') AND event_id < 100) GROUP BY user_id"


def sink_upsert(s, d):
    o = t(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("descr"), F.col("o_orderstatus").alias("status"))
    early = o.where(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1996-01-01")))
    table = early.groupBy("o_custkey").agg(F.max_by(F.struct("descr", "status"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.*")
    coming = o.where(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1996-01-01")))
    return sinks.upsert(table, coming, "o_custkey", ["o_orderdate", "o_orderkey"], ["status"])


UPSERT = """WITH a AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS d, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
b AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS d, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT o_custkey, coalesce(b.d, a.d) AS descr, coalesce(a.s, b.s) AS status FROM a FULL JOIN b USING (o_custkey)"""


def sink_changed_versions(s, d):
    return sinks.changed_versions(t(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")


VERSIONS = "WITH x AS (SELECT *, lag(o_orderstatus) OVER w AS old, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderstatus, CASE WHEN k = 1 THEN 'initial' ELSE 'modified' END AS note FROM x WHERE k = 1 OR o_orderstatus <> old"

PAIRS = {
    "feed_rss_round_trip": (feed_rss_round_trip, ROUND_TRIP), "feed_json_round_trip": (feed_json_round_trip, ROUND_TRIP),
    "sink_insert_absent": (sink_insert_absent, INSERT), "sink_upsert": (sink_upsert, UPSERT), "sink_changed_versions": (sink_changed_versions, VERSIONS),
}
