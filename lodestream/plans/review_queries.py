"""Queries over cases under review and their heat, and exact windows of a stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import governance
from ..streaming import incremental
from .text_queries import t

RULES = "rules-1"


def input_fingerprint(s, d):
    return governance.fingerprint(t(s, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_returnflag"], RULES)


FINGERPRINT = f"""WITH h AS (SELECT l_orderkey, sha256('{RULES}' || chr(31) || '=' || l_linenumber || chr(31) || '=' || l_partkey || chr(31) || '=' || l_returnflag) AS h FROM lineitem)
SELECT l_orderkey, count(*) || ':' || sum(('0x' || left(h, 15))::BIGINT::HUGEINT) || ':' || sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT) AS fingerprint FROM h GROUP BY l_orderkey"""


def workflow_violations(s, d):
    states = F.array(*map(F.lit, governance.NEXT))
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    log = t(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.element_at(states, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("to_state"))
    before = F.when(F.col("o_orderkey") % 11 != 0, F.coalesce(F.lag("to_state").over(w), F.lit("pending"))).otherwise("remanded")
    return governance.violations(log.select(F.col("o_custkey").alias("event_id"), F.row_number().over(w).alias("seq"), before.alias("from_state"), "to_state"))


_ALLOWED = ", ".join(f"'{a}>{b}'" for a, bs in governance.NEXT.items() for b in bs)
VIOLATIONS = f"""WITH s AS (SELECT *, [{', '.join(f"'{k}'" for k in governance.NEXT)}][o_orderkey % 7 + 1] AS st FROM orders),
l AS (SELECT o_custkey AS event_id, row_number() OVER w AS seq, coalesce(lag(st) OVER w, 'pending') AS was, o_orderkey, st FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
f AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'remanded' ELSE was END AS fr FROM l)
SELECT event_id, seq, CASE WHEN fr <> was THEN 'broken chain' ELSE 'forbidden step' END AS fault FROM f WHERE fr <> was OR fr || '>' || st NOT IN ({_ALLOWED})"""


def workflow_appends(s, d):
    e = t(s, d, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 3).alias("attempt"), F.col("event_type").alias("department"), F.lit("act").alias("action"), F.struct("ts", "event_id").alias("at"), "event_id")
    return governance.append_steps(e.where("event_id < 500"), e.where("event_id >= 500")).select("step_key", "event_id")


APPENDS = """WITH e AS (SELECT *, user_id || ':attempt:' || event_id % 3 || ':' || event_type || ':act' AS step_key FROM events)
SELECT step_key, arg_min(event_id, (ts, event_id)) AS event_id FROM e WHERE event_id >= 500 AND step_key NOT IN (SELECT step_key FROM e WHERE event_id < 500) GROUP BY step_key"""


def reports_ready(s, d):
    x = t(s, d, "lineitem").where("l_linenumber <= 6").select(F.col("l_orderkey").alias("run_id"), F.lit(1).alias("attempt"), F.col("l_linenumber").alias("desk"), F.when(F.col("l_partkey") % 50 == 0, "failed").when(F.col("l_linenumber") <= 3, "completed").otherwise("blocked").alias("status"))
    return governance.reports_ready(x, x.where("desk <= 3").select("run_id", "desk"), 6)


READY = "SELECT l_orderkey AS run_id, 1 AS attempt, count(*) = 6 AND bool_and(l_partkey % 50 <> 0) AS ready FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1"


def event_summary_items(s, d):
    e, o = t(s, d, "events"), t(s, d, "orders")
    status = F.element_at(F.array(*map(F.lit, ("corroborated", "reported", "unverified", "disputed", "refuted", "outdated"))), (F.col("event_id") % 6 + 1).cast("int"))
    claims = e.select((F.col("user_id") * 3).alias("event_id"), F.col("event_id").alias("id"), F.col("props").alias("text"), status.alias("status"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise("").alias("party"))
    articles = o.select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" ").alias("excerpt"), F.col("o_orderdate").alias("at"))
    return governance.summary_items(claims, articles)


SUMMARY_ITEMS = """WITH c AS (SELECT user_id * 3 AS event_id, event_id AS id, props AS text, event_id % 6 AS st, CASE WHEN event_id % 5 = 0 THEN nullif(event_type, '') END AS party FROM events),
s AS (SELECT *, CASE WHEN party IS NOT NULL THEN 'statements' WHEN st = 0 THEN 'confirmed' WHEN st IN (1, 2) THEN 'unverified' END AS section FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_custkey NOT IN (SELECT event_id FROM c WHERE event_id IS NOT NULL))
SELECT event_id, section, party, id::VARCHAR AS item, text FROM s WHERE section IS NOT NULL UNION ALL SELECT event_id, 'disputed', party, id::VARCHAR, text FROM s WHERE st IN (3, 4)
UNION ALL SELECT o_custkey, 'unverified', NULL, 'article:' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END FROM a WHERE k <= 4"""

_NOW = "2024-01-29 12:00:00"


def recency_heat(s, d):
    e = t(s, d, "events")
    importance = e.groupBy(F.col("user_id").alias("event_id")).agg((F.max("event_id") % 101).alias("importance"), F.count_distinct("event_type").alias("families"))
    return governance.heat(e.select(F.col("user_id").alias("event_id"), F.col("ts").alias("at")), importance, F.expr(f"TIMESTAMP_NTZ '{_NOW}'"))


HEAT = f"""WITH g AS (SELECT user_id AS event_id, max(event_id) % 101 AS imp, count(DISTINCT event_type) AS fam, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '{_NOW}' - INTERVAL 6 HOUR) AS recent FROM events GROUP BY 1)
SELECT event_id, recent, least(100, floor(recent * 10 + fam * 5 + imp * 0.25 + 0.5))::INTEGER AS heat, CASE WHEN recent >= 2 AND imp >= 80 THEN 'breaking' WHEN recent >= 2 THEN 'active' WHEN n > 5 THEN 'normal' ELSE 'slow' END AS track_mode FROM g"""


def rate_limit_exact(s, d):
    return incremental.run_available(s, f"{d}/events.parquet", lambda e: incremental.rate_limit(e, 86400, 3), "append")


EXACT = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, ts AS start, k, 1::BIGINT AS nth FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, CASE WHEN e.ts >= w.start + INTERVAL 1 DAY THEN e.ts ELSE w.start END, e.k, CASE WHEN e.ts >= w.start + INTERVAL 1 DAY THEN 1 ELSE w.nth + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id, nth, nth > 3 AS refused FROM w"""

PAIRS = {
    "input_fingerprint": (input_fingerprint, FINGERPRINT), "workflow_violations": (workflow_violations, VIOLATIONS), "workflow_appends": (workflow_appends, APPENDS), "reports_ready": (reports_ready, READY),
    "event_summary_items": (event_summary_items, SUMMARY_ITEMS), "recency_heat": (recency_heat, HEAT), "rate_limit_exact": (rate_limit_exact, EXACT),
}
