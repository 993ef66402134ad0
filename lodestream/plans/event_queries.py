"""Queries over events, orders and sources with their SQL: counts, trails, gates, verification, review, increments."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators import verify
from ..streaming import incremental
from .text_queries import t

#: Weights of topics for desks.
TOPIC_WEIGHTS = {
    "view": {"economy": 7}, "click": {"diplomacy_society": 5, "law_factcheck": 1}, "purchase": {"economy": 5, "conflict_security": 3, "diplomacy_society": 2},
    "signup": {"diplomacy_society": 4, "law_factcheck": 3}, "error": {"technology_infrastructure_disaster": 8, "conflict_security": 1},
}
DESKS = ("source_identity", "economy", "diplomacy_society", "conflict_security", "law_factcheck", "technology_infrastructure_disaster")


def list_topk_with_counts(s, d):
    return rel.top_events(t(s, d, "orders"), t(s, d, "lineitem"), t(s, d, "supplier"))


TOPK = """WITH top AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
SELECT o_orderkey, count(l_orderkey) AS articles, count(*) FILTER (l_returnflag = 'A') AS confirmed, count(*) FILTER (l_returnflag = 'N') AS unverified, count(*) FILTER (l_returnflag = 'R') AS disputed,
 count(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN coalesce(s_nationkey::VARCHAR, 'source:' || l_suppkey) END) AS families, greatest(0, 6 - count(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN coalesce(s_nationkey::VARCHAR, 'source:' || l_suppkey) END)) AS gaps
FROM top LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY o_orderkey"""


def source_trail_top4(s, d):
    return rel.source_trail(t(s, d, "lineitem"), t(s, d, "supplier"), t(s, d, "orders"))


TRAIL = """WITH r AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rk FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey, s_nationkey ORDER BY rk, l_shipdate DESC, l_linenumber, l_suppkey, l_partkey) = 1)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY rk, l_shipdate DESC, l_linenumber, l_suppkey, l_partkey) AS pos, s_nationkey, l_linenumber FROM b QUALIFY pos <= 4"""


def gated_semi(s, d):
    return rel.gated(t(s, d, "customer"), t(s, d, "orders"))


def outdated_or_missing(s, d):
    return rel.outdated(t(s, d, "customer"), t(s, d, "orders"), "1997-06-01")


OUTDATED = """WITH l AS (SELECT o_custkey, max(o_orderdate) AS last, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN last IS NULL THEN 'missing' WHEN last < TIMESTAMP '1997-06-01' THEN 'stale' ELSE 'open' END AS reason FROM customer LEFT JOIN l ON o_custkey = c_custkey WHERE last IS NULL OR last < TIMESTAMP '1997-06-01' OR status = 'O'"""


def admin_exists_filter(s, d):
    urgent = t(s, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45")
    o = t(s, d, "orders").where("o_orderstatus IN ('O', 'F')")
    return o.join(urgent, o.o_orderkey == urgent.l_orderkey, "left_semi").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(40).select("o_orderkey", "o_orderstatus")


ADMIN = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 45) ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 20"


def conditional_counts(s, d):
    o = t(s, d, "orders")
    return o.agg(F.count_if(F.col("o_orderstatus") == "O").alias("backlog"), F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).alias("completed"), F.count_if(F.col("o_orderstatus") == "P").alias("remanded"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_at"))


def ministry_distinct_case(s, d):
    o, l, n, u = t(s, d, "orders"), t(s, d, "lineitem"), t(s, d, "nation"), t(s, d, "supplier")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(u, l.l_suppkey == u.s_suppkey).join(F.broadcast(n), u.s_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("events"), F.countDistinct(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("active"), F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("o_orderkey"))).alias("disputed"))


MINISTRY = "SELECT n_name, count(DISTINCT o_orderkey) AS events, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS active, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN o_orderkey END) AS disputed FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"


def progress_pivot(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["O", "F", "P"]).count().na.fill(0).withColumn("total", F.col("O") + F.col("F") + F.col("P"))


PIVOT = "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'P') AS \"P\", count(*) FILTER (o_orderstatus IN ('O', 'F', 'P')) AS total FROM orders GROUP BY 1"


def health_summary_map(s, d):
    c = t(s, d, "customer").withColumn("health", F.when(F.col("c_acctbal") < 0, "failing").when(F.col("c_acctbal") < 1000, "degraded").otherwise("ok"))
    per = c.groupBy("health", "c_mktsegment").count()
    return per.groupBy("health").agg(F.sum("count").alias("sources"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "c_mktsegment", "count"))), ";").alias("by_category"))


HEALTH = "WITH c AS (SELECT CASE WHEN c_acctbal < 0 THEN 'failing' WHEN c_acctbal < 1000 THEN 'degraded' ELSE 'ok' END AS health, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT health, sum(n)::BIGINT AS sources, string_agg(c_mktsegment || '=' || n, ';' ORDER BY c_mktsegment || '=' || n) AS by_category FROM c GROUP BY health"


def coverage_matrix(s, d):
    r, n, u, l = t(s, d, "region"), t(s, d, "nation"), t(s, d, "supplier"), t(s, d, "lineitem")
    per = l.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("originals"))
    j = per.join(u, per.l_suppkey == u.s_suppkey).join(n, u.s_nationkey == n.n_nationkey)
    agg = j.groupBy("n_regionkey").agg(F.sum("n").alias("articles"), F.sum("originals").alias("originals"), F.countDistinct("n_nationkey").alias("families"))
    return r.join(agg, r.r_regionkey == agg.n_regionkey, "left").select("r_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("articles", "originals", "families")), (F.coalesce("articles", F.lit(0)) > 0).alias("present"))


MATRIX = "SELECT r_name, count(l_orderkey) AS articles, count(*) FILTER (l_returnflag <> 'R') AS originals, count(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN n_nationkey END) AS families, count(l_orderkey) > 0 AS present FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY r_name"


def coverage_buckets(s, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    got = t(s, d, "events").groupBy("user_id").agg(*(F.bool_or(F.col("event_type") == k).alias(k) for k in kinds))
    names = F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in kinds))

    def those(want):
        return F.array_join(F.transform(F.filter(names, lambda x: x["v"] == want), lambda x: x["k"]), ",")

    return got.select("user_id", those(True).alias("present"), those(False).alias("gaps"))


BUCKETS = "WITH k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS k), u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, k, EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND event_type = k) AS v FROM u, k) SELECT user_id, coalesce(string_agg(k, ',' ORDER BY k) FILTER (v), '') AS present, coalesce(string_agg(k, ',' ORDER BY k) FILTER (NOT v), '') AS gaps FROM g GROUP BY user_id"


def _versions(s, d):
    o = t(s, d, "orders")
    return o.select("o_custkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("version"), "o_orderkey")


def asof_latest_version(s, d):
    heads = t(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.pmod(F.col("c_custkey"), F.lit(7)) + 3).alias("head"))
    return rel.latest_as_of(_versions(s, d), heads, "o_custkey", "version", "head", ["o_orderkey"])


ASOF = "WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders) SELECT o_custkey, max(version) AS version, arg_max(o_orderkey, version) AS o_orderkey FROM v JOIN customer ON c_custkey = o_custkey WHERE version <= c_custkey % 7 + 3 GROUP BY o_custkey"


def snapshot_diff(s, d):
    o = t(s, d, "orders")

    def at(date):
        return o.where(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit(date))).groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))

    return rel.snapshot_diff(at("1996-01-01"), at("1997-01-01"), "o_custkey", "last")


DIFF = "WITH a AS (SELECT o_custkey, max(o_orderkey) AS old FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey, max(o_orderkey) AS new FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1) SELECT o_custkey, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change, old, new FROM a FULL JOIN b USING (o_custkey) WHERE old IS DISTINCT FROM new"


def summary_set_diff(s, d):
    e = t(s, d, "events")
    half = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-04"))
    a = e.groupBy("user_id").agg(F.collect_set(F.when(half, F.col("event_type"))).alias("a"), F.collect_set(F.when(~half, F.col("event_type"))).alias("b"))
    return a.select("user_id", F.array_join(F.array_sort(F.array_except("b", "a")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("removed"))


SETDIFF = "WITH k AS (SELECT user_id, event_type AS k, bool_or(ts < TIMESTAMP '2024-01-04') AS a, bool_or(ts >= TIMESTAMP '2024-01-04') AS b FROM events GROUP BY ALL) SELECT user_id, coalesce(string_agg(k, ',' ORDER BY k) FILTER (b AND NOT a), '') AS added, coalesce(string_agg(k, ',' ORDER BY k) FILTER (a AND NOT b), '') AS removed FROM k GROUP BY user_id"


def timeline_union(s, d):
    e = t(s, d, "events")
    items = e.where("event_type = 'error'").select(F.lit("claim").alias("kind"), "user_id", "ts", "event_id").unionByName(e.where("value > 50").select(F.lit("report").alias("kind"), "user_id", "ts", "event_id"))
    first = items.withColumn("k", F.row_number().over(W.partitionBy("user_id", "event_id").orderBy("kind"))).where("k = 1")
    return first.select("kind", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_id")


TIMELINE = "WITH i AS (SELECT 'claim' AS kind, user_id, ts, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'report', user_id, ts, event_id FROM events WHERE value > 50) SELECT kind, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_id FROM i QUALIFY row_number() OVER (PARTITION BY user_id, event_id ORDER BY kind) = 1"


def keyset_page(s, d):
    return rel.keyset_page(t(s, d, "events").select("event_id", "event_type"), "event_id", 500, 25)


KEYSET = "WITH p AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id DESC) AS k FROM events WHERE event_id < 500 QUALIFY k <= 26) SELECT event_id, event_type, (SELECT min(event_id) FROM p WHERE k <= 25 AND (SELECT max(k) FROM p) = 26) AS next_before FROM p WHERE k <= 25"


def case_ordered(s, d):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t(s, d, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey", "o_orderstatus")


def _evidence(s, d):
    e = t(s, d, "events")
    stance = F.element_at(F.create_map(*(F.lit(x) for kv in (("view", "reports"), ("click", "supports"), ("purchase", "supports"), ("signup", "reports"), ("error", "refutes")) for x in kv)), F.col("event_type"))
    return e.select((F.col("event_id") % 2500).alias("claim_id"), (F.col("user_id") % 40).alias("family"), stance.alias("stance"), (F.col("value") > 99).alias("has_primary"))


def chain_count_status(s, d):
    f = verify.families_by_stance(_evidence(s, d))
    c = F.col("claim_id")
    return f.select("claim_id", "chains", verify.status(c % 50 == 0, c % 61 == 0, c % 3 == 0, c % 5 == 0).alias("status"))


CHAINS = """WITH e AS (SELECT event_id % 2500 AS claim_id, user_id % 40 AS family, CASE event_type WHEN 'view' THEN 'reports' WHEN 'signup' THEN 'reports' WHEN 'error' THEN 'refutes' ELSE 'supports' END AS stance, value > 99 AS p FROM events),
f AS (SELECT claim_id, count(DISTINCT family) FILTER (stance = 'supports') AS s, count(DISTINCT family) FILTER (stance = 'reports') AS r, count(DISTINCT family) FILTER (stance = 'refutes') AS x, count(DISTINCT family) FILTER (stance IN ('supports', 'reports')) AS chains, bool_or(stance = 'refutes' AND p) AS px FROM e GROUP BY claim_id)
SELECT claim_id, chains, CASE WHEN claim_id % 50 = 0 THEN 'outdated' WHEN claim_id % 61 = 0 THEN 'disputed' WHEN x >= 2 OR px THEN 'refuted' WHEN x = 1 THEN 'disputed' WHEN s >= 2 THEN 'corroborated' WHEN claim_id % 3 = 0 AND s = 1 THEN 'reported' WHEN s = 1 THEN 'partially_corroborated' WHEN r > 0 AND claim_id % 5 = 0 THEN 'unverified' WHEN r > 0 THEN 'reported' ELSE 'unverified' END AS status FROM f"""


def supersession(s, d):
    return verify.supersession(t(s, d, "events").select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("unit"), F.col("value").alias("number"), F.col("ts").alias("at")))


SUPER = "WITH l AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL), o AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS by_id, min(value) AS figure FROM events JOIN l USING (user_id, event_type) WHERE ts = last GROUP BY ALL) SELECT event_id AS claim_id, by_id AS superseded_by FROM events JOIN l USING (user_id, event_type) JOIN o USING (user_id, event_type) WHERE ts < last AND n = 1 AND value <> figure"


def range_conflicts(s, d):
    """Figures that different suppliers give for one part within 48 hours."""
    e = t(s, d, "lineitem")
    q = F.when(F.col("l_linenumber") % 3 == 0, "exact").when(F.col("l_linenumber") % 3 == 1, "about").otherwise("at_least")
    low, high = verify.number_range(F.col("l_extendedprice"), q)
    claims = e.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.col("l_suppkey").alias("actor"), F.col("l_partkey").alias("unit"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("at"), low.alias("low"), high.alias("high"))
    return verify.conflicts(claims)


CONFLICT = """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, l_suppkey AS user_id, l_partkey AS unit, floor(epoch(l_shipdate))::BIGINT AS at, CASE l_linenumber % 3 WHEN 1 THEN l_extendedprice * 0.85 ELSE l_extendedprice END AS low,
  CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice * 1.15 ELSE 'inf'::DOUBLE END AS high FROM lineitem)
SELECT a.event_id AS left_id, b.event_id AS right_id FROM e a JOIN e b ON a.unit = b.unit AND a.event_id < b.event_id AND a.user_id <> b.user_id AND abs(a.at - b.at) <= 172800 WHERE greatest(a.low - b.high, b.low - a.high) > 1 AND greatest(a.low - b.high, b.low - a.high) / greatest(least(a.low, b.low), 1.0) > 0.1"""


def priority_scores(s, d):
    e = t(s, d, "events")
    end = F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00"))
    g = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("topics"), F.countDistinct(F.pmod("event_id", F.lit(9))).alias("families"), F.count_if(F.col("ts") >= end - F.expr("INTERVAL 6 HOURS")).alias("recent"), F.bool_or(F.col("event_type") == "error").alias("disputed"))
    importance = F.least(F.lit(100), 25 + 7 * F.col("topics") + F.least(F.lit(20), 3 * F.col("families")) + F.when(F.col("disputed"), 5).otherwise(0))
    return g.select("user_id", importance.cast("long").alias("importance"), F.least(F.lit(100), F.col("recent") * 12).cast("long").alias("heat"), F.when(F.col("recent") >= 4, "breaking").when(F.col("recent") >= 1, "active").otherwise("slow").alias("track"))


PRIORITY = "WITH g AS (SELECT user_id, count(DISTINCT event_type) AS t, count(DISTINCT event_id % 9) AS f, count(*) FILTER (ts >= TIMESTAMP '2024-01-29 18:00:00') AS r, bool_or(event_type = 'error') AS d FROM events GROUP BY 1) SELECT user_id, least(100, 25 + 7 * t + least(20, 3 * f) + CASE WHEN d THEN 5 ELSE 0 END)::BIGINT AS importance, least(100, r * 12)::BIGINT AS heat, CASE WHEN r >= 4 THEN 'breaking' WHEN r >= 1 THEN 'active' ELSE 'slow' END AS track FROM g"


def routing_rank(s, d):
    e = t(s, d, "events").select("user_id", F.col("event_type").alias("topic")).distinct()
    weights = e.sparkSession.createDataFrame([(k, m, w) for k, v in TOPIC_WEIGHTS.items() for m, w in v.items()], "topic string, desk string, weight long")
    order = F.array_position(F.array(*map(F.lit, DESKS)), F.col("desk"))
    g = e.join(F.broadcast(weights), "topic").groupBy("user_id", "desk").agg(F.sum("weight").alias("score"))
    return g.select("user_id", "desk", "score", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), order)).alias("pos"))


ROUTING = "WITH w(topic, desk, weight) AS (VALUES " + ", ".join(f"('{k}', '{m}', {w})" for k, v in TOPIC_WEIGHTS.items() for m, w in v.items()) + "), g AS (SELECT user_id, desk, sum(weight)::BIGINT AS score FROM (SELECT DISTINCT user_id, event_type FROM events) JOIN w ON topic = event_type GROUP BY ALL) SELECT user_id, desk, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, list_position([" + ", ".join(f"'{m}'" for m in DESKS) + "], desk)) AS pos FROM g"


def review_gaps(s, d):
    l = t(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("reprints"), F.countDistinct("l_suppkey").alias("families"), F.bool_or(F.col("l_returnflag") == "A").alias("confirmed"))
    o = t(s, d, "orders")
    j = o.join(l, o.o_orderkey == l.l_orderkey, "left")
    n = F.coalesce("n", F.lit(0))
    found = F.array_compact(F.array(F.when(n == 0, "NO_ORIGINAL_ARTICLE"), F.when((n > 0) & (F.col("reprints") == n), "ALL_ARTICLES_REPRINTS"), F.when(F.coalesce("families", F.lit(0)) < 2, "LOW_SOURCE_INDEPENDENCE"), F.when(~F.coalesce("confirmed", F.lit(False)), "NO_ACTIONABLE_CLAIMS")))
    high = F.col("o_totalprice") >= 250000
    return j.select("o_orderkey", F.array_join(found, ",").alias("gaps"), F.when(F.size(found) == 0, "approved").when(high, "remanded").otherwise("approved_with_warnings").alias("decision"))


GAPS = """WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(DISTINCT l_suppkey) AS f, bool_or(l_returnflag = 'A') AS c FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey, o_totalprice, concat_ws(',', CASE WHEN n IS NULL THEN 'NO_ORIGINAL_ARTICLE' END, CASE WHEN n > 0 AND r = n THEN 'ALL_ARTICLES_REPRINTS' END, CASE WHEN coalesce(f, 0) < 2 THEN 'LOW_SOURCE_INDEPENDENCE' END, CASE WHEN NOT coalesce(c, false) THEN 'NO_ACTIONABLE_CLAIMS' END) AS gaps FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, gaps, CASE WHEN gaps = '' THEN 'approved' WHEN o_totalprice >= 250000 THEN 'remanded' ELSE 'approved_with_warnings' END AS decision FROM g"""


def report_rows_six(s, d):
    ranked = routing_rank(s, d).select("user_id", "desk", "score")
    grid = t(s, d, "events").select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, DESKS))).alias("desk"))
    return grid.join(ranked, ["user_id", "desk"], "left").select("user_id", "desk", F.when(F.col("score").isNull(), "blocked").otherwise("completed").alias("state"), F.coalesce("score", F.lit(0)).alias("score"))


_DESKS = ", ".join(f"'{m}'" for m in DESKS)
SIX = f"WITH r AS ({ROUTING}) SELECT u.user_id, m.desk, CASE WHEN score IS NULL THEN 'blocked' ELSE 'completed' END AS state, coalesce(score, 0) AS score FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest([{_DESKS}]) AS desk) m LEFT JOIN r ON r.user_id = u.user_id AND r.desk = m.desk"


def briefing_sections(s, d):
    p = priority_scores(s, d).where("importance >= 70").orderBy(F.desc("importance"), F.desc("heat"), "user_id").limit(100)
    return p.groupBy("track").agg(F.count("*").alias("items"), F.max("importance").alias("top"), F.min("user_id").alias("first_id"))


BRIEF = f"SELECT track, count(*) AS items, max(importance) AS top, min(user_id) AS first_id FROM (SELECT * FROM ({PRIORITY}) WHERE importance >= 70 ORDER BY importance DESC, heat DESC, user_id LIMIT 100) GROUP BY track"


def due_sources(s, d):
    return incremental.due(incremental.fetch_health(t(s, d, "events")), "2024-01-30 00:00:00", 50)


_FOLD = """f AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events),
c AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fails FROM f),
h AS (SELECT user_id, max(ts) AS last_at, arg_max(fails, (ts, event_id)) AS fails FROM c GROUP BY 1),
b AS (SELECT user_id, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_fetch, fails, least(30 * 2 ** least(fails, 6), 360)::BIGINT AS wait_minutes, CASE WHEN fails >= 5 THEN 'failing' WHEN fails > 0 THEN 'degraded' ELSE 'ok' END AS health FROM h)"""


def fetch_health_fold(s, d):
    return incremental.fetch_health(t(s, d, "events"))


def rate_limit_fixed(s, d):
    return incremental.fixed_window(t(s, d, "events"), 3600, 2)


RATE = "SELECT user_id, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS calls, greatest(0, count(*) - 2) AS refused FROM events GROUP BY 1, 2"


def daily_budget(s, d):
    w = W.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return t(s, d, "events").select("event_id", F.count("*").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("used")).where("used <= 40")


BUDGET = "SELECT event_id, count(*) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events QUALIFY used <= 40"


def stream_dedupe(s, d):
    return incremental.run_available(s, f"{d}/events.parquet", lambda e: e.withWatermark("ts", "40 days").dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"), "append")


def stream_hourly(s, d):
    return incremental.run_available(s, f"{d}/events.parquet", lambda e: e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n"), "complete")


PAIRS = {
    "list_topk_with_counts": (list_topk_with_counts, TOPK), "source_trail_top4": (source_trail_top4, TRAIL),
    "gated_semi": (gated_semi, "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)"),
    "outdated_or_missing": (outdated_or_missing, OUTDATED), "admin_exists_filter": (admin_exists_filter, ADMIN),
    "conditional_counts": (conditional_counts, "SELECT count(*) FILTER (o_orderstatus = 'O') AS backlog, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS completed, count(*) FILTER (o_orderstatus = 'P') AS remanded, strftime(max(o_orderdate), '%Y-%m-%d') AS last_at FROM orders"),
    "ministry_distinct_case": (ministry_distinct_case, MINISTRY), "progress_pivot": (progress_pivot, PIVOT), "health_summary_map": (health_summary_map, HEALTH), "coverage_matrix": (coverage_matrix, MATRIX), "coverage_buckets": (coverage_buckets, BUCKETS),
    "asof_latest_version": (asof_latest_version, ASOF), "snapshot_diff": (snapshot_diff, DIFF), "summary_set_diff": (summary_set_diff, SETDIFF), "timeline_union": (timeline_union, TIMELINE), "keyset_page": (keyset_page, KEYSET),
    "case_ordered": (case_ordered, "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 30"),
    "chain_count_status": (chain_count_status, CHAINS), "supersession": (supersession, SUPER), "range_conflicts": (range_conflicts, CONFLICT), "priority_scores": (priority_scores, PRIORITY), "routing_rank": (routing_rank, ROUTING),
    "review_gaps": (review_gaps, GAPS), "report_rows_six": (report_rows_six, SIX), "briefing_sections": (briefing_sections, BRIEF),
    "due_sources": (due_sources, f"WITH {_FOLD} SELECT user_id, last_fetch, wait_minutes FROM b WHERE last_fetch::TIMESTAMP + wait_minutes * INTERVAL 1 MINUTE <= TIMESTAMP '2024-01-30 00:00:00' ORDER BY last_fetch, user_id LIMIT 50"),
    "fetch_health_fold": (fetch_health_fold, f"WITH {_FOLD} SELECT * FROM b"), "rate_limit_fixed": (rate_limit_fixed, RATE), "daily_budget": (daily_budget, BUDGET),
    "stream_dedupe": (stream_dedupe, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_hourly": (stream_hourly, "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
