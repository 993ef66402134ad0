"""Queries of event lists, details, coverage, reports, briefings and answers with their SQL, on stand-in tables.

Orders stand for events, line items for claims and articles, suppliers for sources, nations for parties.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, desk, search
from ..session import spread
from .text_queries import t

TOPICS = ("conflict", "diplomacy", "economy", "health", "investigation")
_EVENTS = """events_ AS (SELECT o_orderkey AS event_id, floor(o_totalprice / 3000)::INT AS importance, o_orderkey % 97 AS heat, ['conflict', 'diplomacy', 'economy', 'health', 'investigation'][o_orderkey % 5 + 1] AS topic, CASE WHEN o_custkey % 3 = 0 THEN 'cn' ELSE 'us' END AS country,
 o_orderkey % 50 = 0 AS breaking, o_orderdate AS updated, o_orderstatus AS status, o_custkey, o_orderkey % 4 AS version FROM orders),
cases AS (SELECT event_id, ['draft', 'approved', 'completed', 'remanded', 'reporting'][event_id % 5 + 1] AS state, event_id % 2 = 0 AS publishable, CASE WHEN event_id % 4 > 0 THEN updated END AS completed_at FROM events_)"""
_CLAIMS = """lines_ AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag, min(l_suppkey) AS source_id, min(l_shipdate) AS moment, ['AIR', 'RAIL', 'SHIP', 'TRUCK', 'MAIL', 'FOB'][min(l_partkey) % 6 + 1] AS desk, max(l_quantity)::INT AS score FROM lineitem GROUP BY ALL),
claims_ AS (SELECT l_orderkey AS event_id, l_orderkey * 10 + l_linenumber AS claim_id, CASE flag WHEN 'A' THEN 'corroborated' WHEN 'R' THEN 'disputed' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'reported' ELSE 'unverified' END END AS status, source_id, moment, l_linenumber, desk, score FROM lines_)"""
DESKS = ("AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB")


def _events(s, d):
    o, key = t(s, d, "orders"), F.col("o_orderkey")
    return o.select(key.alias("event_id"), F.floor(F.col("o_totalprice") / 3000).cast("int").alias("importance"), (key % 97).alias("heat"), F.get(F.array(*map(F.lit, TOPICS)), (key % 5).cast("int")).alias("topic"), F.when(F.col("o_custkey") % 3 == 0, "cn").otherwise("us").alias("country"),
                    (key % 50 == 0).alias("breaking"), F.col("o_orderdate").alias("updated"), F.col("o_orderstatus").alias("status"), "o_custkey", (key % 4).alias("version"))


def _cases(s, d):
    key = F.col("event_id")
    return _events(s, d).select(key, F.get(F.array(*map(F.lit, ("draft", "approved", "completed", "remanded", "reporting"))), (key % 5).cast("int")).alias("state"), (key % 2 == 0).alias("publishable"), F.when(key % 4 > 0, F.col("updated")).alias("completed_at"))


def _claims(s, d):
    lines = t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.min("l_suppkey").alias("source_id"), F.min("l_shipdate").alias("at"), F.min("l_partkey").alias("part"), F.max("l_quantity").cast("int").alias("score"))
    flag = F.col("flag")
    status = F.when(flag == "A", "corroborated").when(flag == "R", "disputed").when(F.col("l_linenumber") % 2 == 0, "reported").otherwise("unverified")
    return lines.select(F.col("l_orderkey").alias("event_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), status.alias("status"), "source_id", "at", "l_linenumber", F.get(F.array(*map(F.lit, DESKS)), (F.col("part") % 6).cast("int")).alias("desk"), "score")


def event_tabs(s, d):
    e, c = _events(s, d), _cases(s, d)
    pages = [desk.event_list(e, c, since="1995-01-01", least=20, tab=tab, reviewed=True, limit=40, offset=5).select("event_id", F.lit(tab).alias("tab")) for tab in ("breaking", "domestic", "intl", "diplomacy", "economy")]
    ids = t(s, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("event_id"))
    pages.append(desk.event_list(e, c, ids=ids, topic="health", country="us", publishable=True, limit=900).select("event_id", F.lit("ids").alias("tab")))
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


_TAB = {"breaking": "(breaking OR importance >= 70)", "domestic": "country = 'cn'", "intl": "country <> 'cn'", "diplomacy": "topic IN ('diplomacy', 'conflict')", "economy": "topic IN ('economy')"}
TABS = f"WITH {_EVENTS} " + " UNION ALL ".join(
    f"(SELECT event_id, '{k}' AS tab FROM events_ e WHERE updated >= TIMESTAMP '1995-01-01' AND importance >= 20 AND {v} AND EXISTS (SELECT 1 FROM cases c WHERE c.event_id = e.event_id AND state IN ('remanded', 'approved', 'dispatched', 'completed')) ORDER BY importance DESC, heat DESC, updated DESC, event_id LIMIT 40 OFFSET 5)" for k, v in _TAB.items()
) + """ UNION ALL (SELECT event_id, 'ids' AS tab FROM events_ e WHERE topic = 'health' AND country = 'us' AND event_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) AND EXISTS (SELECT 1 FROM cases c WHERE c.event_id = e.event_id AND state = 'completed' AND publishable AND completed_at IS NOT NULL)
 ORDER BY importance DESC, heat DESC, updated DESC, event_id LIMIT 200)"""


def _detailed(s, d):
    c = _claims(s, d)
    articles = c.select(F.col("claim_id").alias("article_id"), "source_id", "event_id", F.col("at").alias("published"))
    evidence = c.select("claim_id", F.col("claim_id").alias("article_id"), F.when(F.col("status") == "disputed", "disputes").otherwise("reports").alias("stance")).where("claim_id % 3 > 0")
    evidence = evidence.unionByName(c.where("l_linenumber > 1").select("claim_id", (F.col("claim_id") - 1).alias("article_id"), F.lit("supports").alias("stance")))
    sources = t(s, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    return desk.claims_with_evidence(c, evidence, articles, sources), articles


def _said(x):
    return F.concat_ws(":", x["article_id"].cast("string"), x["stance"], x["source"])


def claims_nested(s, d):
    return _detailed(s, d)[0].select("claim_id", "status", F.array_join(F.transform("evidence", _said), ";").alias("evidence"))


_NESTED = f"""{_CLAIMS}, ev AS (SELECT claim_id, claim_id AS article_id, CASE WHEN status = 'disputed' THEN 'disputes' ELSE 'reports' END AS stance FROM claims_ WHERE claim_id % 3 > 0 UNION ALL SELECT claim_id, claim_id - 1, 'supports' FROM claims_ WHERE l_linenumber > 1),
nested AS (SELECT c.claim_id, c.event_id, c.status, coalesce(string_agg(ev.article_id || ':' || stance || ':' || s_name, ';' ORDER BY ev.article_id, stance) FILTER (s_name IS NOT NULL), '') AS evidence
 FROM claims_ c LEFT JOIN ev USING (claim_id) LEFT JOIN claims_ a ON a.claim_id = ev.article_id LEFT JOIN supplier ON s_suppkey = a.source_id GROUP BY ALL)"""
NESTED = f"WITH {_NESTED} SELECT claim_id, status, evidence FROM nested"


def event_detail(s, d):
    claims, articles = _detailed(s, d)
    out = desk.event_detail(_events(s, d).select("event_id", "importance"), claims, articles)
    one = F.transform("claims", lambda c: F.concat(c["claim_id"].cast("string"), F.lit("="), c["status"], F.lit("["), F.array_join(F.transform(c["evidence"], _said), ";"), F.lit("]")))
    return out.select("event_id", "importance", F.coalesce(F.array_join(one, "|"), F.lit("")).alias("claims"), F.coalesce(F.array_join(F.transform("articles", lambda a: a["article_id"].cast("string")), ","), F.lit("")).alias("articles"))


DETAIL = f"""WITH {_EVENTS}, {_NESTED}, c AS (SELECT event_id, string_agg(claim_id || '=' || status || '[' || evidence || ']', '|' ORDER BY claim_id) AS claims FROM nested GROUP BY 1),
a AS (SELECT event_id, string_agg(claim_id::VARCHAR, ',' ORDER BY moment, claim_id) AS articles FROM claims_ GROUP BY 1)
SELECT e.event_id, importance, coalesce(claims, '') AS claims, coalesce(articles, '') AS articles FROM events_ e LEFT JOIN c USING (event_id) LEFT JOIN a USING (event_id)"""


def client_tabs(s, d):
    """How many events stand under each tab of what is shown, and of how many breaking ones."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    topic = lambda n: F.get(F.array(*map(F.lit, ("security", "tech", "health", "policy", "conflict"))), (k % n).cast("int"))
    country = F.get(F.array(*map(F.lit, ("cn", "CHN", "us", "中国", "fr", "de"))), (c % 6).cast("int"))
    e = t(s, d, "orders").select(F.when(k % 9 == 0, "breaking").alias("track_mode"), F.when(k % 7 == 0, "developing").otherwise("stable").alias("status"), F.array(topic(5), topic(3)).alias("topics"), F.when(c % 11 > 0, F.array(country)).alias("countries"))
    out = None
    for tab in ("breaking", "domestic", "intl", "diplomacy", "economy", "all"):
        n = e.where(desk.matches_tab(tab)).agg(F.lit(tab).alias("tab"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


CLIENT = """WITH e AS (SELECT coalesce(o_orderkey % 9 = 0 OR o_orderkey % 7 = 0, false) AS breaking, o_custkey % 11 > 0 AND o_custkey % 6 IN (0, 1, 3) AS home, [['security', 'tech', 'health', 'policy', 'conflict'][o_orderkey % 5 + 1], ['security', 'tech', 'health'][o_orderkey % 3 + 1]] AS t FROM orders)
SELECT unnest(['breaking', 'domestic', 'intl', 'diplomacy', 'economy', 'all']) AS tab, unnest([count(*) FILTER (breaking), count(*) FILTER (home), count(*) FILTER (NOT home), count(*) FILTER (list_has_any(t, ['security', 'conflict'])), count(*) FILTER (list_has_any(t, ['tech', 'policy'])), count(*)]) AS n FROM e"""


def status_histogram(s, d):
    return desk.histogram(_claims(s, d))


HISTOGRAM = f"WITH {_CLAIMS} SELECT event_id, {', '.join(f'''count(*) FILTER (status = '{x}') AS {x}''' for x in desk.STATUSES)} FROM claims_ GROUP BY 1"


def source_list(s, d):
    health = F.when(F.col("s_suppkey") % 7 == 0, "disabled").otherwise(F.when(F.col("s_acctbal") < 0, "failing").otherwise("ok"))
    return t(s, d, "supplier").select("s_suppkey", health.alias("health")).where("health IN ('disabled', 'failing')")


SOURCES = "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'disabled' ELSE 'failing' END AS health FROM supplier WHERE s_suppkey % 7 = 0 OR s_acctbal < 0"


def queue_counts(s, d):
    part = F.when(F.col("state").isin("completed"), "completed").when(F.col("state").isin("draft") & ~F.col("publishable"), "attention").otherwise("active")
    return _cases(s, d).groupBy(part.alias("queue")).agg(F.count("*").alias("n"), F.max("completed_at").cast("string").alias("last"))


QUEUE = f"WITH {_EVENTS} SELECT CASE WHEN state = 'completed' THEN 'completed' WHEN state = 'draft' AND NOT publishable THEN 'attention' ELSE 'active' END AS queue, count(*) AS n, max(completed_at)::VARCHAR AS last FROM cases GROUP BY 1"


def alert_inbox(s, d):
    return _events(s, d).orderBy(F.desc("updated"), "event_id").limit(100).where("importance >= 40 AND heat % 2 = 1").select("event_id", "importance")


INBOX = f"WITH {_EVENTS} SELECT event_id, importance FROM (SELECT * FROM events_ ORDER BY updated DESC, event_id LIMIT 100) WHERE importance >= 40 AND heat % 2 = 1"


def active_of_top(s, d):
    top = desk.event_list(_events(s, d), _cases(s, d), limit=10)
    return top.agg(F.count("*").alias("top"), F.count_if(F.col("status").isin("O", "P")).alias("active"))


ACTIVE = f"WITH {_EVENTS} SELECT count(*) AS top, count(*) FILTER (status IN ('O', 'P')) AS active FROM (SELECT * FROM events_ ORDER BY importance DESC, heat DESC, updated DESC, event_id LIMIT 10)"


def fetch_log_named(s, d):
    e, c = t(s, d, "events"), t(s, d, "customer")
    return e.join(c, e.user_id == c.c_custkey, "left").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type", F.col("c_name").alias("source_name"))


LOG = "SELECT event_id, event_type, c_name AS source_name FROM events LEFT JOIN customer ON c_custkey = user_id ORDER BY ts DESC, event_id DESC LIMIT 500"


def current_reports(s, d):
    c = _claims(s, d)
    reports = c.select("event_id", "desk", "claim_id", (F.col("source_id") % 3).alias("attempt"))
    runs = _events(s, d).select("event_id", (F.col("heat") % 3).alias("attempt"))
    assigned = c.where("score > 25").groupBy("event_id", "desk").agg(F.max("score").alias("score"))
    return reports.join(_cases(s, d).where("state = 'completed'").select("event_id"), "event_id").join(runs, ["event_id", "attempt"]).join(assigned, ["event_id", "desk"], "left").select("event_id", "desk", "attempt", "claim_id", "score")


REPORTS = f"WITH {_EVENTS}, {_CLAIMS}, a AS (SELECT event_id, desk, max(score) AS score FROM claims_ WHERE score > 25 GROUP BY ALL) SELECT r.event_id, r.desk, r.source_id % 3 AS attempt, r.claim_id, a.score FROM claims_ r JOIN cases c ON c.event_id = r.event_id AND c.state = 'completed' JOIN events_ e ON e.event_id = r.event_id AND e.heat % 3 = r.source_id % 3 LEFT JOIN a ON a.event_id = r.event_id AND a.desk = r.desk"


def _items(e, line, status):
    return e.select("event_id", F.when(F.col("heat") == 7, "note").alias("note"), (F.col("version") % line).cast("string").alias("line"), (F.col("heat") % status).cast("string").alias("status"))


def briefing_changes(s, d):
    e = _events(s, d).where("importance >= 70")
    return desk.briefing_delta(_items(e, 4, 5), _items(e.where("event_id % 3 > 0"), 3, 4))


DELTA = f"WITH {_EVENTS} SELECT event_id, (version % 4)::VARCHAR AS line, CASE WHEN event_id % 3 = 0 THEN 'new' WHEN heat = 7 OR version % 4 <> version % 3 OR heat % 5 <> heat % 4 THEN 'changed' ELSE 'same' END AS delta FROM events_ WHERE importance >= 70"


def routed_events(s, d):
    seats = _claims(s, d).select("event_id", F.struct("l_linenumber", "desk").alias("seat"), (F.col("l_linenumber") == 1).alias("first"))
    per = seats.groupBy("event_id").agg(F.max(F.when(F.col("first"), F.col("seat.desk"))).alias("main"), F.array_sort(F.collect_list(F.when(~F.col("first"), F.col("seat")))).alias("others"))
    return _events(s, d).join(per, "event_id", "left").select("event_id", "main", F.coalesce(F.array_join(F.transform("others", lambda x: x["desk"]), ","), F.lit("")).alias("collaborators"))


ROUTED = f"WITH {_EVENTS}, {_CLAIMS}, p AS (SELECT event_id, max(desk) FILTER (l_linenumber = 1) AS main, string_agg(desk, ',' ORDER BY l_linenumber) FILTER (l_linenumber > 1) AS others FROM claims_ GROUP BY 1) SELECT event_id, main, coalesce(others, '') AS collaborators FROM events_ LEFT JOIN p USING (event_id)"


def cited_claims(s, d):
    cited = t(s, d, "lineitem").where("l_quantity >= 45").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("article_id"))
    claims, _ = _detailed(s, d)
    return claims.select("claim_id", F.explode("evidence.article_id").alias("article_id")).join(cited, "article_id", "left_semi").select("claim_id").distinct()


CITED = f"WITH {_NESTED} SELECT DISTINCT claim_id FROM ev WHERE article_id IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_quantity >= 45)"


def party_coverage(s, d):
    c = _claims(s, d).join(t(s, d, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_nationkey"), "source_id")
    got = c.groupBy("s_nationkey").agg(F.count("*").alias("articles"), F.count_if(F.col("l_linenumber") % 5 == 0).alias("statements"), F.countDistinct(F.when(F.col("l_linenumber") % 5 == 0, F.col("source_id"))).alias("families"))
    wanted = t(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return wanted.join(got, "s_nationkey", "left").select("n_name", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("articles", "statements", "families")))


PARTY = f"WITH {_CLAIMS}, g AS (SELECT s_nationkey, count(*) AS articles, count(*) FILTER (l_linenumber % 5 = 0) AS statements, count(DISTINCT source_id) FILTER (l_linenumber % 5 = 0) AS families FROM claims_ JOIN supplier ON s_suppkey = source_id GROUP BY 1) SELECT n_name, coalesce(articles, 0) AS articles, coalesce(statements, 0) AS statements, coalesce(families, 0) AS families FROM nation LEFT JOIN g ON s_nationkey = n_nationkey"


def entity_merge(s, d):
    hits = _claims(s, d).select((F.col("source_id") % 40).alias("event_id"), F.concat_ws("-", "desk", "status", (F.col("claim_id") % 3).cast("string")).alias("slug"), (F.col("score").cast("long") - 3).alias("n"), "l_linenumber")
    return desk.merge_counts(hits.where("l_linenumber < 4").drop("l_linenumber"), hits.where("l_linenumber >= 4 AND n > 37").drop("l_linenumber"))


ENTITY = f"WITH {_CLAIMS}, h AS (SELECT source_id % 40 AS event_id, desk || '-' || status || '-' || (claim_id % 3) AS slug, least(sum(greatest(score - 3, 1)), 999)::BIGINT AS n FROM claims_ WHERE l_linenumber < 4 OR score > 40 GROUP BY ALL) SELECT event_id, slug, n, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, slug) AS pos FROM h QUALIFY pos <= 16"


def topic_merge(s, d):
    e = spread(_events(s, d)).withColumn("other", F.get(F.array(*map(F.lit, TOPICS)), (F.col("heat") % 5).cast("int")))
    merged = desk.merge_topics(TOPICS, F.array("topic"), F.array("other", F.lit("health"), F.lit("unknown")))
    e = e.select("event_id", "country", merged.alias("topics"))  # merged once, not for each rule
    return e.select("event_id", F.array_join("topics", ",").alias("topics"), F.array_join(desk.needed_categories(F.col("topics"), F.array("country")), ",").alias("needed"))


def _needed_sql() -> str:
    fits = []
    for names, country, gives in desk.NEEDED:
        test = f"list_has_any(t, {list(names)!r})" + (f" AND country = '{country}'" if country else "")
        fits += [(g, test) for g in gives]
    parts = [f"CASE WHEN {' OR '.join(f'({x})' for g, x in fits if g == c)} THEN '{c}' END" for c in desk.CATEGORIES if any(g == c for g, _ in fits)]
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


TOPIC = f"""WITH {_EVENTS}, m AS (SELECT event_id, country, topic AS a, ['conflict', 'diplomacy', 'economy', 'health', 'investigation'][heat % 5 + 1] AS b FROM events_),
u AS (SELECT event_id, country, list_filter(['conflict', 'diplomacy', 'economy', 'health', 'investigation'], lambda x: x IN (a, b, 'health')) AS t FROM m) SELECT event_id, array_to_string(t, ',') AS topics, {_needed_sql()} AS needed FROM u"""


def event_updates(s, d):
    e = _events(s, d).select("event_id", F.col("updated").alias("first_at"), F.col("updated").alias("last_at"), "version")
    out = desk.merged_events(e, _claims(s, d).where("source_id % 2 = 0"))
    return out.select("event_id", F.date_format("first_at", "yyyy-MM-dd").alias("first_at"), F.date_format("last_at", "yyyy-MM-dd").alias("last_at"), "version", "dirty", "added")


UPDATES = f"WITH {_EVENTS}, {_CLAIMS}, n AS (SELECT event_id, min(moment) AS a, max(moment) AS b, count(*) AS added FROM claims_ WHERE source_id % 2 = 0 GROUP BY 1) SELECT event_id, strftime(least(updated, coalesce(a, updated)), '%Y-%m-%d') AS first_at, strftime(greatest(updated, coalesce(b, updated)), '%Y-%m-%d') AS last_at, version + (added IS NOT NULL)::INT AS version, added IS NOT NULL AS dirty, coalesce(added, 0) AS added FROM events_ LEFT JOIN n USING (event_id)"


def desk_digest(s, d):
    notes = _claims(s, d).withColumn("event_id", F.col("event_id") % 500)
    return notes.groupBy("event_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("desk")), 1, 12), ",").alias("findings"), F.least(F.countDistinct("claim_id"), F.lit(100)).alias("citations"))


DIGEST = f"WITH {_CLAIMS} SELECT event_id % 500 AS event_id, array_to_string(list_sort(list(DISTINCT desk))[1:12], ',') AS findings, least(count(DISTINCT claim_id), 100) AS citations FROM claims_ GROUP BY 1"


def tick_rollup(s, d):
    e = t(s, d, "events")
    return e.groupBy(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("tick")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.countDistinct("user_id").alias("sources"))


TICKS = "SELECT strftime(ts::TIMESTAMP, '%Y-%m-%d') AS tick, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT user_id) AS sources FROM events GROUP BY 1"


def category_top8(s, d):
    n = t(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "p_brand").limit(8)


TOP8 = "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8"


def next_sequence(s, d):
    add = t(s, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("run"), "l_linenumber")
    last = t(s, d, "lineitem").where("l_quantity <= 40").groupBy(F.col("l_orderkey").alias("run")).agg(F.max("l_linenumber").alias("last"))
    return add.join(last, "run", "left").select("run", "l_linenumber", (F.coalesce("last", F.lit(0)) + F.row_number().over(W.partitionBy("run").orderBy("l_linenumber"))).alias("sequence"))


SEQUENCE = "SELECT a.l_orderkey AS run, a.l_linenumber, coalesce(last, 0) + row_number() OVER (PARTITION BY a.l_orderkey ORDER BY a.l_linenumber) AS sequence FROM lineitem a LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem WHERE l_quantity <= 40 GROUP BY 1) b ON a.l_orderkey = b.l_orderkey WHERE l_quantity > 40"


def latest_per_type(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


LATEST = "SELECT o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1"


def breaking_ids(s, d):
    return _events(s, d).where("updated >= '1998-01-01' AND (breaking OR importance >= 70)").orderBy(F.desc("importance"), F.desc("heat"), F.desc("updated"), "event_id").limit(20).select("event_id")


BREAKING = f"WITH {_EVENTS} SELECT event_id FROM events_ WHERE updated >= TIMESTAMP '1998-01-01' AND (breaking OR importance >= 70) ORDER BY importance DESC, heat DESC, updated DESC, event_id LIMIT 20"


def featured_reports(s, d):
    c, id_ = _claims(s, d), F.col("claim_id")
    flags = {"weight": (F.col("source_id") % 27 + 2), "corroborated": F.col("status") == "corroborated", "verified": F.col("source_id") % 2 == 0, "healthy": F.col("source_id") % 3 > 0, "party": F.col("source_id") % 6 == 0, "primary": F.col("l_linenumber") == 1, "reprint": id_ % 4 == 0, "paywalled": id_ % 7 == 0}
    return desk.featured(c.withColumns(flags).select("event_id", id_.alias("article_id"), F.col("at").alias("published"), *flags))


FEATURED = f"""WITH {_CLAIMS}, s AS (SELECT event_id, claim_id AS article_id, moment, source_id % 27 + 2 + 50 * (status = 'corroborated')::INT + 24 * (source_id % 2 = 0)::INT + 16 * (source_id % 3 > 0)::INT + 12 * (source_id % 6 > 0)::INT + 12 * (l_linenumber = 1)::INT + 8 * (claim_id % 4 > 0)::INT - 4 * (claim_id % 7 = 0)::INT AS score FROM claims_)
SELECT event_id, article_id, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'limited' END AS level FROM s QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, moment DESC, article_id) = 1"""


def live_timeline(s, d):
    c = _claims(s, d)
    said = F.concat(F.lit("said by "), F.col("source_id").cast("string")).alias("said")
    both = c.select("event_id", "at", F.lit("claim").alias("kind"), said).unionByName(c.where("score > 30").select("event_id", "at", F.lit("report").alias("kind"), said))
    once = both.groupBy("event_id", "at", "said").agg(F.min("kind").alias("kind"))
    return once.select("event_id", "kind", "said", F.row_number().over(W.partitionBy("event_id").orderBy("at", "kind", "said")).alias("place"))


LIVE = f"WITH {_CLAIMS}, o AS (SELECT event_id, moment, 'said by ' || source_id AS said, 'claim' AS kind FROM claims_ GROUP BY ALL) SELECT event_id, kind, said, row_number() OVER (PARTITION BY event_id ORDER BY moment, kind, said) AS place FROM o"


def search_or_recent(s, d):
    docs = t(s, d, "documents")
    hits = docs.where(F.lower("text").contains("pathetic")).select("doc_id").orderBy(F.desc("doc_id")).limit(5)
    recent = docs.orderBy(F.desc("doc_id")).limit(20).select("doc_id")
    return desk.with_fallback(hits, recent)


RECENT = "WITH h AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'pathetic') ORDER BY doc_id DESC LIMIT 5), r AS (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 20) SELECT doc_id, doc_id IN (SELECT doc_id FROM h) AS from_search FROM (SELECT doc_id FROM h UNION SELECT doc_id FROM r WHERE (SELECT count(*) FROM h) < 8)"


def work_ids(s, d):
    e = _events(s, d)
    dirty = e.where("heat = 5").select("event_id", F.lit(0).alias("rank"))
    stale = e.where("updated < '1992-03-01'").select("event_id", F.lit(1).alias("rank"))
    return dirty.unionByName(stale).groupBy("event_id").agg(F.min("rank").alias("rank")).orderBy("rank", "event_id").limit(300)


WORK = f"WITH {_EVENTS} SELECT event_id, min(rank) AS rank FROM (SELECT event_id, 0 AS rank FROM events_ WHERE heat = 5 UNION ALL SELECT event_id, 1 FROM events_ WHERE updated < TIMESTAMP '1992-03-01') GROUP BY 1 ORDER BY rank, event_id LIMIT 300"


def unique_rows(s, d):
    rows = t(s, d, "events").select("user_id", "event_type", "event_id")
    last = desk.unique_by_id(rows, "user_id", "event_type", "event_id")
    cited = rows.groupBy("user_id", "event_type").agg(F.min("event_id").alias("at")).groupBy("user_id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), 1, 3), ",").alias("first_three"))
    return last.join(cited, "user_id")


UNIQUE = "WITH f AS (SELECT user_id, event_type, min(event_id) AS born FROM events GROUP BY ALL) SELECT e.user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS event_id, any_value(first_three) AS first_three FROM events e JOIN (SELECT user_id, array_to_string(list(event_type ORDER BY born)[1:3], ',') AS first_three FROM f GROUP BY 1) USING (user_id) GROUP BY e.user_id"


def turn_search(s, d):
    turns = t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat_ws(" ", "role", "text").alias("text"))
    return search.bm25(turns, "the user", 50)


def _bm25(table: str, terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(terms)))
    words = f"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '{text.PUNCT}', ' ', 'g')), ' '), lambda x: length(x) > 1 OR regexp_matches(x, '[0-9]'))"
    return f"""WITH d AS ({table}), w AS (SELECT doc_id, {words} AS w FROM d), f AS (SELECT doc_id, len(w) AS dl, {tf} FROM w), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM f)
SELECT doc_id, round({score}, 6) AS score FROM f, s WHERE {" + ".join(f"tf{i}" for i in range(len(terms)))} > 0 ORDER BY score DESC, doc_id LIMIT 50"""


TURNS = _bm25("SELECT conv_id * 1000 + turn AS doc_id, concat_ws(' ', role, text) AS text FROM conversations", ["the", "user"])


def combined_search(s, d):
    """The best ten of three searches for the same words: documents, turns and addresses of pages."""
    turns = t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat_ws(" ", "role", "text").alias("text"))
    pages = t(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))
    out = None
    for kind, docs in {"articles": t(s, d, "documents"), "claims": turns, "events": pages}.items():
        hits = search.bm25(docs.select("doc_id", "text"), SOUGHT[kind], 10)
        hits = hits.select(F.lit(kind).alias("kind"), F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("place"), "doc_id", "score")  # ten rows
        out = hits if out is None else out.unionByName(hits)
    return out


SOUGHT = {"articles": "pathetic loser the", "claims": "the user", "events": "com html en"}
_FOUND = {"articles": "SELECT doc_id, text FROM documents", "claims": "SELECT conv_id * 1000 + turn AS doc_id, concat_ws(' ', role, text) AS text FROM conversations", "events": "SELECT page_id AS doc_id, url AS text FROM pages"}
COMBINED = " UNION ALL ".join(f"SELECT '{k}' AS kind, row_number() OVER (ORDER BY score DESC, doc_id) AS place, doc_id, score FROM ({_bm25(v, SOUGHT[k].split())}) QUALIFY place <= 10" for k, v in _FOUND.items())


QUESTION = "Who is the pathetic loser that asked about software?"


def extractive_answer(s, d):
    """A question answered from the best fifty documents that a search for its words finds."""
    docs = t(s, d, "documents")
    hits = search.bm25(docs, QUESTION.rstrip("?"), 50).select("doc_id")
    id_ = F.col("doc_id")
    a = docs.join(hits, "doc_id").select(id_.alias("article_id"), F.concat(F.lit("Document "), id_).alias("title"), F.when(id_ % 5 == 0, "A pathetic excerpt").alias("excerpt"), F.col("text").alias("body"), F.timestamp_seconds(id_ * 60).alias("at"), "source", (id_ % 11).alias("event_id"), (id_ % 9 == 0).alias("cross_verified"), (id_ % 3).alias("families"), (id_ % 4 == 0).alias("reprint"))
    out = answers.answer(a, QUESTION, "2026-01-01", ("no reprints",))
    return out.select("answer", *(F.array_join(F.col(c).cast("array<string>"), "|").alias(c) for c in ("citations", "caveats", "related")))


_TERMS = list(dict.fromkeys(w for w in QUESTION.rstrip("?").lower().split() if len(w) > 1))


def _relevant(x: str) -> str:
    return f"len(list_intersect({_TERMS!r}, list_filter(string_split(trim(regexp_replace(lower({x}), '{text.PUNCT}', ' ', 'g')), ' '), lambda w: length(w) > 1 OR regexp_matches(w, '[0-9]')))) / {len(_TERMS)}::DOUBLE"


ANSWER = rf"""WITH h AS ({_bm25("SELECT doc_id, text FROM documents", _TERMS)}), a AS (SELECT doc_id, source, 'Document ' || doc_id AS title, CASE WHEN doc_id % 5 = 0 THEN 'A pathetic excerpt' ELSE '' END AS excerpt, trim(coalesce(text, '')) AS body FROM documents WHERE doc_id IN (SELECT doc_id FROM h)),
b AS (SELECT *, list_concat([CASE WHEN excerpt <> '' THEN excerpt ELSE title END], list_transform(list_filter(list_transform(regexp_extract_all(body, '[^。！？!?
.]+(?:[。！？!?.]+|$)'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 12)[1:60], lambda x: CASE WHEN length(x) > 500 THEN left(x, 499) || '…' ELSE x END)) AS offers FROM a),
o AS (SELECT doc_id, unnest(offers) AS s, generate_subscripts(offers, 1) AS i FROM b), q AS (SELECT doc_id, s, i, {_relevant("s")} AS r FROM o), m AS (SELECT doc_id, s, r FROM q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r DESC, i) = 1),
k AS (SELECT doc_id, source, title, s, round(5 * {_relevant("title")} + 2 * {_relevant("excerpt")} + 3 * r + CASE WHEN doc_id % 9 = 0 OR doc_id % 3 >= 2 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 0.05::DOUBLE END, 6) AS score FROM b JOIN m USING (doc_id)),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id DESC) AS place, max(score) OVER () AS best FROM k QUALIFY place <= 6), c AS (SELECT *, row_number() OVER (ORDER BY place) AS number, 'According to ' || coalesce(source, '') || ', ' || trim(regexp_replace(regexp_replace(s, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS said FROM t WHERE score > 0 OR best <= 0 AND place <= 3),
u AS (SELECT place, said || ' [' || number || ']' AS x FROM c QUALIFY row_number() OVER (PARTITION BY lower(said) ORDER BY place) = 1)
SELECT (SELECT CASE WHEN count(*) = 0 THEN 'As of 2026-01-01, the selected sources do not contain enough information to answer this question.' ELSE 'As of 2026-01-01, the available reporting indicates: ' || array_to_string(list(x ORDER BY place)[1:5], ' ') END FROM u) AS answer,
 (SELECT coalesce(string_agg('[' || number || '] ' || title || ' — ' || coalesce(source, ''), '|' ORDER BY number), '') FROM c) AS citations, (SELECT 'Material up to 2026-01-01.|Filter: no reprints.|' || CASE WHEN count(*) = 0 THEN 'Nothing in the selection supports a clear answer.|' ELSE '' END || 'Quoted from reports; what a source states is not thereby confirmed.' FROM u) AS caveats,
 (SELECT coalesce(array_to_string(list_sort(list(DISTINCT doc_id % 11)), '|'), '') FROM c) AS related"""


def asked_articles(s, d):
    c, id_, src = _claims(s, d), F.col("claim_id"), F.col("source_id")
    flags = [F.when(src % 4 == 0, "gov_intl").when(src % 4 == 1, "party_media").otherwise("wire").alias("category"), (src % 6 == 0).alias("party"), F.when(src % 5 > 0, src % 5 < 4).alias("civilian"), (id_ % 4 == 0).alias("reprint"), (id_ % 9 == 0).alias("cross_verified"), (src % 3).alias("families")]
    a = c.select(id_.alias("article_id"), F.lit(1).alias("pos"), F.when(id_ % 8 > 0, F.col("at")).alias("at"), *flags)
    later = a.withColumns({"pos": F.lit(2), "reprint": F.lit(False), "party": F.lit(False)})  # a second row of an id never stands
    official = desk.ask_filters(a.unionByName(later), "1996-01-01", official=("gov_intl", "wire"), no_reprints=True, cross_verified=True).select("article_id", F.lit("official").alias("asked"))
    return official.unionByName(desk.ask_filters(a.unionByName(later), "1996-01-01", civilian=True).select("article_id", F.lit("civilian").alias("asked")))


ASKED = f"""WITH {_CLAIMS}, u AS (SELECT claim_id AS article_id, source_id, claim_id FROM claims_ WHERE claim_id % 8 = 0 OR moment <= TIMESTAMP '1996-01-01')
SELECT article_id, 'official' AS asked FROM u WHERE source_id % 4 <> 1 AND claim_id % 4 > 0 AND (claim_id % 9 = 0 OR source_id % 3 >= 2)
UNION ALL SELECT article_id, 'civilian' FROM u WHERE source_id % 6 > 0 AND source_id % 4 <> 1 AND source_id % 5 <> 4"""


def pages_allowed(s, d):
    rest = F.expr("substr(url, instr(url, '://') + 3)")
    p = t(s, d, "pages").where("instr(url, '://') > 0").select(F.col("page_id").alias("id"), F.lower(F.regexp_extract(rest, "^([^/?#]*)", 1)).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))
    body = "User-agent: *\nDisallow: /en/ # all\nAllow: /en/1\n\nUser-agent: OtherBot\nDisallow: /\nDisallow:"
    files = p.select("host").distinct().withColumn("body", F.lit(body))
    return desk.robots_allowed(p, desk.robots_rules(files, "readerbot"))


ALLOWED = "SELECT page_id AS id, CASE WHEN starts_with(path, '/en/1') THEN true ELSE NOT starts_with(path, '/en/') END AS allowed FROM (SELECT page_id, regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE contains(url, '://'))"


def local_clock(s, d):
    o = t(s, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, CAST(o_orderkey % 1440 AS INT))"))
    local = F.from_utc_timestamp("at", "Asia/Shanghai")
    return o.select("o_orderkey", F.date_format(local, "HH:mm").alias("hm"), F.date_format(local, "yyyy-MM-dd").alias("day"), desk.age_text(F.col("at"), F.lit("1998-08-01 12:00:00").cast("timestamp")).alias("age"))


CLOCK = """WITH o AS (SELECT o_orderkey, o_orderdate::TIMESTAMP + to_minutes(o_orderkey % 1440) AS moment FROM orders), m AS (SELECT *, floor((epoch(TIMESTAMP '1998-08-01 12:00:00') - epoch(moment)) / 60)::BIGINT AS m FROM o)
SELECT o_orderkey, strftime(moment + INTERVAL 8 HOUR, '%H:%M') AS hm, strftime(moment + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN floor(m / 60)::INT || 'h' WHEN m < 43200 THEN floor(m / 1440)::INT || 'd' ELSE strftime(moment, '%Y-%m-%d') END AS age FROM m"""


def like_patterns(s, d):
    return t(s, d, "part").select("p_partkey", F.concat(F.lit("%"), desk.escape_like(F.concat_ws("_", "p_brand", F.lit("5%"), "p_type")), F.lit("%")).alias("pattern"))


LIKE = r"SELECT p_partkey, '%' || replace(replace(p_brand || '_5%_' || p_type, '%', ''), '_', '') || '%' AS pattern FROM part"


SLOTS_AT = {"morning": "07:00", "noon": "12:30", "evening": "19:00"}


def slots_due(s, d):
    """Briefings that the ticks of three desks started, in weeks in which clocks are changed."""
    e = t(s, d, "events")
    ticks = e.select((F.col("user_id") % 3).alias("desk"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 75 DAYS")).alias("at"))
    out = desk.fired_slots(ticks, SLOTS_AT, "Europe/Berlin")
    return out.select("desk", "day", "slot", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss").alias("fired_at"))


_TICKS = """k AS (SELECT user_id % 3 AS desk, ts::TIMESTAMP + INTERVAL 75 DAYS AS moment FROM events),
l AS (SELECT *, moment + CASE WHEN moment >= TIMESTAMP '2024-03-31 01:00:00' AND moment < TIMESTAMP '2024-10-27 01:00:00' THEN INTERVAL 2 HOURS ELSE INTERVAL 1 HOUR END AS here FROM k)"""
SLOTS = f"WITH {_TICKS} " + " UNION ALL ".join(f"SELECT desk, strftime(here, '%Y-%m-%d') AS day, '{k}' AS slot, strftime(min(moment), '%Y-%m-%d %H:%M:%S') AS fired_at FROM l WHERE strftime(here, '%H:%M') >= '{v}' GROUP BY ALL" for k, v in SLOTS_AT.items()) + " UNION ALL SELECT desk, strftime(here, '%Y-%m-%d') AS day, 'hourly:' || strftime(here, '%H') AS slot, strftime(min(moment), '%Y-%m-%d %H:%M:%S') AS fired_at FROM l WHERE minute(here) >= 5 GROUP BY ALL"


def article_roles(s, d):
    c = _claims(s, d)
    return c.groupBy(desk.article_role(F.col("source_id") % 6 == 0, F.when(F.col("source_id") % 5 == 0, "data").otherwise("wire")).alias("role")).agg(F.count("*").alias("n"))


ROLES = f"WITH {_CLAIMS} SELECT CASE WHEN source_id % 6 = 0 THEN 'statement' WHEN source_id % 5 = 0 THEN 'data' ELSE 'report' END AS role, count(*) AS n FROM claims_ GROUP BY 1"


def all_review_gaps(s, d):
    c, src = _claims(s, d).join(t(s, d, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_nationkey"), "source_id"), F.col("source_id")
    has = {"data": F.bool_or(src % 5 == 0), "wire": F.bool_or(src % 3 == 0), "gov_cn": F.bool_or(src % 7 == 0)}
    per = c.groupBy("event_id").agg(F.count("*").alias("articles"), F.count_if(F.col("claim_id") % 4 > 0).alias("originals"), F.countDistinct("s_nationkey").alias("families"), F.count_if(src % 2 == 0).alias("verified"), F.count_if(src % 13 > 0).alias("claims"), F.count_if(src % 11 == 0).alias("refuted"), F.count_if(F.col("status") == "disputed").alias("disputed"), *(x.alias(k) for k, x in has.items()))
    missing = F.filter(F.array(*(F.when(~F.coalesce(k, F.lit(False)), k) for k in has)), lambda k: k.isNotNull()).alias("missing")
    e = _events(s, d).select("event_id", "importance", "breaking").join(per, "event_id", "left").na.fill(0).select("*", missing)
    return desk.review_gaps(e)


GAPS = f"""WITH {_EVENTS}, {_CLAIMS}, p AS (SELECT e.event_id, importance >= 70 OR breaking AS high, count(claim_id) AS articles, count(*) FILTER (claim_id % 4 > 0) AS originals, count(DISTINCT s_nationkey) AS families, count(*) FILTER (source_id % 2 = 0) AS verified, count(*) FILTER (source_id % 13 > 0) AS claims, count(*) FILTER (source_id % 11 = 0) AS refuted, count(*) FILTER (c.status = 'disputed') AS disputed,
 coalesce(bool_or(source_id % 5 = 0), false) AS data, coalesce(bool_or(source_id % 3 = 0), false) AS wire, coalesce(bool_or(source_id % 7 = 0), false) AS gov FROM events_ e LEFT JOIN claims_ c ON c.event_id = e.event_id LEFT JOIN supplier ON s_suppkey = source_id GROUP BY ALL),
g AS (SELECT event_id, unnest([CASE WHEN articles = 0 THEN {{'code': 'NO_ORIGINAL_ARTICLE', 'level': 'blocker', 'category': NULL::VARCHAR}} END, CASE WHEN articles > 0 AND originals = 0 THEN {{'code': 'ALL_ARTICLES_REPRINTS', 'level': 'blocker', 'category': NULL::VARCHAR}} END,
 CASE WHEN families < 2 THEN {{'code': 'LOW_SOURCE_INDEPENDENCE', 'level': CASE WHEN high THEN 'blocker' ELSE 'warning' END, 'category': NULL::VARCHAR}} END, CASE WHEN articles > 0 AND verified = 0 THEN {{'code': 'SOURCE_IDENTITY_UNVERIFIED', 'level': CASE WHEN high THEN 'blocker' ELSE 'warning' END, 'category': NULL::VARCHAR}} END,
 CASE WHEN verified > 0 AND verified < articles THEN {{'code': 'SOURCE_IDENTITY_PARTIAL', 'level': 'warning', 'category': NULL::VARCHAR}} END, CASE WHEN claims = 0 THEN {{'code': 'NO_ACTIONABLE_CLAIMS', 'level': CASE WHEN high THEN 'blocker' ELSE 'warning' END, 'category': NULL::VARCHAR}} END,
 CASE WHEN refuted > 0 THEN {{'code': 'REFUTED_CLAIM_REQUIRES_REDRAFT', 'level': 'blocker', 'category': NULL::VARCHAR}} END, CASE WHEN disputed > 0 THEN {{'code': 'DISPUTED_CLAIM_REQUIRES_BALANCE', 'level': CASE WHEN high THEN 'blocker' ELSE 'warning' END, 'category': NULL::VARCHAR}} END,
 CASE WHEN NOT data THEN {{'code': 'REQUIRED_SOURCE_CATEGORY_MISSING', 'level': 'warning', 'category': 'data'}} END, CASE WHEN NOT wire THEN {{'code': 'REQUIRED_SOURCE_CATEGORY_MISSING', 'level': 'warning', 'category': 'wire'}} END, CASE WHEN NOT gov THEN {{'code': 'REQUIRED_SOURCE_CATEGORY_MISSING', 'level': 'warning', 'category': 'gov_cn'}} END]) AS x FROM p)
SELECT event_id, x.code, x.level, x.category FROM g WHERE x IS NOT NULL"""


def desk_findings(s, d):
    c = _claims(s, d).withColumn("citations", F.col("source_id") % 3)
    return desk.desk_reports(_events(s, d), c.where("score > 20").select("event_id", "desk").distinct(), c, DESKS)


FINDINGS = f"""WITH {_EVENTS}, {_CLAIMS}, v AS (SELECT event_id, unnest({list(DESKS)!r}) AS desk FROM events_), a AS (SELECT DISTINCT event_id, desk FROM claims_ WHERE score > 20),
f AS (SELECT event_id, desk, array_to_string(list_sort(list(DISTINCT claim_id))[1:12], ',') AS findings FROM claims_ WHERE source_id % 3 > 0 GROUP BY ALL)
SELECT v.event_id, v.desk, CASE WHEN a.desk IS NULL THEN 'blocked' ELSE 'completed' END AS status, CASE WHEN a.desk IS NULL THEN '' ELSE coalesce(findings, '') END AS findings FROM v LEFT JOIN a ON a.event_id = v.event_id AND a.desk = v.desk LEFT JOIN f ON f.event_id = v.event_id AND f.desk = v.desk"""


def search_turns(s, d):
    locks = t(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_id"), (F.lit(1_000_000) - F.col("o_custkey") * 10).alias("at"))
    return desk.throttled(_events(s, d), locks, 1_000_000).select("event_id")


THROTTLE = f"WITH {_EVENTS} SELECT event_id FROM (SELECT * FROM events_ ORDER BY importance DESC, heat DESC, updated DESC, event_id LIMIT 2) WHERE NOT (event_id % 2 = 0 AND o_custkey * 10 < 1800)"


def live_keys(s, d):
    e = t(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 1000).alias("expires"))
    return desk.live_values(e, 500)


LIVE_KEYS = "SELECT key, value FROM (SELECT user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS m FROM events GROUP BY 1) WHERE m % 4 = 0 OR m % 1000 > 500"

PAIRS = {
    "client_tabs": (client_tabs, CLIENT),
    "event_tabs": (event_tabs, TABS), "claims_nested": (claims_nested, NESTED), "event_detail": (event_detail, DETAIL),  "status_histogram": (status_histogram, HISTOGRAM), "source_list": (source_list, SOURCES), "queue_counts": (queue_counts, QUEUE),
    "alert_inbox": (alert_inbox, INBOX), "active_of_top": (active_of_top, ACTIVE), "fetch_log_named": (fetch_log_named, LOG), "current_reports": (current_reports, REPORTS), "briefing_changes": (briefing_changes, DELTA), "routed_events": (routed_events, ROUTED), "cited_claims": (cited_claims, CITED),
    "party_coverage": (party_coverage, PARTY), "entity_merge": (entity_merge, ENTITY), "topic_merge": (topic_merge, TOPIC), "event_updates": (event_updates, UPDATES), "desk_digest": (desk_digest, DIGEST), "tick_rollup": (tick_rollup, TICKS), "category_top8": (category_top8, TOP8), "next_sequence": (next_sequence, SEQUENCE),
    "latest_per_type": (latest_per_type, LATEST), "breaking_ids": (breaking_ids, BREAKING), "featured_reports": (featured_reports, FEATURED), "live_timeline": (live_timeline, LIVE), "search_or_recent": (search_or_recent, RECENT), "work_ids": (work_ids, WORK), "unique_rows": (unique_rows, UNIQUE),
    "turn_search": (turn_search, TURNS), "combined_search": (combined_search, COMBINED), "extractive_answer": (extractive_answer, ANSWER), "asked_articles": (asked_articles, ASKED), "pages_allowed": (pages_allowed, ALLOWED), "local_clock": (local_clock, CLOCK), "like_patterns": (like_patterns, LIKE),
    "slots_due": (slots_due, SLOTS), "article_roles": (article_roles, ROLES), "all_review_gaps": (all_review_gaps, GAPS), "desk_findings": (desk_findings, FINDINGS), "search_turns": (search_turns, THROTTLE), "live_keys": (live_keys, LIVE_KEYS),
}
