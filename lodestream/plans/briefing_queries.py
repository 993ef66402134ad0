"""Queries of briefings and of numbering, and their SQL. Orders stand for events, line items for what they cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import briefing
from .text_queries import t

CUTOFF = "1998-01-01 00:00:00"


def _events(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    topic = F.get(F.array(*map(F.lit, ("conflict", "policy", "health", "energy"))), (k % 4).cast("int"))
    return t(s, d, "orders").select(
        (c % 7).alias("briefing"), k.alias("event_id"), F.concat(F.lit("Event <b>"), k, F.lit("</b>  of "), c).alias("title"), F.when(k % 3 == 0, F.concat(F.lit("What "), k, F.lit(" is about"))).when(k % 3 == 1, "").alias("one_liner"), F.when(k % 10 == 0, "developing").otherwise("stable").alias("status"),
        F.when(k % 50 == 7, "Own").alias("section"), F.floor(F.col("o_totalprice") / 6000).cast("int").alias("importance"), (k % 97).alias("heat"), F.when(k % 23 > 0, F.col("o_orderdate").cast("timestamp")).alias("updated"), F.when(c % 3 == 0, F.array(F.lit("cn"))).when(c % 3 == 1, F.array(F.lit("cn"), F.lit("us"))).alias("countries"), F.array(topic).alias("topics"),
        (k % 3).alias("confirmed"), (k % 2).alias("unverified"), F.lit(0).alias("disputed"), (k % 9).alias("article_count"), F.when(k % 6 == 0, "more <i>known</i>").alias("change_note"),
    )


def _citations(s, d):
    li, src = t(s, d, "lineitem"), F.col("l_suppkey")
    return li.where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("event_id"), src.alias("article_id")).agg(F.min("l_linenumber").alias("pos")).select("event_id", "pos", "article_id", F.concat(F.lit("Report "), "article_id").alias("title"), F.concat(F.lit("Source "), F.col("article_id") % 10).alias("source"), F.concat(F.lit("https://a.org/"), "article_id").alias("url"), F.when(F.col("article_id") % 4 > 0, F.lit("1997-05-05")).alias("published"))


def full_briefings(s, d):
    e = _events(s, d)
    before = briefing.items(e.where("event_id % 5 > 0"), CUTOFF, "cn").select("briefing", "event_id", "line", F.when(F.col("event_id") % 2 == 0, "other").otherwise(F.col("status_line")).alias("status_line"))
    return briefing.briefings(e, _citations(s, d), before, CUTOFF)


def numbered_lines(s, d):
    """All line items numbered by date, order and line, by ranges."""
    li = t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("at"))
    return briefing.numbered(li, ["at", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "number")


NUMBERED = "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY moment, l_orderkey, l_linenumber) AS number FROM (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS moment FROM lineitem GROUP BY ALL)"
_ITEMS = f"""e AS (SELECT o_custkey % 7 AS briefing, o_orderkey AS k, o_custkey AS c, floor(o_totalprice / 6000)::INT AS importance, o_orderkey % 97 AS heat, CASE WHEN o_orderkey % 23 > 0 THEN o_orderdate::TIMESTAMP END AS updated FROM orders),
f AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'What ' || k || ' is about' ELSE 'Event ' || k || ' of ' || c END AS line, 'Event ' || k || ' of ' || c AS title, CASE WHEN k % 50 = 7 THEN 'Own' WHEN k % 10 = 0 OR importance >= 80 THEN 'Under way' WHEN c % 3 = 0 THEN 'At home' WHEN k % 4 = 0 THEN 'Diplomacy and security' WHEN k % 4 IN (1, 3) THEN 'Policy and economy' ELSE 'World' END AS section,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN (k % 9) || ' reports' ELSE array_to_string(list_filter([CASE WHEN k % 3 > 0 THEN (k % 3) || ' confirmed' END, CASE WHEN k % 2 > 0 THEN (k % 2) || ' to verify' END], lambda x: x IS NOT NULL), ' · ') END AS status_line FROM e WHERE updated IS NULL OR updated <= TIMESTAMP '{CUTOFF}'),"""
_TOP = "(SELECT *, row_number() OVER (PARTITION BY briefing ORDER BY importance DESC, heat DESC, updated DESC NULLS LAST, k) AS place FROM f {} QUALIFY place <= 30)"
FULL = f"""WITH {_ITEMS} i AS (SELECT *, min(place) OVER (PARTITION BY briefing, section) AS sp FROM {_TOP.format("")}), b AS {_TOP.format("WHERE k % 5 > 0")},
c AS (SELECT i.briefing, k, sp, place, l_suppkey AS a, min(l_linenumber) AS pos FROM i JOIN lineitem ON l_orderkey = k AND l_quantity > 20 GROUP BY ALL),
n AS (SELECT briefing, a, row_number() OVER (PARTITION BY briefing ORDER BY min((sp, place, pos, a))) AS number FROM c GROUP BY briefing, a),
m AS (SELECT c.briefing, k, string_agg('[' || number || ']', '' ORDER BY pos, a) AS marks FROM c JOIN n USING (briefing, a) GROUP BY ALL),
s AS (SELECT i.*, line || coalesce(' ' || marks, '') AS said FROM i LEFT JOIN m USING (briefing, k)),
p AS (SELECT briefing, string_agg(CASE WHEN place = sp THEN '## ' || section || chr(10) || chr(10) ELSE '' END || '### ' || title || chr(10) || said || chr(10) || '- ' || status_line || CASE WHEN k % 6 = 0 THEN chr(10) || '- Changed: more known' ELSE '' END || chr(10), chr(10) ORDER BY sp, place) AS body,
  string_agg(said, '|' ORDER BY place) FILTER (place <= 5) AS one_minute, string_agg('- ' || said, chr(10) ORDER BY place) FILTER (place <= 5) AS minute FROM s GROUP BY 1),
z AS (SELECT briefing, string_agg('[' || number || '] Report ' || a || ' — Source ' || (a % 10) || CASE WHEN a % 4 > 0 THEN ', 1997-05-05' ELSE '' END || '  ' || chr(10) || 'https://a.org/' || a, chr(10) ORDER BY number) AS sources FROM n GROUP BY 1),
d AS (SELECT i.briefing, count(*) FILTER (b.k IS NULL) AS added, count(*) FILTER (b.k IS NOT NULL AND (i.k % 6 = 0 OR i.k % 2 = 0)) AS updated FROM i LEFT JOIN b ON b.briefing = i.briefing AND b.k = i.k GROUP BY 1)
SELECT briefing, '# Briefing ' || briefing || chr(10) || chr(10) || '> Up to {CUTOFF}' || chr(10) || chr(10) || '## In one minute' || chr(10) || chr(10) || minute || chr(10) || chr(10) || body || coalesce(chr(10) || '## Sources' || chr(10) || chr(10) || sources, '') || chr(10) AS markdown, one_minute, added, updated
FROM p LEFT JOIN z USING (briefing) JOIN d USING (briefing)"""

PAIRS = {"full_briefings": (full_briefings, FULL), "numbered_lines": (numbered_lines, NUMBERED)}
