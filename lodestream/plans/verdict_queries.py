"""Queries of verdicts on claims and their SQL, which compares every pair of figures. Orders stand for claims, line items for their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import desk, verdicts
from .text_queries import t

QUALIFIERS = ("exact", "at_least", "more_than", "about", "up_to")


def claims_of(s, d):
    o, k, c = t(s, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    return o.select(
        k.alias("claim_id"), (c % 60).alias("event_id"), pick(("casualty", "casualty", "casualty", "statement", "event", "number"), k % 6).alias("kind"),
        F.when(k % 3 > 0, F.concat(F.when(k % 2 == 0, "Desk ").otherwise("desk "), (c % 40).cast("string"))).alias("claimed_by"), F.when(k % 11 == 0, "military").alias("claimed_by_kind"), F.when(k % 7 == 0, F.concat(F.lit("p"), (c % 5).cast("string"))).alias("party"),
        F.floor(F.col("o_totalprice") / 5000).cast("long").alias("number"), pick(("deaths", "injuries"), k % 2).alias("unit"), pick(QUALIFIERS, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("qualifier"),
        F.when(k % 101 > 0, F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long") * 2160).alias("at"), (k % 13 == 0).alias("correction"), F.when(k % 97 == 0, k - 1).alias("superseded_by"),
    )


def evidence_of(s, d):
    li, n = t(s, d, "lineitem"), F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("article_id"), F.when(n % 5 == 4, "disputes").when(n % 7 == 6, "refutes").when(F.col("l_suppkey") % 2 == 0, "supports").otherwise("reports").alias("stance"),
        F.when(F.col("l_quantity") == 50, "wire:pool").alias("family_key"), F.when(F.col("l_partkey") % 8 == 1, "ap").when(F.col("l_partkey") % 8 == 5, "wire:post").alias("wire_family"), F.when(F.col("l_quantity") < 6, F.col("l_partkey") % 9).alias("reprint_of"),
        F.when(F.col("l_suppkey") % 10 > 0, F.col("l_suppkey")).alias("source_id"), (F.col("l_suppkey") % 9).alias("source_family_id"), F.when(F.col("l_suppkey") % 3 == 0, "ownership").when(F.col("l_suppkey") % 3 == 1, "platform").alias("source_family_kind"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("d"), (F.col("l_partkey") % 30).cast("string"))).alias("domain"), (F.col("l_discount") > 0.05).alias("has_primary"), (F.col("l_tax") > 0.04).alias("is_party"),
    )


def claim_verdicts(s, d):
    return verdicts.verified(claims_of(s, d), evidence_of(s, d))


def number_disputes(s, d):
    return verdicts.disputes(claims_of(s, d))


def verified_events(s, d):
    """What each event holds once the ladder, replaced figures and contradictions have spoken."""
    return desk.histogram(claim_verdicts(s, d))


_CLAIMS = f"""c AS (SELECT o_orderkey AS claim_id, o_custkey % 60 AS event_id, ['casualty', 'casualty', 'casualty', 'statement', 'event', 'number'][o_orderkey % 6 + 1] AS kind,
  CASE WHEN o_orderkey % 3 > 0 THEN (CASE WHEN o_orderkey % 2 = 0 THEN 'Desk ' ELSE 'desk ' END) || (o_custkey % 40) END AS claimed_by, o_orderkey % 11 = 0 AS military, CASE WHEN o_orderkey % 7 = 0 THEN 'p' || (o_custkey % 5) END AS party,
  floor(o_totalprice / 5000)::BIGINT AS number, ['deaths', 'injuries'][o_orderkey % 2 + 1] AS unit, {list(QUALIFIERS)!r}[left(o_orderpriority, 1)::INT] AS qualifier,
  CASE WHEN o_orderkey % 101 > 0 THEN date_diff('day', DATE '1990-01-01', o_orderdate::DATE) * 2160 END AS moment, o_orderkey % 13 = 0 AS correction, CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 END AS superseded_by FROM orders),
f AS (SELECT *, coalesce('actor:' || lower(claimed_by), 'party:' || party, 'claim:' || claim_id) AS actor, CASE qualifier WHEN 'up_to' THEN 0 WHEN 'about' THEN number * 0.85::DOUBLE ELSE number END::DOUBLE AS low,
  CASE WHEN qualifier IN ('at_least', 'more_than') THEN 'inf'::DOUBLE WHEN qualifier = 'about' THEN number * 1.15::DOUBLE ELSE number END AS high FROM c WHERE kind = 'casualty' AND moment IS NOT NULL),
r AS (SELECT *, max(moment) OVER g AS last FROM f WINDOW g AS (PARTITION BY event_id, unit, actor)),
active AS (SELECT * FROM r WHERE moment = last),
one AS (SELECT event_id, unit, actor, min(claim_id) AS "by", min(number) AS now, bool_or(correction) AS corrects FROM active GROUP BY ALL HAVING count(*) = 1),
older AS (SELECT claim_id, "by" FROM r JOIN one USING (event_id, unit, actor) WHERE moment < last AND (number <> now OR corrects)),
x AS (SELECT DISTINCT a.claim_id, a.event_id, a.unit, a.actor, a.number FROM active a JOIN active b USING (event_id, unit) WHERE a.actor <> b.actor AND abs(a.moment - b.moment) <= 48 * 3600 AND (a.high < b.low OR b.high < a.low)
  AND abs(a.number - b.number) > 1 AND abs(a.number - b.number) / greatest(1.0::DOUBLE, a.number, b.number) > 0.1)"""
DISPUTES = f"WITH {_CLAIMS} SELECT event_id, unit, count(*) AS claims, count(DISTINCT actor) AS sources, min(number) AS least, max(number) AS greatest FROM x GROUP BY ALL"
_VERDICTS = f"""{_CLAIMS},
e AS (SELECT l_orderkey AS claim_id, l_partkey AS article_id, CASE WHEN l_linenumber % 5 = 4 THEN 'disputes' WHEN l_linenumber % 7 = 6 THEN 'refutes' WHEN l_suppkey % 2 = 0 THEN 'supports' ELSE 'reports' END AS stance, l_tax > 0.04 AS is_party, l_discount > 0.05 AS has_primary,
  CASE WHEN l_quantity = 50 THEN 'wire:pool' WHEN l_partkey % 8 = 1 THEN 'wire:ap' WHEN l_partkey % 8 = 5 THEN 'wire:post' WHEN l_quantity < 6 THEN 'reprint:' || (l_partkey % 9)
   WHEN EXISTS (SELECT 1 FROM lineitem z WHERE z.l_orderkey = y.l_orderkey AND z.l_quantity < 6 AND z.l_partkey % 9 = y.l_partkey) THEN 'reprint:' || l_partkey
   WHEN l_suppkey % 3 = 0 THEN 'family:' || (l_suppkey % 9) WHEN l_suppkey % 10 > 0 THEN 'source:' || l_suppkey WHEN l_partkey % 2 = 0 THEN 'domain:d' || (l_partkey % 30) ELSE 'article:' || l_partkey END AS family FROM lineitem y),
h AS (SELECT e.*, kind, CASE WHEN stance = 'supports' AND is_party AND kind <> 'statement' THEN 'reports' ELSE stance END AS s FROM e JOIN c USING (claim_id)),
n AS (SELECT claim_id, count(DISTINCT family) FILTER (s = 'supports') AS su, count(DISTINCT family) FILTER (s = 'reports') AS re, count(DISTINCT family) FILTER (s = 'disputes') AS di, count(DISTINCT family) FILTER (s = 'refutes') AS rf,
  count(DISTINCT family) FILTER (s IN ('supports', 'reports')) AS chains, bool_or(has_primary) FILTER (s = 'supports') AS ps, bool_or(has_primary) FILTER (s = 'refutes') AS pr FROM h GROUP BY 1),
v AS (SELECT c.*, coalesce(su, 0) AS su, coalesce(re, 0) AS re, coalesce(di, 0) AS di, coalesce(rf, 0) AS rf, coalesce(chains, 0) AS chains, coalesce(ps, false) AS ps, coalesce(pr, false) AS pr FROM c LEFT JOIN n USING (claim_id)),
w AS (SELECT v.*, older."by" AS newer, CASE WHEN older."by" IS NOT NULL THEN 'outdated' WHEN x.claim_id IS NOT NULL THEN 'disputed' WHEN superseded_by IS NOT NULL THEN 'outdated' WHEN di > 0 OR rf > 0 AND su + re > 0 THEN 'disputed' WHEN rf >= 2 OR pr THEN 'refuted' WHEN rf = 1 THEN 'disputed'
  WHEN kind = 'statement' THEN CASE WHEN ps OR su >= 2 THEN 'corroborated' WHEN su > 0 THEN 'partially_corroborated' ELSE 'reported' END
  WHEN su >= 2 THEN 'corroborated' WHEN su = 1 THEN 'partially_corroborated' WHEN re > 0 THEN CASE WHEN party IS NOT NULL OR military THEN 'unverified' ELSE 'reported' END ELSE 'unverified' END AS status
  FROM v LEFT JOIN older USING (claim_id) LEFT JOIN x USING (claim_id))"""
VERDICTS = f"WITH {_VERDICTS} SELECT claim_id, event_id, status, coalesce(newer, superseded_by) AS superseded_by, chains, ps AS has_primary, rf > 0 AS has_refutation FROM w"
EVENTS = f"WITH {_VERDICTS} SELECT event_id, {', '.join(f'''count(*) FILTER (status = '{x}') AS {x}''' for x in desk.STATUSES)} FROM w GROUP BY 1"

PAIRS = {"claim_verdicts": (claim_verdicts, VERDICTS), "number_disputes": (number_disputes, DISPUTES), "verified_events": (verified_events, EVENTS)}
