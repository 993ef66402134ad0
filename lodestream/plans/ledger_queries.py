"""Queries over claims, the registry of sources and fenced writes with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims, ledger, registry
from ..sources import social
from ..sources.feeds import escape
from .text_queries import t

#: Known speakers of the test tables.
ACTORS = {"office": {"label": "Office", "kind": "gov", "party": "office", "aliases": ["the office"]}, "army": {"label": "Army", "kind": "military", "party": "army", "aliases": ["army", "soldiers"]}}


def claim_flags(s, d):
    x = F.col("text")
    flags = {"statement": claims.has(x, claims.STATEMENT), "intent": claims.has(x, claims.INTENT), "correction": claims.has(x, claims.UPDATE), "question": x.rlike(claims.QUESTION)}
    return t(s, d, "documents").select("doc_id", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))


CLAIM_FLAGS = f"""SELECT doc_id, coalesce(regexp_matches(text, '(?i){claims.STATEMENT[1]}'), false) AS statement, coalesce(regexp_matches(text, '(?i){claims.INTENT[1]}'), false) AS intent,
  coalesce(regexp_matches(text, '(?i){claims.UPDATE[1]}'), false) AS correction, coalesce(regexp_matches(text, '{claims.QUESTION}'), false) AS question FROM documents"""


def claim_drafts(s, d):
    docs = t(s, d, "documents").select(
        F.col("source").alias("event_id"), F.col("doc_id").alias("article_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("excerpt"), F.col("text").alias("body"),
        F.expr("timestamp'2026-07-30'").alias("published_at"), F.col("source").alias("source_name"), F.lit("rss").alias("adapter"), F.lit("wire").alias("category"), F.lit(False).alias("is_party"), F.lit(None).cast("string").alias("party_of"), F.lit(False).alias("is_primary"),
    )
    return claims.claim_drafts(docs, ACTORS)


# ---- sources


def _gathered(rows, one):
    """One array of structs per conversation, in turn order; conversations are short."""
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", one.alias("x")))), lambda r: r["x"]).alias("xs"))


def _url():
    return F.concat_ws("/", F.lit("https://example.org"), "conv_id", "turn")


def status_posts(s, d):
    one = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), _url().alias("url"), F.col("text").alias("content"), F.lit("2026-07-29T10:00:00Z").alias("created_at"), F.struct(F.col("role").alias("acct")).alias("account"))
    feeds = _gathered(t(s, d, "conversations"), one).select("conv_id", F.lit("https://Social.Example.org/x").alias("instance"), F.to_json("xs").alias("body"))
    return social.parse_statuses(feeds).select("conv_id", "url", "guid", "content_html", "author", F.unix_timestamp("published_at").alias("at"))


STATUS = "SELECT conv_id, 'https://example.org/' || conv_id || '/' || turn AS url, conv_id || '-' || turn AS guid, text AS content_html, '@' || nullif(role, '') || '@social.example.org' AS author, 1785319200::BIGINT AS at FROM conversations WHERE text <> ''"


def author_posts(s, d):
    post = F.struct(F.concat_ws("/", F.lit("at://x"), "conv_id", "turn").alias("uri"), F.struct(F.col("role").alias("handle")).alias("author"), F.struct("text", F.lit("2026-07-29T10:00:00.000Z").alias("createdAt")).alias("record"))
    one = F.struct(F.when(F.col("turn") % 3 == 0, F.struct(F.lit("repost").alias("by"))).alias("reason"), post.alias("post"))
    feeds = _gathered(t(s, d, "conversations"), one).select("conv_id", F.lit("asked.org").alias("actor"), F.to_json(F.struct(F.col("xs").alias("feed"))).alias("body"))
    return social.parse_posts(feeds).select("conv_id", "url", "guid", "content_html", "author", F.unix_timestamp("published_at").alias("at"))


POSTS = """SELECT conv_id, 'https://bsky.app/profile/' || coalesce(nullif(role, ''), 'asked.org') || '/post/' || turn AS url, 'at://x/' || conv_id || '/' || turn AS guid, text AS content_html,
  '@' || coalesce(nullif(role, ''), 'asked.org') AS author, 1785319200::BIGINT AS at FROM conversations WHERE text <> '' AND turn % 3 <> 0"""


def preview_posts(s, d):
    one = F.concat(F.lit('<div class="tgme_widget_message x" data-post="chan/'), F.col("turn"), F.lit('"><div class="tgme_widget_message_text js">'), escape(F.col("role")), F.lit(" &amp; "), F.col("turn"), F.lit('</div><time datetime="2026-07-29T10:00:00+00:00"></time></div>'))
    feeds = _gathered(t(s, d, "conversations"), one).select("conv_id", F.col("conv_id").cast("string").alias("channel"), F.concat(F.lit("<html>"), F.array_join("xs", "")).alias("body"))
    return social.parse_preview(feeds).select("conv_id", "url", "guid", "content_html", F.unix_timestamp("published_at").alias("at"))


PREVIEW = "SELECT conv_id, 'https://t.me/' || conv_id || '/' || turn AS url, 'chan/' || turn AS guid, role || ' &amp; ' || turn AS content_html, 1785319200::BIGINT AS at FROM conversations"


def outline_round_trip(s, d):
    page = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("https://example.org/'"), "s_suppkey"))
    rows = t(s, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("pos"), F.concat("s_name", F.lit(' & "x" <y>')).alias("title"), F.concat(F.lit("https://example.org/feed?a=1&b="), "s_suppkey").alias("xml_url"), page.alias("html_url"))
    return social.parse_outlines(social.render_outlines(rows, "s_nationkey", "A & B"))


OUTLINE = """SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, s_name || ' & "x" <y>' AS title, 'https://example.org/feed?a=1&b=' || s_suppkey AS xml_url,
  CASE WHEN s_suppkey % 2 = 0 THEN 'https://example.org/''' || s_suppkey END AS html_url FROM supplier"""


def seed_faults(s, d):
    n, u = t(s, d, "nation"), t(s, d, "supplier")
    families = n.where("n_nationkey % 5 <> 0").unionByName(n.where("n_nationkey % 7 = 1")).select(F.col("n_nationkey").alias("id"))
    adapter = F.element_at(F.array(*map(F.lit, ("rss", "mastodon", "bluesky", "gdelt", "page"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    feed = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("https://A.org/"), F.col("s_suppkey") % 20))
    config = F.create_map(F.lit("instance"), F.lit("https://B.org"), F.lit("acct"), F.concat(F.lit("Acct"), F.col("s_suppkey") % 30), F.lit("actor"), F.col("s_name"), F.lit("query"), F.lit("Q"))
    sources = u.select((F.col("s_suppkey") % 90).alias("id"), F.col("s_nationkey").alias("family_id"), registry.endpoint(adapter, feed, config, F.col("s_suppkey").cast("string")).alias("endpoint"))
    return registry.faults(families, sources)


SEED_FAULTS = """WITH f AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey % 7 = 1),
e AS (SELECT s_suppkey % 90 AS id, s_nationkey AS f, CASE s_suppkey % 5 WHEN 0 THEN 'feed:https://a.org/' || s_suppkey % 20 WHEN 1 THEN 'mastodon:https://b.org:acct' || s_suppkey % 30 WHEN 2 THEN 'bluesky:' || lower(s_name) WHEN 3 THEN 'gdelt:Q:1d' ELSE 'page:' || s_suppkey END AS p FROM supplier)
SELECT 'family twice' AS fault, id::VARCHAR AS key, count(*) AS n FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'source twice', id::VARCHAR, count(*) FROM e GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'endpoint twice', p, count(*) FROM e GROUP BY p HAVING count(*) > 1 UNION ALL SELECT 'family unknown', f::VARCHAR, count(*) FROM e WHERE f NOT IN (SELECT id FROM f) GROUP BY f"""


def registry_sync(s, d):
    u = t(s, d, "supplier")
    state = F.when(F.col("s_acctbal") < 2000, "disabled").when(F.col("s_acctbal") < 5000, "failing").otherwise("ok")
    table = u.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") >= 2000).alias("enabled"), (F.col("s_suppkey") % 7).alias("fails"), state.alias("health"))
    seeds = u.where("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("id"), F.upper("s_name").alias("name"), (F.col("s_suppkey") % 5 != 0).alias("enabled"))
    return registry.sync(table, seeds)


SYNC = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 1 THEN upper(s_name) ELSE s_name END AS name, CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey % 5 <> 0 ELSE s_acctbal >= 2000 END AS enabled,
  CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 7 END AS fails,
  CASE WHEN s_suppkey % 4 <> 1 AND s_suppkey % 5 = 0 THEN 'disabled' WHEN s_suppkey % 3 = 0 THEN 'unknown' WHEN s_acctbal < 2000 AND s_suppkey % 4 <> 1 THEN 'unknown' WHEN s_acctbal < 2000 THEN 'disabled' WHEN s_acctbal < 5000 THEN 'failing' ELSE 'ok' END AS health
FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 4 <> 1"""


# ---- fenced writes and runs

_CUT = "TIMESTAMP_NTZ '1996-01-01'"


def summary_saves(s, d):
    o = t(s, d, "orders")
    last = F.max_by(F.struct(F.col("o_orderpriority").alias("summary"), F.col("o_orderstatus").alias("engine")), F.struct("o_orderdate", "o_orderkey"))
    events = o.where(f"o_orderdate < {_CUT}").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("version"), F.max("o_orderdate").alias("last_update"), last.alias("r")).select("id", "version", "last_update", "r.*")
    coming = o.where(f"o_orderdate >= {_CUT}").groupBy(F.col("o_custkey").alias("id")).agg(last.alias("r")).select("id", "r.*")
    seen = events.select("id", F.when(F.col("id") % 3 != 2, F.col("version") - F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("seen_version"), F.col("last_update").alias("seen_update"))
    return ledger.save_summaries(events, coming.join(seen, "id", "left"))


SUMMARY_SAVES = """WITH a AS (SELECT o_custkey AS id, count(*) AS v, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS s, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS e FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS ns, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS ne FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1),
j AS (SELECT *, CASE WHEN v IS NULL THEN 'missing' WHEN id % 3 = 0 THEN 'stale' WHEN s = ns AND e = ne THEN 'unchanged' ELSE 'saved' END AS outcome FROM b LEFT JOIN a USING (id))
SELECT id, outcome, CASE WHEN outcome = 'saved' THEN v + 1 ELSE v END AS version, CASE WHEN outcome = 'saved' THEN ns ELSE s END AS summary, CASE WHEN outcome = 'saved' THEN ne ELSE e END AS engine, CASE WHEN outcome = 'saved' THEN v END AS old_version FROM j"""


def briefing_saves(s, d):
    o = t(s, d, "orders").select(F.col("o_orderpriority").alias("type"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("content"))
    none = o.limit(0).select(F.lit("").alias("id"), "*", F.lit("").alias("prev_id"))
    first = ledger.save_briefings(none, o.where(f"created_at < {_CUT}"))
    return ledger.save_briefings(first, o.where("created_at >= TIMESTAMP_NTZ '1995-07-01'")).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


BRIEFING_SAVES = """WITH b AS (SELECT o_orderpriority AS type, strftime(o_orderdate, '%Y-%m') AS period, max(o_orderdate) AS made, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS content FROM orders GROUP BY ALL),
i AS (SELECT *, 'brf_' || left(sha256(type || ':' || period), 20) AS id FROM b)
SELECT id, type, period, strftime(made, '%Y-%m-%d %H:%M:%S') AS created_at, content, lag(id) OVER (PARTITION BY type ORDER BY made, period) AS prev_id FROM i"""


def watchlists_clean(s, d):
    rows = t(s, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.split(F.concat(F.lit(" a, ,"), "p_name", F.lit(",")), ",").alias("keywords"), F.lit(None).cast("array<string>").alias("entities"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size") * 3 - 20).alias("min_importance"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("email"), F.lit("fax"), F.lit("push"))).alias("channels"), F.when(F.col("p_size") > 25, False).alias("enabled"),
    )
    return ledger.clean_watchlists(rows).select("id", "name", F.array_join("keywords", "|").alias("keywords"), F.size("entities").alias("n_entities"), "min_importance", F.array_join("channels", "|").alias("channels"), "enabled")


WATCHLISTS = """SELECT p_partkey AS id, left(p_name, 100) AS name, 'a|' || trim(p_name) AS keywords, 0 AS n_entities, CASE WHEN p_size % 10 = 0 THEN 40 ELSE least(greatest(p_size * 3 - 20, 0), 100) END AS min_importance,
  CASE WHEN p_size % 2 = 0 THEN 'email|push' ELSE 'web' END AS channels, p_size <= 25 AS enabled FROM part"""


def log_retained(s, d):
    return ledger.retain(t(s, d, "events"), "ts", F.expr("TIMESTAMP_NTZ '2024-01-25'"), 7).select("event_id", "user_id")


RETAINED = "SELECT event_id, user_id FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-18'"


def run_leases(s, d):
    o, k = t(s, d, "orders"), F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("running", "completed", "remanded", "failed"))), (k % 4 + 1).cast("int"))
    name = F.concat(F.lit("r"), k)
    runs = o.where("o_orderkey % 5 <> 0").select(name.alias("run_id"), status.alias("status"), (k % 6 + 1).alias("attempt"), F.col("o_orderdate").alias("lease_until"), F.when(k % 4 == 3, F.expr("o_orderdate + INTERVAL 30 DAY")).alias("next_attempt_at"))
    asked = o.select(k.alias("event_id"), name.alias("run_id"), F.when(k % 7 != 0, F.concat(F.lit("r"), k - k % 8)).alias("active_run_id"))
    return ledger.acquire_runs(asked, runs, F.expr(_CUT)).drop("lease_until")


RUN_LEASES = """WITH r AS (SELECT 'r' || o_orderkey AS id, ['running', 'completed', 'remanded', 'failed'][o_orderkey % 4 + 1] AS st, o_orderkey % 6 + 1 AS n, o_orderdate > TIMESTAMP '1996-01-01' AS held, o_orderkey % 4 = 3 AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1996-01-01' AS waits FROM orders WHERE o_orderkey % 5 <> 0),
q AS (SELECT o_orderkey AS event_id, 'r' || o_orderkey AS mine, CASE WHEN o_orderkey % 7 <> 0 THEN 'r' || (o_orderkey - o_orderkey % 8) END AS act FROM orders),
j AS (SELECT q.*, m.st, m.n, a.n AS an, coalesce(act <> mine AND a.st = 'running' AND a.held, false) AS blocked,
  CASE WHEN coalesce(act <> mine AND a.st = 'running' AND a.held, false) THEN 'leased' WHEN m.id IS NULL THEN 'new' WHEN m.st IN ('completed', 'remanded') THEN 'already-finished' WHEN m.st = 'running' AND m.held THEN 'leased' WHEN m.waits THEN 'backoff' ELSE 'retry' END AS reason
  FROM q LEFT JOIN r m ON m.id = mine LEFT JOIN r a ON a.id = act)
SELECT event_id, CASE WHEN blocked THEN act ELSE mine END AS run_id, CASE WHEN blocked THEN an WHEN reason = 'new' THEN 1 WHEN reason = 'retry' THEN n + 1 ELSE n END AS attempt, reason IN ('new', 'retry') AS goes, reason FROM j"""

PAIRS = {
    "claim_flags": (claim_flags, CLAIM_FLAGS), "claim_drafts": (claim_drafts, None), "status_posts": (status_posts, STATUS), "author_posts": (author_posts, POSTS), "preview_posts": (preview_posts, PREVIEW),
    "outline_round_trip": (outline_round_trip, OUTLINE), "seed_faults": (seed_faults, SEED_FAULTS), "registry_sync": (registry_sync, SYNC), "summary_saves": (summary_saves, SUMMARY_SAVES),
    "briefing_saves": (briefing_saves, BRIEFING_SAVES), "watchlists_clean": (watchlists_clean, WATCHLISTS), "log_retained": (log_retained, RETAINED), "run_leases": (run_leases, RUN_LEASES),
}
