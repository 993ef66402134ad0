"""Queries of what comes in: summaries of unknown JSON, articles of one identity and their versions, seed lists with faults; and their SQL, which knows what was put in."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import opened
from ..operators import identity, seeds
from ..session import shared_folder, spread
from ..sources import feeds, replay
from .ingest_queries import _turns
from .text_queries import t


def _quoted(s):
    return F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def opened_summaries(s, d):
    """Summaries as objects, as JSON in a string once to three times over, and cut off, with fields of wrong types."""
    k = F.col("o_orderkey")
    line, confirmed = F.when(k % 5 == 0, "5").otherwise(F.concat(F.lit('"order '), k, F.lit('"'))), F.when(k % 7 == 0, "3").otherwise(F.concat(F.lit('[{"text": "t'), k, F.lit('", "claimId": "c", "citations": [{"a": 1}, 3]}, 5, null, {"text": 7}]')))
    why = F.when(k % 3 == 0, '{"text": "w", "generatedBy": "ai"}').when(k % 3 == 1, '{"text": 4}').otherwise("null")
    base = F.concat(F.lit('{"oneLiner": '), line, F.lit(', "confirmed": '), confirmed, F.lit(', "disputed": [{"positions": [{"number": 12.5}, {"number": "x", "party": "q"}]}], "whyItMatters": '), why, F.lit("}"))
    raw = F.when(k % 6 < 2, base).when(k % 6 == 2, _quoted(base)).when(k % 6 == 3, _quoted(_quoted(base))).when(k % 6 == 4, _quoted(_quoted(_quoted(base)))).otherwise(F.substring(base, 1, 15))
    x = spread(t(s, d, "orders").select("o_orderkey")).select(k.alias("event_id"), opened.summary(opened.opened(raw)).alias("x"))
    items = F.array_join(F.transform("x.confirmed", lambda c: F.concat_ws("/", c["text"], c["claim_id"], F.size(c["citations"]).cast("string"))), ";")
    said = F.array_join(F.transform(F.flatten(F.transform("x.disputed", lambda g: g["positions"])), lambda p: F.concat_ws(":", p["party"], F.coalesce(p["number"].cast("string"), F.lit("-")))), ";")
    return x.select("event_id", F.col("x").isNotNull().alias("opened"), F.col("x.one_liner").alias("one_liner"), items.alias("confirmed"), said.alias("disputed"), F.concat_ws("/", "x.why.text", "x.why.by").alias("why"))


OPENED = """SELECT o_orderkey AS event_id, o_orderkey % 6 < 4 AS opened, CASE WHEN o_orderkey % 6 < 4 THEN CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'order ' || o_orderkey END END AS one_liner, CASE WHEN o_orderkey % 6 < 4 THEN CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 't' || o_orderkey || '/c/1;//0' END END AS confirmed,
 CASE WHEN o_orderkey % 6 < 4 THEN 'unknown:12.5;q:-' END AS disputed, CASE WHEN o_orderkey % 6 < 4 AND o_orderkey % 3 = 0 THEN 'w/ai' ELSE '' END AS why FROM orders"""


def _arriving(s, d):
    k = F.col("o_orderkey")
    third = lambda x: F.concat(F.lit("u"), F.floor(x / 3))
    return t(s, d, "orders").select(
        k.alias("article_id"), F.when(k % 5 > 0, third(k)).alias("canonical_url"), F.when(k % 11 > 0, third(k + 1)).alias("normalized_url"), (F.col("o_custkey") % 3).alias("source_id"), F.when(k % 60 == 0, F.concat(F.lit("g"), k % 997)).alias("guid"),
        F.when(k % 4 > 0, (k % 8 < 6).cast("string")).alias("content_hash"), F.when(k % 9 == 0, "other").otherwise("title").alias("title_norm"), F.when(k % 13 > 2, F.floor(k / 50).cast("string")).alias("changed_at"),
    )


def article_identities(s, d):
    return identity.identities(_arriving(s, d))


def article_arrivals(s, d):
    a = _arriving(s, d)
    return identity.arrivals(a, identity.identities(a))


_IDENTITY = """a AS (SELECT o_orderkey AS id, o_custkey % 3 AS src, CASE WHEN o_orderkey % 5 > 0 THEN 'u' || (o_orderkey // 3) END AS c, CASE WHEN o_orderkey % 11 > 0 THEN 'u' || ((o_orderkey + 1) // 3) END AS n, CASE WHEN o_orderkey % 60 = 0 THEN 'g' || (o_orderkey % 997) END AS g,
  CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 8 < 6 END AS h, o_orderkey % 9 = 0 AS t, CASE WHEN o_orderkey % 13 > 2 THEN o_orderkey // 50 END AS m FROM orders),
e AS (SELECT id, 'url:' || c AS key FROM a WHERE c IS NOT NULL UNION SELECT id, 'url:' || n FROM a WHERE n IS NOT NULL UNION SELECT id, 'guid:' || src || ':' || g FROM a WHERE g IS NOT NULL),
l AS (SELECT DISTINCT x.id AS i, y.id AS j FROM e x JOIN e y USING (key)), r AS (SELECT id, id AS root FROM a UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.id), f AS (SELECT id AS article_id, min(root) AS identity FROM r GROUP BY 1)"""
IDENTITIES = f"WITH RECURSIVE {_IDENTITY} SELECT article_id, identity FROM f"
ARRIVALS = f"""WITH RECURSIVE {_IDENTITY}, b AS (SELECT article_id, identity, h, t, m, lag(h) OVER w AS bh, lag(t) OVER w AS bt, lag(m) OVER w AS bm, row_number() OVER w AS k FROM f JOIN a ON a.id = article_id WINDOW w AS (PARTITION BY identity ORDER BY article_id)),
x AS (SELECT *, CASE WHEN k = 1 THEN 'new' WHEN coalesce(h <> bh, false) OR t <> bt OR coalesce(m <> bm, false) THEN 'update' ELSE 'exact' END AS kind FROM b)
SELECT article_id, identity, kind, count(*) FILTER (kind <> 'exact') OVER (PARTITION BY identity ORDER BY article_id ROWS UNBOUNDED PRECEDING) AS version FROM x"""

#: A seed that breaks no rule, and what is changed in it to break one: rules, text, other text.
SEED = """{"id":"s-%","name":"S","homepage":"https://a.org/x","feedUrl":"https://a.org/feed","adapter":"rss","config":null,"country":"fr","region":"eu","lang":"fr","category":"wire","owner":"O","ownershipNote":"N","isParty":false,"partyOf":null,"isPrimary":false,"paywalled":false,"fetchFulltext":true,"intervalMin":30,"verifStatus":"verified","verifBasis":"B","lastReviewedAt":"2024-02-29T10:00:00.000Z","familyId":"f-1","enabled":true,"lastFetchAt":null,"lastSuccessAt":null,"consecFails":0,"backoffUntil":null,"health":"unknown","corrections":0,"addedBy":"seed","notes":null}"""
CONFIGURED = '"feedUrl":"https://a.org/feed","adapter":"rss","config":null'
FAULTS = (
    ("", "", ""), ("not an object", SEED[:1], "["), ("fields missing", ',"notes":null', ""), ("fields unknown", '"notes"', '"more":1,"notes"'), ("name", '"name":"S"', '"name":" "'), ("region", '"region":"eu"', '"region":7'), ("country", '"country":"fr"', '"country":""'), ("country form", '"country":"fr"', '"country":"FR"'),
    ("isPrimary", '"isPrimary":false', '"isPrimary":"no"'), ("intervalMin", ":30,", ":30.5,"), ("interval range", ":30,", ":4,"), ("category", '"wire"', '"other"'), ("not verified", '"verified"', '"pending"'), ("id form", '"s-%"', '"S-%"'), ("familyId form", '"f-1"', '"-f"'), ("homepage form", "https://a.org/x", "https://u:p@a.org/x"),
    ("feedUrl form", "https://a.org/feed", "ftp://a.org/feed"), ("lastReviewedAt form", "2024-02-29T", "2023-02-29T"), ("party", '"isParty":false', '"isParty":true'), ("times set", '"lastFetchAt":null', '"lastFetchAt":"2024-01-01T00:00:00.000Z"'), ("counts set", '"corrections":0', '"corrections":2'), ("health at start", '"enabled":true', '"enabled":false'),
    ("placeholder enabled", "https://a.org/feed", "{RSSHUB}/a"), ("feed needed", '"feedUrl":"https://a.org/feed"', '"feedUrl":null'), ("feed with config", '"config":null', '"config":{"a":"b"}'), ("config", '"config":null', '"config":3'), ("config needed", CONFIGURED, '"feedUrl":null,"adapter":"gdelt","config":null'), ("", CONFIGURED, '"feedUrl":null,"adapter":"gdelt","config":{"query":"a","timespan":"6H"}'),
    ("gdelt timespan", CONFIGURED, '"feedUrl":null,"adapter":"gdelt","config":{"query":"a","timespan":"6x"}'), ("gdelt config", CONFIGURED, '"feedUrl":null,"adapter":"gdelt","config":{"timespan":"6h"}'), ("mastodon config", CONFIGURED, '"feedUrl":null,"adapter":"mastodon","config":{"instance":"https://m.org","acct":"a","x":"y"}'), ("mastodon instance", CONFIGURED, '"feedUrl":null,"adapter":"mastodon","config":{"instance":"m.org","acct":"a"}'),
    ("", CONFIGURED, '"feedUrl":null,"adapter":"bluesky","config":{"actor":"a"}'), ("bluesky config", CONFIGURED, '"feedUrl":null,"adapter":"bluesky","config":{"acct":"a"}'), ("telegram channel", CONFIGURED, '"feedUrl":null,"adapter":"telegramweb","config":{"channel":"abc"}'), ("config with feed", '"adapter":"rss","config":null', '"adapter":"bluesky","config":{"actor":"a"}'), ("adapter", '"rss"', '"atom"'),
)


def seeds_of(s, d):
    """Customers as seeds, most of them with a fault."""
    k, out = F.col("c_custkey"), F.lit(None).cast("string")
    for i, (_, a, b) in enumerate(FAULTS):
        out = F.when(k % len(FAULTS) == i, SEED.replace(a, b) if a else SEED).otherwise(out)
    return spread(t(s, d, "customer").select("c_custkey")).select(k.alias("key"), F.replace(out, F.lit("%"), k.cast("string")).alias("seed"))


def seed_faults(s, d):
    # an inner explode would have the faults found again for each condition that is inferred from it
    return seeds.judged(seeds_of(s, d)).select("key", F.explode_outer("faults").alias("fault")).where("fault IS NOT NULL")


_FAULTS = ", ".join(f"({i}, '{name}')" for i, (name, *_) in enumerate(FAULTS) if name)
SEEDS = f"SELECT c_custkey AS key, fault FROM customer JOIN (VALUES {_FAULTS}) f(i, fault) ON c_custkey % {len(FAULTS)} = i"

def answers_of(s, d):
    """Conversations as recorded answers of three kinds of feeds, a minute apart."""
    turns, key = _turns(s, d), F.col("conv_id")
    index = turns.where(key % 3 == 2).groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("pos", "url", "title"))).alias("articles"))).alias("body"))
    kinds = {"rss": feeds.render_rss(turns.where(key % 3 == 0), "conv_id"), "jsonfeed": feeds.render_json_feed(turns.where(key % 3 == 1), "conv_id"), "gdelt": index}
    out = None
    for adapter, bodies in kinds.items():
        rows = bodies.select("conv_id", F.concat(F.lit("c"), key.cast("string")).alias("source_id"), F.lit(adapter).alias("adapter"), F.lit(None).cast("string").alias("query"), F.timestamp_seconds(1_700_000_000 + 60 * key).alias("fetched_at"), "body", F.lit(0).alias("offset_minutes"))
        out = rows if out is None else out.unionByName(rows)
    return out


def feed_answers(s, d):
    """Items of answers that were recorded in two generations and are read back from the tenth minute on."""
    path = f"{shared_folder(s)}/answers-{uuid.uuid4().hex}"
    made = answers_of(s, d)
    for half in (0, 1):
        replay.record(made.where(F.col("conv_id") % 2 == half), path)
    replay.register(s)
    read = s.read.format("feed_answers").load(path).where(F.col("fetched_at") >= F.timestamp_seconds(F.lit(1_700_000_600)))
    return replay.dispatch(read).select("source_id", "adapter", "url", "title")


ANSWERED = "SELECT 'c' || conv_id AS source_id, ['rss', 'jsonfeed', 'gdelt'][conv_id % 3 + 1] AS adapter, 'https://example.org/' || conv_id || '?turn=' || turn || '&a=1' AS url, role AS title FROM conversations WHERE conv_id >= 10 AND role IS NOT NULL"

PAIRS = {"feed_answers": (feed_answers, ANSWERED), "opened_summaries": (opened_summaries, OPENED), "article_identities": (article_identities, IDENTITIES), "article_arrivals": (article_arrivals, ARRIVALS), "seed_faults": (seed_faults, SEEDS)}
