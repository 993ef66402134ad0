"""Queries over pages and documents: normalising, families of copies, near copies, search, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, html, text, urls
from ..operators import linkage, search
from ..session import spread


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _regex(p: str) -> str:
    return p.replace("'", "''")


NORM = f"trim(regexp_replace(lower(translate(text, '{text.FULL}', '{_regex(text.HALF)}')), '{_regex(text.PUNCT)}', ' ', 'g'))"
QUESTION = "the of that pathetic loser thing"


def url_normalized(s, d):
    return t(s, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url_norm"), urls.domain(F.col("url")).alias("domain"))


_TRACK = ", ".join(f"'{k}'" for k in urls.TRACKING)
URL_NORMALIZED = rf"""
WITH p AS (SELECT page_id, trim(url) AS u, lower(regexp_extract(trim(url), '{urls.PARTS}', 1)) AS scheme, regexp_extract(trim(url), '{urls.PARTS}', 2) AS auth,
  regexp_extract(trim(url), '{urls.PARTS}', 3) AS path, regexp_extract(trim(url), '{urls.PARTS}', 4) AS q FROM pages),
h AS (SELECT *, regexp_replace(lower(regexp_replace(auth, '^.*@', '')), ':[0-9]*$', '') AS domain, regexp_extract(auth, ':([0-9]+)$', 1) AS port,
  array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT (lower(split_part(p, '=', 1)) IN ({_TRACK}) OR regexp_matches(lower(split_part(p, '=', 1)), '{urls.TRACKING_PREFIX}'))), lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': p}})), lambda x: x.p), '&') AS kept FROM p)
SELECT page_id, CASE WHEN scheme = '' THEN left(u, 500) ELSE scheme || '://' || domain || CASE WHEN port = '' OR scheme = 'http' AND port = '80' OR scheme = 'https' AND port = '443' THEN '' ELSE ':' || port END
  || CASE WHEN path IN ('', '/') THEN '/' WHEN kept = '' THEN regexp_replace(path, '/$', '') ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END AS url_norm, domain FROM h"""


def url_domain_counts(s, d):
    p = t(s, d, "pages")
    return p.groupBy(urls.base_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"), F.countDistinct(urls.normalize_url(F.col("url"))).alias("distinct_urls"), F.count_if(urls.public_url_problem(F.col("url")).isNotNull()).alias("refused"))


def page_links(s, d):
    """Addresses of pages as links may hold them, some of them bent first."""
    k = F.col("page_id")
    bent = F.when(k % 5 == 0, F.concat(F.lit(" HTTP"), F.expr("substr(url, instr(url, '://'))"), F.lit(" "))).when(k % 5 == 1, F.replace("url", F.lit("://"), F.lit("://WWW."))).when(k % 5 == 2, F.replace("url", F.lit("://"), F.lit(":/"))).when(k % 5 == 3, F.regexp_replace("url", "^(https?://[^/]*).*$", "$1:443#x")).otherwise(F.col("url"))
    return t(s, d, "pages").select("page_id", urls.safe_external(bent).alias("link"), urls.shown_host(bent).alias("host"))


_WEB = r"^(https?)://([^/?#:]+)(:[0-9]*)?([^?#]*)(.*)$"
LINKS = rf"""WITH b AS (SELECT page_id, trim(CASE page_id % 5 WHEN 0 THEN 'http' || substr(url, position('://' IN url)) WHEN 1 THEN replace(url, '://', '://WWW.') WHEN 2 THEN replace(url, '://', ':/') WHEN 3 THEN regexp_replace(url, '^(https?://[^/]*).*$', '\1:443#x') ELSE url END) AS u FROM pages),
p AS (SELECT page_id, u, lower(regexp_extract(u, '{_WEB}', 1)) AS s, lower(regexp_extract(u, '{_WEB}', 2)) AS h, regexp_extract(u, '{_WEB}', 3) AS port, regexp_extract(u, '{_WEB}', 4) AS path, regexp_extract(u, '{_WEB}', 5) AS rest FROM b)
SELECT page_id, CASE WHEN h <> '' THEN s || '://' || h || CASE WHEN port IN ('', ':') OR s = 'http' AND port = ':80' OR s = 'https' AND port = ':443' THEN '' ELSE port END || CASE WHEN path = '' THEN '/' ELSE path END || rest END AS link, CASE WHEN h = '' THEN 'link' ELSE regexp_replace(h, '^www\.', '') END AS host FROM p"""


URL_DOMAIN_COUNTS = f"""
WITH n AS ({URL_NORMALIZED}) SELECT regexp_replace(domain, '^www\\.', '') AS domain, count(*) AS pages, count(DISTINCT url_norm) AS distinct_urls,
  count(*) FILTER (NOT starts_with(url_norm, 'http')) AS refused FROM n GROUP BY 1"""


def page_plain_text(s, d):
    return spread(t(s, d, "pages").select("page_id", "html")).select("page_id", html.strip_html(F.col("html")).alias("plain"))


def _page_sql() -> str:
    x = r"regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g')"
    for tag in html.DROPPED:
        x = rf"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}\s*>', ' ', 'g')"
        x = rf"regexp_replace({x}, '(?i)<{tag}[^>]*>', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '{html.BLOCKS}', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
    for n in range(32, 128):
        if n in (34, 38, 39, 60, 62):
            x = f"replace({x}, '&#{n};', chr({n}))"
    for name, sign in html.ENTITIES.items():
        x = f"regexp_replace({x}, '(?i)&{name};', '{_regex(sign)}', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t\x{{A0}}]+', ' ', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"SELECT page_id, regexp_replace(regexp_replace({x}, '^[\s]+', ''), '[\s]+$', '') AS plain FROM pages"


def page_title_norm(s, d):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return t(s, d, "pages").select("page_id", text.normalize_title(html.decode_entities(title)).alias("title_norm"), html.first_image(F.col("html")).alias("image"))


PAGE_TITLE = rf"""SELECT page_id, regexp_replace(lower(translate({"replace(" * 5}regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '{text.FULL}', '{_regex(text.HALF)}')), '{_regex(text.PUNCT)}', '', 'g') AS title_norm,
  nullif(regexp_extract(html, '(?i)<img[^>]+src\s*=\s*["'']?(https?://[^"''\s>]+)', 1), '') AS image FROM pages"""


def doc_tokens(s, d):
    return t(s, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("fts_md5"))


# the tables hold no Han signs, so tokens are the words of more than one letter or with a digit
_WORDS = f"list_filter(string_split({NORM}, ' '), lambda w: length(w) > 1 OR regexp_matches(w, '[0-9]'))"
DOC_TOKENS = f"WITH x AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS fts_md5 FROM x"


def doc_lang_detect(s, d):
    return t(s, d, "documents").select("doc_id", text.detect_lang(F.col("text")).alias("detected"), "lang")


def _lang_sql() -> str:
    votes = {k: f"len(regexp_extract_all(left(text, 2000), '(?i)\\b({'|'.join(w.split())})\\b'))" for k, w in text.STOP.items()}
    cases = " ".join(f"WHEN {k}_n = greatest(fr_n, de_n, es_n, en_n) THEN '{k}'" for k in votes)
    return f"""WITH v AS (SELECT doc_id, lang, text, len(regexp_extract_all(left(text, 2000), '[a-zA-Z]')) AS letters, {', '.join(f'{v} AS {k}_n' for k, v in votes.items())} FROM documents)
SELECT doc_id, lang, CASE WHEN text IS NULL OR trim(left(text, 2000)) = '' OR letters <= 10 THEN 'other' WHEN greatest(fr_n, de_n, es_n, en_n) = 0 THEN 'en' {cases} END AS detected FROM v"""


def doc_numbers(s, d):
    n = text.numbers(F.col("text"))
    return t(s, d, "documents").select("doc_id", F.array_join(n, "|").alias("numbers"), F.array_join(text.date_anchors(F.col("text")), "|").alias("dates"), text.excerpt(F.col("text"), 80).alias("excerpt"))


DOC_NUMBERS = r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '(\d+(?:\.\d+)?)', 1)[1:10], '|') AS numbers,
  (SELECT coalesce(string_agg(x, '|' ORDER BY i), '') FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT list_transform(regexp_extract_all(text, '(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})', 1), lambda z: regexp_replace(z, '[/.]', '-', 'g')) AS l)) GROUP BY x ORDER BY 2 LIMIT 8)) AS dates,
  CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 80 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE left(trim(regexp_replace(text, '\s+', ' ', 'g')), 79) || '…' END AS excerpt FROM documents"""


def doc_exact_families(s, d):
    return linkage.exact_families(t(s, d, "documents"))


DOC_EXACT = f"""WITH h AS (SELECT doc_id, source, sha256({NORM}) AS content_hash FROM documents WHERE text IS NOT NULL)
SELECT content_hash, min(doc_id) AS root, count(*) AS members, count(DISTINCT source) AS sources FROM h GROUP BY content_hash"""


def doc_family_roots(s, d):
    return linkage.family_roots(t(s, d, "documents"))


DOC_ROOTS = f"""WITH h AS (SELECT doc_id, source, sha256({NORM}) AS content_hash FROM documents WHERE text IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY content_hash) AS root, doc_id <> min(doc_id) OVER (PARTITION BY content_hash) AS is_reprint, CASE WHEN count(*) OVER (PARTITION BY content_hash) > 1 THEN 'reprint:' || min(doc_id) OVER (PARTITION BY content_hash) ELSE 'source:' || source END AS family_key FROM h"""


def doc_simhash(s, d):
    return hashing.simhash64(t(s, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w")))


def doc_hamming_pairs(s, d):
    return linkage.hamming_pairs(doc_simhash(s, d).where("simhash IS NOT NULL"), 3)


def doc_jaccard_pairs(s, d):
    return linkage.near_copies(t(s, d, "documents"), 0.62)


DOC_JACCARD = f"""WITH x AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split({NORM}, ' '), lambda w: length(w) > 1 OR regexp_matches(w, '[0-9]')))) AS w FROM documents),
c AS (SELECT w, len(w) AS n, min(doc_id) AS rep FROM x WHERE len(w) > 0 GROUP BY w), g AS (SELECT rep, n, unnest(w) AS tok FROM c)
SELECT rep AS left_id, doc_id AS right_id, 1.0::DOUBLE AS score FROM x JOIN c USING (w) WHERE doc_id <> rep UNION ALL
SELECT a.rep, b.rep, round(count(*) / (a.n + b.n - count(*)), 4) FROM g a JOIN g b ON a.tok = b.tok AND a.rep < b.rep AND least(a.n, b.n) >= 0.61 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.62 * (a.n + b.n - count(*))"""


def reprint_chain_roots(s, d):
    o = t(s, d, "orders")
    prev = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    same = F.lag("o_orderpriority").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) == F.col("o_orderpriority")
    return linkage.chain_roots(o.select(F.col("o_orderkey").alias("id"), F.when(same, prev).alias("reprint_of")))


CHAIN = """WITH RECURSIVE e AS (SELECT o_orderkey AS id, CASE WHEN lag(o_orderpriority) OVER w = o_orderpriority THEN lag(o_orderkey) OVER w END AS reprint_of FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r AS (SELECT id, id AS root, 0 AS depth FROM e WHERE reprint_of IS NULL UNION ALL SELECT e.id, r.root, r.depth + 1 FROM e JOIN r ON e.reprint_of = r.id) SELECT id, root, depth::BIGINT AS depth FROM r"""


def bm25_docs(s, d):
    return search.bm25(t(s, d, "documents"), QUESTION, 50)


_Q = ", ".join(f"'{w}'" for w in dict.fromkeys(QUESTION.split()))
_POST = f"x AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM x), p AS (SELECT doc_id, len(w) AS dl, tok, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS tok FROM x) GROUP BY ALL HAVING tok IN ({_Q})), f AS (SELECT tok, count(*) AS df FROM p GROUP BY tok)"
BM25 = f"""WITH {_POST} SELECT doc_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN f USING (tok), n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50"""


def qa_ranked_docs(s, d):
    return search.rank_for_question(t(s, d, "documents"), QUESTION, 12)


def _relevance(expr: str) -> str:
    words = f"list_filter(string_split(trim(regexp_replace(lower({expr}), '{_regex(text.PUNCT)}', ' ', 'g')), ' '), lambda w: length(w) > 1 OR regexp_matches(w, '[0-9]'))"
    return f"len(list_intersect(list_distinct({words}), [{_Q}])) / {len(QUESTION.split())}.0"


QA = rf"""WITH s AS (SELECT doc_id, {_relevance("left(text, 80)")} AS title, {_relevance("left(text, 280)")} AS head,
  list_max(list_transform(list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?'), lambda z: trim(z)), lambda z: length(z) >= 12 AND length(z) <= 500)[1:80], lambda z: {_relevance("z")})) AS best FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(5 * title + 2 * head + 3 * coalesce(best, 0), 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 12"""


def event_and_search(s, d):
    top = t(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)
    hay = F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    return search.all_terms(top.withColumn("hay", hay), "hay", ["high", "o"]).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


EVENT_AND = "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) WHERE contains(lower(o_orderpriority || ' ' || o_orderstatus), 'high') AND contains(lower(o_orderpriority || ' ' || o_orderstatus), 'o')"
TERMS = ["idiot", "apache license", "www.", "the mit license", "zzzz"]


def watchlist_matches(s, d):
    return search.watchlist(t(s, d, "documents").select("doc_id", "text"), TERMS)


WATCH = "SELECT doc_id, term FROM documents, (VALUES " + ", ".join(f"('{w}')" for w in TERMS) + ") v(term) WHERE contains(lower(text), term)"


def conversation_turns(s, d):
    c = t(s, d, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", "role", (F.coalesce(F.lag("role").over(w) == F.col("role"), F.lit(False))).alias("same_role"), F.sum(F.length("text")).over(w).cast("long").alias("chars_so_far"))


CONV = "SELECT conv_id, turn, role, coalesce(lag(role) OVER w = role, false) AS same_role, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS chars_so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"

PAIRS = {
    "url_normalized": (url_normalized, URL_NORMALIZED), "url_domain_counts": (url_domain_counts, URL_DOMAIN_COUNTS), "page_plain_text": (page_plain_text, _page_sql()), "page_title_norm": (page_title_norm, PAGE_TITLE),
    "doc_tokens": (doc_tokens, DOC_TOKENS), "doc_lang_detect": (doc_lang_detect, _lang_sql()), "doc_numbers": (doc_numbers, DOC_NUMBERS), "doc_exact_families": (doc_exact_families, DOC_EXACT), "doc_family_roots": (doc_family_roots, DOC_ROOTS),
    "page_links": (page_links, LINKS), "doc_simhash": (doc_simhash, None), "doc_hamming_pairs": (doc_hamming_pairs, None), "doc_jaccard_pairs": (doc_jaccard_pairs, DOC_JACCARD), "reprint_chain_roots": (reprint_chain_roots, CHAIN), "bm25_docs": (bm25_docs, BM25),
    "qa_ranked_docs": (qa_ranked_docs, QA), "event_and_search": (event_and_search, EVENT_AND), "watchlist_matches": (watchlist_matches, WATCH), "conversation_turns": (conversation_turns, CONV),
}
