"""Feed bodies to items, and items to feed bodies, with built-in XML and JSON functions.

Every parser takes a DataFrame with a ``body`` column (one fetched feed a row) and returns the other columns
with one row per item: url, guid, title, summary_html, content_html, author, published_at, updated_at,
image_url and lang. Bodies that do not parse have no items, as have items without url or title. Timestamps
without a zone are read as local time ``offset_minutes`` ahead of UTC; the session's time zone is to be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = ["url", "guid", "title", "summary_html", "content_html", "author", "published_at", "updated_at", "image_url", "lang"]
#: Language names of the news index.
LANGUAGES = {"english": "en", "chinese": "zh", "arabic": "ar", "farsi": "fa", "persian": "fa", "hebrew": "he", "russian": "ru", "french": "fr", "german": "de", "spanish": "es", "japanese": "ja", "korean": "ko", "turkish": "tr", "ukrainian": "uk"}
#: Countries whose feeds leave out the zone, and minutes ahead of UTC.
OFFSETS = {"cn": 480, "hk": 480, "tw": 480, "sg": 480, "jp": 540, "kr": 540, "ir": 210}

_LINK = "array<struct<_VALUE: string, _href: string, _rel: string>>"
_MEDIA = "array<struct<_VALUE: string, _url: string, _type: string>>"
_RSS_ITEM = f"struct<title: string, link: array<string>, guid: string, description: string, `content:encoded`: string, `dc:creator`: string, author: string, pubDate: string, `dc:date`: string, `atom:link`: {_LINK}, enclosure: {_MEDIA}, `media:content`: {_MEDIA}, `media:thumbnail`: {_MEDIA}, `_rdf:about`: string>"
_ENTRY = f"struct<title: string, link: {_LINK}, id: string, summary: string, content: string, author: array<struct<name: string>>, published: string, updated: string>"
_FEED = f"channel struct<item: array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>, entry array<{_ENTRY}>"
_JSON_FEED = "items array<struct<url: string, external_url: string, id: string, title: string, content_text: string, content_html: string, summary: string, image: string, date_published: string, date_modified: string, authors: array<struct<name: string>>, author: struct<name: string>>>"
_INDEX = "articles array<struct<url: string, title: string, seendate: string, socialimage: string, language: string, domain: string, sourcecountry: string>>"


def utc_offset(country: Column) -> Column:
    out = F.lit(0)
    for code, minutes in OFFSETS.items():
        out = F.when(F.lower(country) == code, minutes).otherwise(out)
    return out


def said(c: Column) -> Column:
    """Trimmed text, null when there is none."""
    return F.nullif(F.trim(c), F.lit(""))


def parse_date(c: Column, offset_minutes: Column | int = 0) -> Column:
    """ISO 8601 and RFC 822 dates; null for anything else."""
    t = F.regexp_replace(F.trim(c), r"^[A-Za-z]+,\s*", "")
    t = F.regexp_replace(t, r"\s*(GMT|UTC|UT)$", " +0000")
    found = F.coalesce(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(t))
    zoned = t.rlike(r"(Z|[+-]\d\d:?\d\d)$") & ~t.rlike(r"^\d{4}-\d\d-\d\d$")
    shift = offset_minutes if isinstance(offset_minutes, Column) else F.lit(offset_minutes)
    return F.when(zoned, found).otherwise(found - F.make_dt_interval(mins=shift))


def link_of(links: Column) -> Column:
    """First alternate or plain link, else the first with an address."""
    some = F.filter(links, lambda x: said(x["_href"]).isNotNull())
    best = F.filter(some, lambda x: F.coalesce(x["_rel"], F.lit("")).isin("", "alternate"))
    return F.coalesce(F.get(best, F.lit(0))["_href"], F.get(some, F.lit(0))["_href"])


def image_of(item: Column) -> Column:
    """First enclosed picture, else the first media address."""
    pictures = F.filter(item["enclosure"], lambda x: said(x["_url"]).isNotNull() & (F.coalesce(x["_type"], F.lit("")).startswith("image/") | x["_url"].rlike(r"(?i)\.(jpe?g|png|webp|gif)(\?|$)")))
    return F.coalesce(F.get(pictures, F.lit(0))["_url"], said(F.get(item["media:content"], F.lit(0))["_url"]), said(F.get(item["media:thumbnail"], F.lit(0))["_url"]))


def _items(feeds: DataFrame, items: Column, fields: dict[str, Column], extra: dict[str, Column] | None = None) -> DataFrame:
    others = [c for c in feeds.columns if c != "body"]
    rows = feeds.select(*others, F.explode(items).alias("_it"))
    null = F.lit(None).cast("string")
    got = rows.select(*others, *(fields.get(c, null.cast("timestamp") if c.endswith("_at") else null).alias(c) for c in ITEM), *(v.alias(k) for k, v in (extra or {}).items()))
    return got.where("url IS NOT NULL AND title IS NOT NULL")


def parse_xml(feeds: DataFrame, offset_minutes: Column | int = 0) -> DataFrame:
    """Items of RSS 2.0, RDF and Atom bodies."""
    doc = F.from_xml("body", _FEED, {"mode": "PERMISSIVE"})
    item = F.col("_it")
    kinds = feeds.withColumn("_doc", doc)
    news = F.coalesce(F.col("_doc.channel.item"), F.col("_doc.item"))
    rdf = F.col("_doc.channel.item").isNull()
    rows = kinds.withColumn("_rdf", rdf).withColumn("_news", F.when(F.size(news) > 0, news))
    rss = _items(rows.drop("_doc"), F.col("_news"), {
        "url": F.coalesce(said(F.get(item["link"], F.lit(0))), F.when(~F.col("_rdf"), link_of(item["atom:link"]))), "guid": F.when(F.col("_rdf"), said(item["_rdf:about"])).otherwise(said(item["guid"])), "title": said(item["title"]),
        "summary_html": said(item["description"]), "content_html": F.when(~F.col("_rdf"), said(item["content:encoded"])), "author": F.coalesce(said(item["dc:creator"]), F.when(~F.col("_rdf"), said(item["author"]))),
        "published_at": parse_date(F.coalesce(said(item["pubDate"]), said(item["dc:date"])), offset_minutes), "image_url": F.when(~F.col("_rdf"), image_of(item)),
    }).drop("_rdf", "_news")
    atom = _items(rows.where("_news IS NULL").select(*feeds.columns, F.col("_doc.entry").alias("_entry")), F.col("_entry"), {
        "url": link_of(item["link"]), "guid": said(item["id"]), "title": said(item["title"]), "summary_html": said(item["summary"]), "content_html": said(item["content"]), "author": said(F.get(item["author"], F.lit(0))["name"]),
        "published_at": parse_date(F.coalesce(said(item["published"]), said(item["updated"])), offset_minutes), "updated_at": parse_date(item["updated"], offset_minutes),
    }).drop("_entry")
    return rss.unionByName(atom)


def parse_json_feed(feeds: DataFrame, offset_minutes: Column | int = 0) -> DataFrame:
    """Items of JSON Feed bodies; a missing title is the first 80 characters of the text."""
    item = F.col("_it")
    return _items(feeds, F.from_json("body", _JSON_FEED)["items"], {
        "url": F.coalesce(F.nullif(item["url"], F.lit("")), F.nullif(item["external_url"], F.lit(""))), "guid": F.nullif(item["id"], F.lit("")), "title": F.coalesce(said(item["title"]), F.nullif(item["content_text"].substr(1, 80), F.lit(""))),
        "summary_html": F.nullif(item["summary"], F.lit("")), "content_html": F.coalesce(F.nullif(item["content_html"], F.lit("")), F.nullif(item["content_text"], F.lit(""))),
        "author": F.coalesce(F.nullif(F.get(item["authors"], F.lit(0))["name"], F.lit("")), F.nullif(item["author"]["name"], F.lit(""))), "published_at": parse_date(item["date_published"], offset_minutes),
        "updated_at": parse_date(item["date_modified"], offset_minutes), "image_url": F.nullif(item["image"], F.lit("")),
    })


def parse_news_index(feeds: DataFrame) -> DataFrame:
    """Articles of a news index's answers, with domain and source_country."""
    item = F.col("_it")
    lang = F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.lower(F.coalesce(item["language"], F.lit(""))))
    seen = F.try_to_timestamp(F.when(item["seendate"].rlike(r"^\d{8}T\d{6}Z$"), F.translate(item["seendate"], "TZ", "")), F.lit("yyyyMMddHHmmss"))
    url = F.nullif(item["url"], F.lit(""))
    return _items(feeds, F.from_json("body", _INDEX)["articles"], {"url": url, "guid": url, "title": said(item["title"]), "published_at": seen, "image_url": F.nullif(item["socialimage"], F.lit("")), "lang": lang}, {"domain": item["domain"], "source_country": item["sourcecountry"]})


def escape(c: Column) -> Column:
    """Text for XML: what XML 1.0 forbids goes, markup signs become entities."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def render_rss(items: DataFrame, key: str) -> DataFrame:
    """key, body: one RSS body per key from rows with url, guid, title, summary_html and a sort column ``pos``. A feed is as long as its group, so group by something bounded."""
    one = F.concat(F.lit("<item><title>"), escape(F.col("title")), F.lit("</title><link>"), escape(F.col("url")), F.lit("</link><guid>"), escape(F.col("guid")), F.lit("</guid><description>"), escape(F.col("summary_html")), F.lit("</description></item>"))
    got = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("x")))).alias("rows"))
    return got.select(key, F.concat(F.lit('<rss version="2.0"><channel>'), F.array_join(F.transform("rows", lambda r: r["x"]), ""), F.lit("</channel></rss>")).alias("body"))


def render_json_feed(items: DataFrame, key: str) -> DataFrame:
    """key, body: one JSON Feed body per key, as ``render_rss``."""
    one = F.struct("pos", F.struct("url", F.col("guid").alias("id"), "title", F.col("summary_html").alias("summary")).alias("x"))
    got = items.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    return got.select(key, F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.transform("rows", lambda r: r["x"]).alias("items"))).alias("body"))
