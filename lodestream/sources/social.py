"""Posts of social accounts and channel previews to items, and outlines of feed lists both ways.

As in ``feeds``, every parser takes fetched bodies, one a row, and keeps the other columns. A post has no title of its
own: its title is empty, and the first line of its text takes its place when it is stored. Bodies that do not parse
have no items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html
from .feeds import _items, escape, parse_date, said

_STATUS = "array<struct<id: string, url: string, uri: string, content: string, created_at: string, account: struct<acct: string>, media_attachments: array<struct<preview_url: string>>>>"
_POSTS = "feed array<struct<reason: string, post: struct<uri: string, author: struct<handle: string>, record: struct<text: string, createdAt: string>, embed: struct<images: array<struct<thumb: string>>>>>>"
#: Marks of a channel preview's messages.
MESSAGE = r'class="tgme_widget_message\b'
MESSAGE_POST = 'data-post="([^"]+)"'
MESSAGE_TEXT = r'class="tgme_widget_message_text[^"]*"[^>]*>([\s\S]*?)</div>'
MESSAGE_TIME = '<time[^>]+datetime="([^"]+)"'
MESSAGE_PHOTO = r"""class="tgme_widget_message_photo_wrap[^"]*"[^>]*style="[^"]*background-image:url\('([^']+)'\)"""
MOST_MESSAGES = 40

_ATTRIBUTE = r"""\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""


def _full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_statuses(feeds: DataFrame, instance: str = "instance") -> DataFrame:
    """Statuses of a federated account; ``instance`` names the column with the server's address."""
    item = F.col("_it")
    url = F.coalesce(_full(item["url"]), _full(item["uri"]))
    host = F.lower(F.regexp_extract(instance, r"^[a-zA-Z]+://([^/?#:]+)", 1))
    acct = _full(item["account"]["acct"])
    body = _full(item["content"])
    got = _items(feeds, F.from_json("body", _STATUS), {
        "url": url, "guid": F.coalesce(_full(item["id"]), url), "title": F.lit(""), "summary_html": body, "content_html": body, "author": F.concat(F.lit("@"), acct, F.lit("@"), host),
        "published_at": parse_date(item["created_at"]), "image_url": _full(F.get(item["media_attachments"], F.lit(0))["preview_url"]),
    })
    return got.where("content_html IS NOT NULL")


def parse_posts(feeds: DataFrame, actor: str = "actor") -> DataFrame:
    """Posts of an author's feed without what the author only passes on; ``actor`` names the column with the account asked for."""
    item = F.col("_it")
    post = item["post"]
    handle = F.coalesce(_full(post["author"]["handle"]), F.col(actor))
    key = _full(F.element_at(F.split(post["uri"], "/"), -1))
    mine = F.filter(F.from_json("body", _POSTS)["feed"], lambda x: x["reason"].isNull())
    got = _items(feeds, mine, {
        "url": F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), key), "guid": post["uri"], "title": F.lit(""), "content_html": _full(post["record"]["text"]), "author": F.concat(F.lit("@"), handle),
        "published_at": parse_date(post["record"]["createdAt"]), "image_url": _full(F.get(post["embed"]["images"], F.lit(0))["thumb"]),
    })
    return got.where("content_html IS NOT NULL")


def parse_preview(feeds: DataFrame, channel: str = "channel") -> DataFrame:
    """Messages of a channel's preview page, the first 40 of it; ``channel`` names the column with the channel."""
    item = F.col("_it")
    blocks = F.slice(F.split("body", MESSAGE), 2, MOST_MESSAGES)
    post = _full(F.regexp_extract(item, MESSAGE_POST, 1))
    number = _full(F.get(F.split(post, "/"), F.lit(1)))
    body, photo = (_full(F.regexp_extract(item, p, 1)) for p in (MESSAGE_TEXT, MESSAGE_PHOTO))
    got = _items(feeds, blocks, {
        "url": F.concat(F.lit("https://t.me/"), F.col(channel), F.lit("/"), number), "guid": post, "title": F.lit(""), "summary_html": body, "content_html": body,
        "published_at": parse_date(F.regexp_extract(item, MESSAGE_TIME, 1)), "image_url": photo,
    })
    return got.where("content_html IS NOT NULL OR image_url IS NOT NULL")


def parse_outlines(lists: DataFrame) -> DataFrame:
    """pos, title, xml_url and html_url of the outlines of an OPML body that name a feed, at any depth, in document order."""
    body = F.regexp_replace(F.regexp_extract("body", r"(?s)<body\b.*", 0), r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(body, F.lit(rf"<outline((?:{_ATTRIBUTE})*)\s*/?>"), F.lit(1))

    def attribute(*names: str) -> Column:
        found = [F.regexp_extract("_tag", rf"""\s(?:{n})\s*=\s*(?:"([^"]*)"|'([^']*)')""", k) for n in names for k in (1, 2)]
        return html.decode_entities(F.coalesce(*(_full(f) for f in found)))

    others = [c for c in lists.columns if c != "body"]
    tagged = lists.select(*others, F.posexplode(tags).alias("pos", "_tag"))
    got = tagged.select(*others, "pos", F.coalesce(attribute("title", "text"), attribute("xmlUrl", "xmlurl")).alias("title"), attribute("xmlUrl", "xmlurl").alias("xml_url"), attribute("htmlUrl").alias("html_url"))
    return got.where("xml_url IS NOT NULL")


def render_outlines(entries: DataFrame, key: str, title: str) -> DataFrame:
    """key, body: one OPML list per key from rows with pos, title, xml_url and html_url; a list is as long as its group."""
    name = escape(F.col("title"))
    page = F.when(said(F.col("html_url")).isNull(), "").otherwise(F.concat(F.lit(' htmlUrl="'), escape(F.col("html_url")), F.lit('"')))
    one = F.concat(F.lit('<outline type="rss" text="'), name, F.lit('" title="'), name, F.lit('" xmlUrl="'), escape(F.col("xml_url")), F.lit('"'), page, F.lit("/>"))
    got = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("x")))).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda r: r["x"]), "\n")
    return got.select(key, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0"><head><title>'), escape(F.lit(title)), F.lit("</title></head><body>\n"), lines, F.lit("\n</body></opml>\n")).alias("body"))
