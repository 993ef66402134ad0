"""Feed parsers on hand-written bodies."""

from datetime import datetime

from pyspark.sql import functions as F

from lodestream.sources import feeds

RSS = """<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>x</title>
<item><title><![CDATA[A & B]]></title><link> http://a.org/1 </link><guid isPermaLink="false">g1</guid><description>d</description><content:encoded><![CDATA[<p>c</p>]]></content:encoded><dc:creator>Kim</dc:creator><pubDate>Mon, 27 Jul 2026 03:15:00 GMT</pubDate><enclosure url="http://a.org/p.jpg" type="image/jpeg"/></item>
<item><title>no link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="http://b.org/self"/><link href="http://b.org/1"/><id>i</id><author><name>Lee</name></author><updated>2026-07-27T05:00:00+02:00</updated></entry></feed>"""
JSON = '{"items": [{"id": "7", "url": "http://c.org/1", "content_text": "some text", "date_published": "2026-07-27 08:00:00"}, {"url": "http://c.org/2"}]}'
INDEX = '{"articles": [{"url": "http://d.org/1", "title": " N ", "seendate": "20260727T031500Z", "language": "Farsi", "domain": "d.org"}]}'


def rows(spark, body, parse, **how):
    return parse(spark.createDataFrame([(1, body), (2, "<broken"), (3, None)], "feed long, body string"), **how).collect()


def test_rss(spark):
    (r,) = rows(spark, RSS, feeds.parse_xml)
    assert (r.feed, r.url, r.guid, r.title, r.summary_html, r.content_html, r.author, r.image_url) == (1, "http://a.org/1", "g1", "A & B", "d", "<p>c</p>", "Kim", "http://a.org/p.jpg")
    assert r.published_at == datetime(2026, 7, 27, 3, 15)


def test_atom(spark):
    (r,) = rows(spark, ATOM, feeds.parse_xml)
    assert (r.url, r.guid, r.title, r.author, r.published_at, r.updated_at) == ("http://b.org/1", "i", "T", "Lee", datetime(2026, 7, 27, 3), datetime(2026, 7, 27, 3))


def test_json_feed(spark):
    (r,) = rows(spark, JSON, feeds.parse_json_feed, offset_minutes=480)
    assert (r.url, r.guid, r.title, r.content_html, r.published_at) == ("http://c.org/1", "7", "some text", "some text", datetime(2026, 7, 27))


def test_news_index(spark):
    (r,) = rows(spark, INDEX, feeds.parse_news_index)
    assert (r.url, r.title, r.lang, r.domain, r.published_at) == ("http://d.org/1", "N", "fa", "d.org", datetime(2026, 7, 27, 3, 15))


def test_offset(spark):
    got = spark.createDataFrame([("JP",), ("fr",), (None,)], "c string").select(feeds.utc_offset(F.col("c")).alias("o")).collect()
    assert [r.o for r in got] == [540, 0, 0]
