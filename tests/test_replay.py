"""Recorded answers as a data source: filters reach the files, stream and batch agree, every adapter has its parser."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from lodestream.sources import replay

RSS = '<rss version="2.0"><channel><item><title>{t}</title><link>https://a.org/{t}</link></item></channel></rss>'
BODIES = {
    "rss": RSS.format(t="r"), "jsonfeed": json.dumps({"items": [{"url": "https://a.org/j", "title": "j"}]}), "gdelt": json.dumps({"articles": [{"url": "https://a.org/g", "title": "g"}]}),
    "mastodon": json.dumps([{"id": "1", "url": "https://m.org/1", "content": "<p>m</p>", "created_at": "2024-01-01T00:00:00.000Z", "account": {"acct": "a"}}]),
    "bluesky": json.dumps({"feed": [{"post": {"uri": "at://x/app/1", "author": {"handle": "h"}, "record": {"text": "b", "createdAt": "2024-01-01T00:00:00Z"}}}]}),
    "telegramweb": '<div class="tgme_widget_message" data-post="ch/5"><div class="tgme_widget_message_text">t</div></div>',
}


def answers(spark, *rows):
    made = [(source, adapter, query, datetime.fromtimestamp(at, timezone.utc), body, 0) for source, adapter, query, at, body in rows]
    return spark.createDataFrame(made, replay.SCHEMA)


def test_every_adapter_is_dispatched(spark, tmp_path):
    replay.register(spark)
    replay.record(answers(spark, *[(a, a, "https://m.org" if a == "mastodon" else "ch", 0, b) for a, b in BODIES.items()], ("x", "rss", None, 0, "broken <"), ("y", "jsonfeed", None, 0, None)), str(tmp_path / "a"))
    got = replay.dispatch(spark.read.format("feed_answers").load(str(tmp_path / "a"))).collect()
    assert sorted(r.source_id for r in got) == sorted(BODIES) and all(r.url and (r.title or r.content_html or r.summary_html) for r in got), got


def test_filters_reach_the_files(spark, tmp_path):
    replay.register(spark)
    path = str(tmp_path / "a")
    rows = [(f"s{i}", ["rss", "gdelt"][i % 2], "q" if i < 4 else None, 60 * i, RSS.format(t=i)) for i in range(10)]
    replay.record(answers(spark, *rows[:5]), path)
    replay.record(answers(spark, *rows[5:]), path)
    read = spark.read.format("feed_answers").load(path)
    assert sorted(r.source_id for r in read.collect()) == [f"s{i}" for i in range(10)]
    late = read.where((F.col("adapter") == "rss") & (F.col("fetched_at") >= F.timestamp_seconds(F.lit(240))) & F.col("source_id").isin("s2", "s4", "s8"))
    assert sorted(r.source_id for r in late.collect()) == ["s4", "s8"]
    assert [r.source_id for r in read.where("query = 'q' AND source_id LIKE '%3%'").collect()] == ["s3"]
    assert read.where("adapter = 'nobody'").count() == 0
    # what is pushed is neither returned to Spark nor read: adapters by directory, the rest by the file's rows
    reader = replay.AnswersReader(path)
    like = StringContains(("source_id",), "3")
    assert list(reader.pushFilters([EqualTo(("adapter",), "rss"), In(("source_id",), ("s0", "s2")), GreaterThan(("fetched_at",), datetime.fromtimestamp(60, timezone.utc)), like])) == [like]
    parts = reader.partitions()
    assert parts and all("adapter=rss" in p.value for p in parts) and sum(b.num_rows for p in parts for b in reader.read(p)) == 1


def test_stream_takes_what_is_added(spark, tmp_path):
    replay.register(spark)
    path, seen = str(tmp_path / "a"), []
    for turn in range(3):
        replay.record(answers(spark, *[(f"s{turn}{i}", "rss", None, i, RSS.format(t=i)) for i in range(turn + 1)]), path)
        items = replay.dispatch(spark.readStream.format("feed_answers").load(path))
        items.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert seen == [1, 3, 6]
    batch = replay.dispatch(spark.read.format("feed_answers").load(path))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*batch.columns).collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_an_unfinished_generation_is_not_read(spark, tmp_path):
    path = str(tmp_path / "a")
    assert replay.generations(path) == []
    replay.record(answers(spark, ("s", "rss", None, 0, "")), path)
    (tmp_path / "a" / "000000009-x").mkdir()
    assert len(replay.generations(path)) == 1


def test_sources_that_cannot_be_asked(spark):
    df = spark.createDataFrame([("a", "rss", "https://a", None), ("b", "jsonfeed", " ", None), ("c", "gdelt", None, None), ("d", "gdelt", None, "q"), ("e", "ftp", None, None), ("f", None, None, None)], "source_id string, adapter string, feed_url string, query string")
    assert {r.source_id: r.problem for r in replay.problems(df).collect()} == {"b": "no feed_url", "c": "no query", "e": "unknown adapter", "f": "unknown adapter"}
    assert spark.range(1).select(replay.expanded(F.lit("{RSSHUB}/x"), "https://hub")).first()[0] == "https://hub/x"
