"""Recorded answers of feeds as a data source of their own: partitions by file, filters pushed to the files, and a stream of what is added.

``record`` adds answers to a folder, a generation each time and a directory for each adapter; ``spark.read.format("feed_answers")``
reads them. Conditions on adapter, source_id, query and fetched_at are pushed down: adapters choose directories, the
others are applied while a file is read, so that rows they refuse never reach Spark. A stream's offset is the number of
generations taken. ``dispatch`` turns answers into items by the parser of their adapter.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import feeds, social

SCHEMA = "source_id string, adapter string, query string, fetched_at timestamp, body string, offset_minutes int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ADAPTERS = ("rss", "jsonfeed", "gdelt", "mastodon", "bluesky", "telegramweb")
#: Fixed value: what stands for the address of a bridge in an address.
BRIDGE = "{RSSHUB}"
COMPARED = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


def record(answers: DataFrame, path: str) -> None:
    """Add answers (COLUMNS) as the next generation. Names of generations grow with time, so that a stream takes them in order."""
    n = len(generations(path))
    made = answers.select(*COLUMNS)
    made.write.mode("overwrite").partitionBy("adapter").parquet(f"{path}/{n:09d}-{uuid.uuid4().hex[:8]}")


def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def generations(path: str) -> list[str]:
    """Finished generations in the order in which they were recorded."""
    fs, at = _files(path)
    found = fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True))
    return sorted(x.path for x in found if x.type == pa.fs.FileType.Directory and fs.get_file_info(posixpath.join(x.path, "_SUCCESS")).type == pa.fs.FileType.File)


def plain(value):
    """Times as files hold them, in UTC."""
    return value.astimezone(timezone.utc).replace(tzinfo=None) if isinstance(value, datetime) else value


class File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class Answers:
    """What a batch and a stream have in common."""

    def __init__(self, path: str) -> None:
        self.path, self.conditions, self.adapters = path, [], set(ADAPTERS)

    def files(self, folders: Iterable[str]) -> list[File]:
        fs, _ = _files(self.path)
        out = []
        for folder in folders:
            for x in fs.get_file_info(pa.fs.FileSelector(folder, recursive=True)):
                adapter = posixpath.basename(posixpath.dirname(x.path)).removeprefix("adapter=")
                if x.path.endswith(".parquet") and adapter in self.adapters:
                    out.append(File(x.path))
        return sorted(out, key=lambda f: f.value)

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what a source without files is asked for
            return
        fs, _ = _files(self.path)
        adapter = posixpath.basename(posixpath.dirname(partition.value)).removeprefix("adapter=")
        wanted = None
        for name, compare, value in self.conditions:
            c = ds.field(name).isin(value) if compare == "isin" else getattr(ds.field(name), compare)(value)
            wanted = c if wanted is None else wanted & c
        for b in ds.dataset(partition.value, filesystem=fs, format="parquet").to_batches(columns=[c for c in COLUMNS if c != "adapter"], filter=wanted, batch_size=1024):
            columns = dict(zip(b.schema.names, b.columns, strict=True)) | {"adapter": pa.array([adapter] * b.num_rows, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c].cast(pa.timestamp("us", "UTC")) if c == "fetched_at" else columns[c] for c in COLUMNS], COLUMNS)


class AnswersReader(Answers, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "adapter" and isinstance(f, EqualTo | In):
                self.adapters &= set(f.value if isinstance(f, In) else [f.value])
            elif name in ("source_id", "query", "fetched_at") and isinstance(f, In):
                self.conditions.append((name, "isin", [plain(v) for v in f.value]))
            elif name in ("source_id", "query", "fetched_at") and type(f) in COMPARED:
                self.conditions.append((name, COMPARED[type(f)], plain(f.value)))
            else:
                yield f

    def partitions(self) -> list[File]:
        return self.files(generations(self.path))


class AnswersStream(Answers, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"taken": 0}

    def latestOffset(self) -> dict:
        return {"taken": len(generations(self.path))}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return self.files(generations(self.path)[start["taken"] : end["taken"]])

    def commit(self, end: dict) -> None:
        """Nothing to do: what was recorded stays."""


class FeedAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnswersReader:
        return AnswersReader(self.options["path"])

    def streamReader(self, schema) -> AnswersStream:
        return AnswersStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedAnswers)


def expanded(url: Column, bridge: str) -> Column:
    """An address with the bridge's own in place of its mark."""
    return F.replace(url, F.lit(BRIDGE), F.lit(bridge))


def problems(sources: DataFrame) -> DataFrame:
    """(source_id, problem) of sources (source_id, adapter, feed_url, query) that cannot be asked."""
    feed, lacks = F.col("adapter").isin("rss", "jsonfeed"), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    said = F.when(feed & lacks("feed_url"), "no feed_url").when((F.col("adapter") == "gdelt") & lacks("query"), "no query").when(~F.coalesce(F.col("adapter").isin(*ADAPTERS), F.lit(False)), "unknown adapter")
    return sources.select("source_id", said.alias("problem")).where("problem IS NOT NULL")


def dispatch(answers: DataFrame) -> DataFrame:
    """source_id, adapter and the columns of feeds.ITEM of every item in the answers, each read by its adapter's parser. Answers are scanned once for each parser."""
    a = answers.select("source_id", "adapter", "query", "body", "offset_minutes")
    # scans of one loaded source share what was pushed to it last, so this condition is one that is not pushed
    of = lambda *names: a.where(F.array_contains(F.array(*map(F.lit, names)), F.col("adapter")))
    offset = F.coalesce("offset_minutes", F.lit(0))
    parsed = [
        feeds.parse_xml(of("rss"), offset), feeds.parse_json_feed(of("jsonfeed"), offset), feeds.parse_news_index(of("gdelt")),
        social.parse_statuses(of("mastodon").withColumn("instance", F.col("query"))), social.parse_posts(of("bluesky").withColumn("actor", F.col("query"))), social.parse_preview(of("telegramweb").withColumn("channel", F.col("query"))),
    ]
    out = None
    for p in parsed:
        row = p.select("source_id", "adapter", *((F.col(c) if c in p.columns else F.lit(None)).cast("timestamp" if c in ("published_at", "updated_at") else "string").alias(c) for c in feeds.ITEM))
        out = row if out is None else out.unionByName(row)
    return out
