"""A stored full-text index that is maintained by document and searched by block.

Postings of a term lie in blocks of documents with neighbouring ids; a block's head says how often its term occurs at
most and how short its shortest document is, which bounds what any document in it can score. A search reads the heads of
its terms' buckets, scores the most promising blocks, and then only those whose bound reaches the score of the last place;
the result is that of scoring everything.

A document that is put again or deleted is not looked for in the postings: its new generation makes older postings void, and
what it counted for (documents with a term, documents, length) is taken back by a negative row. ``compact`` starts anew without them.
A null text is a document of length 0. Of rows that repeat a doc_id in one call the greatest text stands.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import shared_folder, spread, written
from .search import query_terms
from .store import Store

TABLES = {
    "postings": ("term string, block long, docs array<struct<doc_id: bigint, tf: int, dl: int>>, most_tf int, least_dl int", "term"),
    "terms": ("term string, df long", "term"),
    "docs": ("doc_id long, dl int, words array<string>, alive boolean", "doc_id"),
    "void": ("doc_id long", "doc_id"),
    "totals": ("n long, dl long", "n"),
}
SPAN = 4096
#: Tasks that write a bucket of postings, and the most repeated ids that are broadcast.
PARTS, BROADCAST_IDS = 16, 1_000_000


def counted(words: pa.Array) -> pa.Array:
    """The distinct words of each list and how often each occurs."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0), np.int64)
    codes = words.flatten().dictionary_encode()
    n = max(1, len(codes.dictionary))
    keys, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
    ends = np.searchsorted(keys // n, np.arange(len(sizes) + 1))
    found = pa.StructArray.from_arrays([codes.dictionary.take(pa.array(keys % n)), pa.array(tf.astype(np.int32))], names=["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found)


def _counted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pc.list_value_length(b.column(1)), counted(b.column(1))], names=["doc_id", "dl", "terms"])


def greatest(docs: DataFrame) -> DataFrame:
    """Of rows that repeat a doc_id the one with the greatest text. Repeated ids are sought first, so that texts without one are not shuffled."""
    again = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    n = again.count()
    if not n:
        return docs.select("doc_id", "text")
    if n > BROADCAST_IDS:
        return docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    few = F.broadcast(again)
    more = docs.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return docs.join(few, "doc_id", "left_anti").select("doc_id", "text").unionByName(more)


class Index:
    """``first``: blocks that are scored to learn how good the last place is."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64, span: int = SPAN, first: int = 16) -> None:
        self.store = Store(spark, path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", TABLES, buckets)
        self.span, self.first, self.seen = span, first, {}

    def _latest(self, ids: DataFrame) -> DataFrame:
        """The living row of each of these documents."""
        rows = self.store.read("docs", self.store.touched("docs", ids)).join(ids, "doc_id", "left_semi")
        last = rows.groupBy("doc_id").agg(F.max_by(F.struct("dl", "words", "alive"), "gen").alias("x"))
        return last.select("doc_id", "x.*").where("alive")

    def put(self, docs: DataFrame, deleted: DataFrame | None = None) -> int:
        """Insert or replace ``docs`` (doc_id, text) and remove the ids of ``deleted`` (doc_id); returns the generation."""
        s = self.store
        w = written(spread(greatest(docs.where("doc_id IS NOT NULL"))).select("doc_id", text.tokens(F.col("text")).alias("w")).mapInArrow(_counted_batches, "doc_id long, dl int, terms array<struct<term: string, tf: int>>"))
        row = w.select("doc_id", "dl", F.transform("terms", lambda x: x["term"]).alias("words"), F.lit(True).alias("alive"))
        if deleted is not None:
            gone = deleted.select("doc_id").distinct().join(w.select("doc_id"), "doc_id", "left_anti")
            row = row.unionByName(gone.select("doc_id", F.lit(0).alias("dl"), F.array().cast("array<string>").alias("words"), F.lit(False).alias("alive")))
        old = written(self._latest(row.select("doc_id")))
        tf = w.select("doc_id", "dl", F.inline("terms")).withColumns({"bucket": s.bucket("postings"), "block": F.floor(F.col("doc_id") / self.span)})  # a block holds ``span`` documents at most
        # postings are shuffled once, to the task that gathers and writes them; a bucket is several tasks, and so is a frequent term
        per = tf.withColumn("part", F.pmod(F.hash("term", "block"), F.lit(PARTS))).repartition("bucket", "part").groupBy("bucket", "part", "term", "block")
        s.write("postings", per.agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf", "dl"))).alias("docs"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl")), placed=True)
        changed = row.where("alive").select(F.explode("words").alias("term"), F.lit(1).alias("n")).unionByName(old.select(F.explode("words").alias("term"), F.lit(-1).alias("n")))
        s.write("terms", changed.groupBy("term").agg(F.sum("n").alias("df")).where("df <> 0"))
        s.write("docs", row, placed=True)
        s.write("void", old.select("doc_id"))
        sums = row.where("alive").select("dl", F.lit(1).alias("n")).unionByName(old.select((-F.col("dl")).alias("dl"), F.lit(-1).alias("n")))
        s.write("totals", sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")))
        return s.commit()

    def postings(self, terms: list[str]) -> DataFrame:
        """Committed postings of the terms, from their buckets alone."""
        keys = self.store.spark.createDataFrame([(t,) for t in terms], "term string")
        return self.store.read("postings", self.store.touched("postings", keys)).where(F.col("term").isin(terms))

    def _part(self, idf: Column, tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

    def search(self, question: str, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """doc_id and score of the best ``limit`` documents. ``seen`` then says how many blocks there were and how many were read."""
        s, terms = self.store, query_terms(question)
        none = s.spark.createDataFrame([], "doc_id long, score double")
        totals = s.read("totals").agg(F.sum("n"), F.sum("dl")).first()
        if not terms or not totals[0]:
            return none
        keys = s.spark.createDataFrame([(t,) for t in terms], "term string")
        df = {r.term: r.df for r in s.read("terms", s.touched("terms", keys)).where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        idf = {t: math.log(1 + (totals[0] - df[t] + 0.5) / (df[t] + 0.5)) for t in terms if df.get(t, 0) > 0}
        if not idf:
            return none
        avgdl = totals[1] / totals[0]
        weight = F.create_map(*(F.lit(x) for kv in idf.items() for x in kv))[F.col("term")]
        rows = self.postings(list(idf))
        best = self._part(weight, F.col("most_tf"), F.col("least_dl"), avgdl, k1, b)
        # generations of a term hold different documents, so the greatest bound holds for each of them
        bounds = written(rows.groupBy("block", "term").agg(F.max(best).alias("most")).groupBy("block").agg(F.sum("most").alias("bound")))
        void = s.read("void").groupBy("doc_id").agg(F.max("gen").alias("void"))

        def scored(blocks: DataFrame) -> DataFrame:
            hits = rows.join(blocks.select("block"), "block", "left_semi").select("term", "gen", F.inline("docs"))
            live = hits.join(void, "doc_id", "left").where("void IS NULL OR void <= gen")
            sums = live.groupBy("doc_id").agg(F.round(F.sum(self._part(weight, F.col("tf"), F.col("dl"), avgdl, k1, b)), 6).alias("score"))
            return sums.orderBy(F.desc("score"), "doc_id").limit(limit)

        lead = bounds.orderBy(F.desc("bound"), "block").limit(self.first)
        top = written(scored(lead))
        n, last = top.agg(F.count("*"), F.min("score")).first()
        more = bounds.join(lead.select("block"), "block", "left_anti")
        if n >= limit:
            more = more.where(F.col("bound") >= last - 1e-6)  # scores are rounded
        more = written(more)
        self.seen = {"blocks": bounds.count(), "read": min(self.first, bounds.count()) + more.count()}
        return top.unionByName(scored(more)).orderBy(F.desc("score"), "doc_id").limit(limit)

    def compact(self, path: str | None = None) -> Index:
        """The same index in a folder of its own, with one generation and nothing void."""
        s = self.store
        new = Index(s.spark, path, s.buckets, self.span, self.first)
        void = s.read("void").groupBy("doc_id").agg(F.max("gen").alias("void"))
        live = s.read("postings").select("term", "block", "gen", F.inline("docs")).join(void, "doc_id", "left").where("void IS NULL OR void <= gen")
        heads = live.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf", "dl"))).alias("docs"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))
        new.store.write("postings", heads)
        new.store.write("terms", s.read("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"))
        new.store.write("docs", s.read("docs").groupBy("doc_id").agg(F.max_by(F.struct("dl", "words", "alive"), "gen").alias("x")).select("doc_id", "x.*").where("alive"))
        new.store.write("totals", s.read("totals").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")))
        new.store.commit()
        return new
