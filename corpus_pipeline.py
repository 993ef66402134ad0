"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before it wrote and returns the columns of documents, but for the last, which
returns the packed pieces. Rows with null or repeated ids are rows like any other: each is judged by its own text. Null
and empty texts are never toxic beyond their base rate, are poor (fewer than ten words), and so end in the second stage;
given to a later one alone, they stay, are taken with 0 words, and pack as their separator. An empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import mixing, ngram_join, packing, quality_rules, toxicity
from lodestream.llm.common import checkpoint, only, written
from lodestream.llm.queries import PACK_TOKENIZER, table, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows pass through the scoring itself, so no text is shuffled. Labels are of ids; each row is judged by its text."""
    return toxicity.judge(docs, table(spark, sf_dir, "labels"), 0.3, carry=tuple(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are written once with their counts, and judged from there when their hosts' verdicts are known."""
    return quality_rules.judge(docs, carry=tuple(COLUMNS)).where("kept").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: shingles of five words, similarity 0.8.

    Rows get a key of their own, written so that it stands, since ids may be null or repeated.
    """
    rows = checkpoint(docs.select(*COLUMNS).withColumn("key", F.monotonically_increasing_id()))
    keyed = rows.select(F.col("key").alias("doc_id"), "text", F.col("doc_id").alias("id"))
    groups = written(ngram_join.join(keyed, k=5, num=80, den=100, carry=("id",)).select(F.col("doc_id").alias("key"), "id", "component_id"))
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    kept = written(first.select("first.key"))
    return only(rows, "key", kept, groups.join(kept, "key", "left_anti"), groups.count() - kept.count()).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer(PACK_TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("ngram_jaccard_join", drop_copies), ("mixing", mix_sources), ("best_fit_packing", pack_sequences)]

#: Classifier, tokenizer and packing cannot be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
