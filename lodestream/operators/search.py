"""Full-text retrieval over an inverted index, question ranking and term containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import spread, written


def query_terms(question: str, most: int = 16) -> list[str]:
    """Distinct words of a Latin question."""
    return list(dict.fromkeys(w for w in question.lower().split() if len(w) > 1 or w.isdigit()))[:most]


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf); the index is this table."""
    words = docs.where("text IS NOT NULL").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, question: str, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id and score of the best ``limit`` documents; only the question's terms are exploded."""
    terms = query_terms(question)

    words = spread(docs.select("doc_id", "text")).select("doc_id", F.coalesce(text.tokens(F.col("text")), F.array().cast("array<string>")).alias("w"))
    hits = words.select("doc_id", F.size("w").alias("dl"), F.explode_outer(F.filter("w", lambda x: x.isin(terms))).alias("term"))
    tf = written(hits.groupBy("doc_id", "dl").agg(*(F.count_if(F.col("term") == q).alias(f"tf{i}") for i, q in enumerate(terms))))  # for the statistics and the scores: texts are tokenised once
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return F.when(F.col(f"tf{i}") > 0, idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    any_hit = sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    score = F.round(sum((part(i) for i in range(len(terms))), F.lit(0.0)), 6)
    return tf.where(any_hit).crossJoin(F.broadcast(stats)).select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)  # one row of statistics


def relevance(words: Column, terms: list[str]) -> Column:
    """Share of the question's terms that occur."""
    return F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) / float(len(terms))


def rank_for_question(docs: DataFrame, question: str, limit: int) -> DataFrame:
    """5 * title + 2 * excerpt + 3 * best sentence; the first 80 and 280 characters stand for title and excerpt."""
    terms = query_terms(question)
    sentences = F.transform(F.regexp_extract_all("text", F.lit(r"([^.!?\n]+[.!?]?)"), F.lit(1)), F.trim)
    sentences = F.slice(F.filter(sentences, lambda s: (F.length(s) >= 12) & (F.length(s) <= 500)), 1, 80)
    best = F.array_max(F.transform(sentences, lambda s: relevance(text.tokens(s), terms)))
    score = 5 * relevance(text.tokens(F.col("text").substr(1, 80)), terms) + 2 * relevance(text.tokens(F.col("text").substr(1, 280)), terms) + 3 * F.coalesce(best, F.lit(0.0))
    return docs.where("text IS NOT NULL").select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def all_terms(rows: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows whose text holds every term."""
    return rows.where(F.forall(F.array(*map(F.lit, terms)), lambda x: F.contains(F.col(column), x)))


def watchlist(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, term) for every term of a fixed list that a document contains, case folded; no join is needed."""
    low = F.lower("text")
    hits = F.filter(F.array(*map(F.lit, terms)), lambda x: F.contains(F.col("low"), x))
    return docs.where("text IS NOT NULL").select("doc_id", low.alias("low")).select("doc_id", F.explode(hits).alias("term"))
