"""Answers to a question from reports: ranked reports, their best sentences, numbered sources and what limits the answer.

The reports are those a search has found, bounded by its limit, after the filters of desk.ask_filters; the answer is
put together from at most ``most`` of them. Nothing is generated: sentences are quoted with their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

#: Weights of title, excerpt and best sentence, of verified and of original reports; lengths of sentences.
TITLE, EXCERPT, SENTENCE, VERIFIED, ORIGINAL = 5, 2, 3, 0.35, 0.05
SHORTEST, LONGEST, SENTENCES = 12, 500, 60
END = "。！？!?"
#: Words of an answer in English.
WORDS = {"said": "According to ", "lead": "As of {}, the available reporting indicates: ", "nothing": "As of {}, the selected sources do not contain enough information to answer this question.", "cutoff": "Material up to {}.", "filter": "Filter: {}.", "few": "Nothing in the selection supports a clear answer.", "quoted": "Quoted from reports; what a source states is not thereby confirmed."}


def terms(s: Column) -> Column:
    return F.array_distinct(F.filter(text.tokens(s), lambda w: (F.length(w) > 1) | w.rlike("[0-9]")))


def relevance(question: str, s: Column) -> Column:
    """Share of the question's terms that occur; 0 for a question without terms."""
    asked = terms(F.lit(question))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, terms(F.coalesce(s, F.lit(""))))) / F.size(asked))


def sentences(body: Column) -> Column:
    """Sentences that end with a mark or with the text, of SHORTEST letters at least, long ones cut, the first SENTENCES of them."""
    raw = F.regexp_extract_all(F.trim(F.coalesce(body, F.lit(""))), F.lit(rf"([^{END}\n.]+(?:[{END}.]+|\z))"), F.lit(1))
    lines = F.filter(F.transform(raw, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) >= SHORTEST)
    return F.slice(F.transform(lines, lambda s: F.when(F.length(s) > LONGEST, F.concat(F.substring(s, 1, LONGEST - 1), F.lit("…"))).otherwise(s)), 1, SENTENCES)


def ranked(articles: DataFrame, question: str) -> DataFrame:
    """``articles`` with score and best_sentence. articles: article_id, title, excerpt, body, at, source, event_id, cross_verified, families, reprint.

    A sentence is taken over excerpt or title only if it is more relevant, and the first of equals.
    """
    title, excerpt = F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit(""))
    start = F.when(excerpt != "", excerpt).otherwise(title)
    offers = F.concat(F.array(start), sentences(F.col("body")))
    best = F.array_max(F.transform(offers, lambda s, i: F.struct(relevance(question, s).alias("r"), (-i).alias("first"), s.alias("s"))))
    x = articles.withColumn("_best", best)
    more = F.when(F.coalesce("cross_verified", F.lit(False)) | (F.coalesce("families", F.lit(0)) >= 2), VERIFIED).otherwise(0.0) + F.when(F.coalesce("reprint", F.lit(False)), 0.0).otherwise(ORIGINAL)
    score = TITLE * relevance(question, title) + EXCERPT * relevance(question, excerpt) + SENTENCE * F.col("_best.r") + more
    return x.withColumns({"score": F.round(score, 6), "best_sentence": F.when(F.col("_best.s") != "", F.col("_best.s")).otherwise(title)}).drop("_best")


def answer(articles: DataFrame, question: str, cutoff: str, filters: tuple[str, ...] = (), most: int = 6, quoted: int = 5, words: dict[str, str] = WORDS) -> DataFrame:
    """One row: answer, citations (numbered lines), caveats and related events."""
    order = W.orderBy(F.desc("score"), F.desc_nulls_last("at"), "article_id")  # of what a search found
    top = ranked(articles, question).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    kept = top.withColumn("best", F.max("score").over(W.partitionBy())).where((F.col("score") > 0) | ((F.col("best") <= 0) & (F.col("place") <= 3)))
    cited = kept.withColumn("number", F.row_number().over(W.orderBy("place")))
    said = F.concat(F.lit(words["said"]), F.coalesce("source", F.lit("")), F.lit(", "), F.trim(F.regexp_replace(F.regexp_replace("best_sentence", "<[^>]*>", " "), r"\s+", " ")))
    once = cited.withColumn("said", said).withColumn("turn", F.row_number().over(W.partitionBy(F.lower("said")).orderBy("place")))
    line = F.when(F.col("turn") == 1, F.struct("place", F.concat("said", F.lit(" ["), F.col("number").cast("string"), F.lit("]")).alias("x")))
    source = F.struct("number", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("source", F.lit(""))).alias("x"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda r: r["x"])
    row = once.agg(F.slice(ordered(line), 1, quoted).alias("lines"), ordered(source).alias("citations"), F.array_sort(F.collect_set("event_id")).alias("related"))
    text_ = F.when(F.size("lines") > 0, F.concat(F.lit(words["lead"].format(cutoff)), F.array_join("lines", " "))).otherwise(words["nothing"].format(cutoff))
    notes = [words["cutoff"].format(cutoff), *(words["filter"].format(f) for f in filters)]
    caveats = F.concat(F.array(*map(F.lit, notes)), F.when(F.size("lines") == 0, F.array(F.lit(words["few"]))).otherwise(F.array().cast("array<string>")), F.array(F.lit(words["quoted"])))
    return row.select(text_.alias("answer"), "citations", caveats.alias("caveats"), "related")
