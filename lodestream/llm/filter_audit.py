"""Audit of how five quality filters interact, for every order in which they could run.

A text's failures are one five-bit mask, made by native expressions. What any order of the filters keeps, removes or
finds removed already follows from the number of rows that bear each mask, so rows are counted once into 32 cells a part;
all orders and steps are read off those cells. No row is looked at again for another order.

Defined cases: a null text is empty; a text without words fails A and neither B nor C; equal texts are found by
SHA-256, and only the rows of the smallest doc_id (all of them, if it repeats) are no copies; a null doc_id is neither a
copy nor what others copy, and has no label; a null source and an empty one are one part; a document is good or toxic if any of
its label rows says so; an empty table has no parts and so no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Filters by letter; the bit of a filter in a mask is its place here.
LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
ORDERS = ["".join(p) for p in permutations(LETTERS)]
SPACE = r"[\x20\x09-\x0D]+"


def bits(letters: str) -> int:
    return sum(1 << LETTERS.index(x) for x in letters)


def failures(text: Column) -> dict[str, Column]:
    """A to D, which a text decides alone: few words, few different words, many capitals, marks."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = sum((f.cast("int") * bits(x) for x, f in failures(F.col("text")).items()), F.lit(0))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = written(known.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")))  # texts are read once
    # a group of copies is summed before the shuffle, and its rows look for their group by (digest, doc_id), so none meet
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    yes = [F.coalesce(c, F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")]
    return rows.join(first, ["digest", "doc_id"], "left").join(said, "doc_id", "left").select("part", (F.col("own") + copy.cast("int") * bits("E")).alias("mask"), *yes)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    cells = masks(docs, labels).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # 32 cells of a part side by side: three arrays, whose place is the mask
    held = cells.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(MASKS))).alias(c) for c in ("n", "good", "toxic")))
    steps = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bits(x)).alias("bit"), F.lit(bits(o[:k])).alias("before")) for o in ORDERS for k, x in enumerate(o)))
    by_step = held.select("part", "n", "good", "toxic", F.inline(steps))
    bit, before = F.col("bit"), F.col("before")

    def total(counts: str, holds) -> Column:
        """Sum of ``counts`` over the masks for which ``holds`` is true."""
        picked = F.transform(F.col(counts), lambda n, m: F.when(holds(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, b: a + b)

    def removed(m: Column) -> Column:
        return (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)

    # of the orders, a filter is the first of the k filters that a row fails in one of k
    turns = F.aggregate(F.transform(F.col("n"), lambda n, m: F.when(m.bitwiseAND(bit) != 0, n * F.expr(f"{len(ORDERS)}L") / F.bit_count(m)).otherwise(0.0).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return by_step.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        turns.alias("shapley"),
    )
