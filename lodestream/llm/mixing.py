"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source; targets follow the weights and stop at ``cap`` times a source's size, the
excess being reshared by weight until none is above. The repetition rate of a source is target / size;
every document comes floor(rate) times plus once more when a hash of its id and the seed, read as a number
in [0, 1), lies below the fraction. So that a source of few documents also meets its target, the hashes of a
source are turned on the circle by one of ``TURNS`` equal steps, which keeps every document's probability; all sums are
taken in one aggregate, and the step whose words come nearest to the target is used (the first of equals).

Defined cases: null or empty texts have size 0 and are taken with 0 words; a null source is a source of
its own, ordered last; a source without words has target 0 and rate 0; repeated rows draw alike; an empty
table gives an empty result; only doc_id, text and source are read. Sources are numbered and levelled in one task, so
there may be a million of them, not more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, WORD, written

WEIGHTS = (5, 2, 1)
TURNS = 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, doc_id: Column) -> Column:
    """A number in [0, 1) from 48 bits of the MD5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(2**48)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """source, source_size, target, rate from rows of (source, size): one row per source.

    Resharing by weight until none exceeds its cap has the closed form target = min(cap * size, level *
    weight). Sources are taken in the order of cap / weight; the level is the first that leaves the next
    source below its cap. Only the table of sources passes the two global windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (k + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by = W.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", F.struct(F.row_number().over(by).alias("at"), level.alias("level")))
    fits = F.when(F.col("level.level") * F.col("weight") <= F.col("most"), F.col("level"))
    per = per.withColumn("level", F.min(fits).over(every)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return per.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def again(rate: Column, u: Column, turn: Column | float) -> Column:
    """Whether a document whose hash is ``u`` comes once more."""
    turned = u + turn
    return turned - F.floor(turned) < rate - F.floor(rate)


def plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = 3.0, seed: str = "mix", carry: tuple = ()) -> DataFrame:
    """Every document with size, source_size, target and the number of its copies in the mix, and the columns of ``carry`` as the struct row."""
    more = (F.struct(*carry).alias("row"),) * bool(carry)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), *more)
    small = written(sized.select("doc_id", "source", "size"))  # texts are counted once for all sums
    targets = written(source_targets(small, weights, cap))
    n = targets.count()

    def beside(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if n <= BROADCAST_IDS // 10 else t

    t = targets.withColumnRenamed("source", "of")
    rate, u = F.col("rate"), draw(seed, F.col("doc_id"))
    drawn = small.join(beside(t), F.col("source").eqNullSafe(F.col("of"))).withColumn("u", u)
    sums = [F.coalesce(F.sum(F.when(again(rate, F.col("u"), k / TURNS), F.col("size"))), F.lit(0)) for k in range(TURNS)]
    taken = drawn.groupBy("of", "source_size", "target", "rate").agg(F.array(*sums).alias("more"))
    off = F.transform("more", lambda x, k: F.struct(F.abs(x + F.col("source_size") * F.floor(rate) - F.col("target")).alias("off"), k.alias("k")))
    turns = written(taken.select("of", "source_size", "target", "rate", (F.array_min(off)["k"] / TURNS).alias("turn")))
    rows = sized if carry else small  # rows of their own texts, or the counts
    copies = F.floor(rate) + F.when(again(rate, u, F.col("turn")), 1).otherwise(0)
    return rows.join(beside(turns), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), *("row",) * bool(carry))


def mix(docs: DataFrame, columns: list[str], **how) -> DataFrame:
    """The mixed rows themselves, with ``columns`` of docs; a document comes once per copy."""
    got = plan(docs, carry=tuple(columns), **how).where("copies > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
