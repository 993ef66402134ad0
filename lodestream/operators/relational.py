"""Relational views of events with their articles, sources and families.

The shared tables stand in for the model: an order is an event, a line its article, a supplier the source and
its nation the family; customers are owners of events and their segments the categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def money(c: str) -> Column:
    """Exact sums of two decimals, shown as double."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def top_events(orders: DataFrame, lines: DataFrame, suppliers: DataFrame, limit: int = 50) -> DataFrame:
    """The limit comes first; only its events' children are then counted (semi-joined before they are aggregated)."""
    top = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(limit).select("o_orderkey", "o_totalprice")
    mine = lines.join(F.broadcast(top.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi").join(suppliers, lines.l_suppkey == suppliers.s_suppkey, "left")
    counts = mine.groupBy("l_orderkey").agg(
        F.count("*").alias("articles"), F.count_if(F.col("l_returnflag") == "A").alias("confirmed"), F.count_if(F.col("l_returnflag").isin("N")).alias("unverified"),
        F.count_if(F.col("l_returnflag") == "R").alias("disputed"), F.countDistinct(F.coalesce(F.col("s_nationkey").cast("string"), F.concat(F.lit("source:"), "l_suppkey"))).alias("families"),
    )
    out = top.join(counts, top.o_orderkey == counts.l_orderkey, "left")
    return out.select("o_orderkey", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("articles", "confirmed", "unverified", "disputed", "families")), F.greatest(F.lit(0), 6 - F.coalesce("families", F.lit(0))).alias("gaps"))


def source_trail(lines: DataFrame, suppliers: DataFrame, orders: DataFrame, per_event: int = 4) -> DataFrame:
    """Best line per (event, family), then the best ``per_event`` of each event."""
    rows = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(orders.where("o_orderpriority = '1-URGENT'"), lines.l_orderkey == orders.o_orderkey)
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    keys = [rank, F.col("l_shipdate").desc(), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")]
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("l_orderkey", "s_nationkey").orderBy(*keys))).where("k = 1")
    trail = best.withColumn("pos", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*keys))).where(F.col("pos") <= per_event)
    return trail.select("l_orderkey", "pos", "s_nationkey", "l_linenumber")


def gated(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers with at least one finished large order."""
    done = orders.where("o_orderstatus = 'F' AND o_totalprice > 200000")
    return customers.join(done, customers.c_custkey == done.o_custkey, "left_semi").select("c_custkey", "c_name")


def outdated(customers: DataFrame, orders: DataFrame, cutoff: str) -> DataFrame:
    """Customers without an order, or whose last one is before the cutoff or still open: one aggregate, one left join."""
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    j = customers.join(last, customers.c_custkey == last.o_custkey, "left")
    reason = F.when(F.col("last").isNull(), "missing").when(F.col("last") < F.to_timestamp_ntz(F.lit(cutoff)), "stale").when(F.col("status") == "O", "open")
    return j.select("c_custkey", reason.alias("reason")).where("reason IS NOT NULL")


def keyset_page(rows: DataFrame, key: str, before: int, size: int) -> DataFrame:
    """Rows under ``before``, newest first, with the key that continues (null on the last page)."""
    page = rows.where(F.col(key) < before).orderBy(F.desc(key)).limit(size + 1).withColumn("k", F.row_number().over(W.orderBy(F.desc(key))))
    more = F.max(F.when(F.col("k") == size + 1, 1)).over(W.partitionBy())
    last = F.min(F.when(F.col("k") <= size, F.col(key))).over(W.partitionBy())
    return page.withColumn("next_before", F.when(more == 1, last)).where(F.col("k") <= size).drop("k")


def latest_as_of(versions: DataFrame, heads: DataFrame, key: str, version: str, head: str, columns: list[str]) -> DataFrame:
    """Greatest version not after the head's, by a hash aggregate."""
    j = heads.join(versions, key).where(F.col(version) <= F.col(head))
    return j.groupBy(key).agg(F.max_by(F.struct(version, *columns), F.struct(version, *columns)).alias("v")).select(key, "v.*")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed or changed rows of two snapshots."""
    o, n = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    j = o.join(n, key, "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return j.select(key, kind.alias("change"), "old", "new").where("change IS NOT NULL")
