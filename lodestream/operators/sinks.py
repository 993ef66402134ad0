"""What a write leaves behind: inserts of what is absent, upserts, and versions of what changed.

Each takes the table as it is and the rows that come, and returns the rows to append or the table to write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_absent(table: DataFrame, coming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows to append: of each new key the first one by ``order``; a key that is null is never equal to another."""
    row = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in coming.columns if c not in order))
    new = coming.join(table.select(*key), key, "left_anti")
    some = new.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).groupBy(*key).agg(F.min(row).alias("r")).select("r.*")
    return some.select(*coming.columns).unionByName(new.where(" OR ".join(f"{k} IS NULL" for k in key)).select(*coming.columns))


def upsert(table: DataFrame, coming: DataFrame, key: str, order: list[str], kept: list[str]) -> DataFrame:
    """The table after an upsert: the last row that comes wins, but ``kept`` columns stay as they were."""
    last = coming.groupBy(key).agg(F.max(F.struct(*order, *(c for c in coming.columns if c not in order))).alias("r")).select("r.*")
    old = table.select(F.col(key), *(F.col(c).alias(f"old_{c}") for c in table.columns if c != key), F.lit(True).alias("was"))
    j = old.join(last, key, "full_outer").withColumn("comes", F.col(order[0]).isNotNull())
    columns = [c for c in table.columns if c != key]
    return j.select(key, *(F.when(F.col("was") & (F.lit(c in kept) | ~F.col("comes")), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def changed_versions(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, version (from 1), value and note of each row that differs from the one before it; equal ones leave no version."""
    w = W.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(value)).over(w)
    new = rows.withColumn("note", F.when(before.isNull(), "initial").when(~before[value].eqNullSafe(F.col(value)), "modified")).where("note IS NOT NULL")
    return new.select(key, F.row_number().over(w).alias("version"), value, "note")
