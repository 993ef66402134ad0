"""Aggregates per key that follow changes of their rows and of what the rows are joined with, without being made anew.

A row counts for its key through facts (measure, value), such as (family, f3) or (last, 2024-01-02). What is kept of a key is how often
each fact holds, so a change is a few facts with a sign: those of the new row once more, those of the stored row once
less. Counts, distinct counts, least and greatest values and histograms are all read off the facts that still
hold, so deletions need nothing else. Rows are kept by id to know what they counted for, and ids by the dimension they
are joined with, so that a changed dimension finds its rows. Only buckets of touched ids, dimensions and keys are
read; ``seen`` says how many rows that were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, written
from .store import Store, names

FACT = "array<struct<measure: string, value: string>>"


class Maintained:
    """``row``: columns of a row (row_id, key, dim and more) as a schema; ``dimension``: schema of the joined table, which begins with dim; ``facts``: array of (measure, value) of a joined row; ``summary``: aggregates over the facts of a key (measure, value, n)."""

    def __init__(self, spark: SparkSession, row: str, dimension: str, facts: Callable[[], Column], summary: list[Column], path: str | None = None, buckets: int = 64) -> None:
        self.row, self.dimension, self.facts, self.summary = row, dimension, facts, summary
        self.seen: dict[str, int] = {}
        tables = {
            "rows": (f"{row}, facts {FACT}, alive boolean", "row_id"), "links": ("dim long, row_id long", "dim"), "dims": (dimension, "dim"),
            "states": ("key long, measure string, value string, n long", "key"),
        }
        self.store = Store(spark, path or f"{shared_folder(spark)}/maintained-{uuid.uuid4().hex}", tables, buckets)

    def _of(self, name: str, keys: DataFrame) -> DataFrame:
        """Stored rows of these keys; how many rows their buckets held is seen."""
        key = self.store.tables[name][1]
        buckets = self.store.touched(name, keys)
        rows = self.store.read(name, buckets)
        if not buckets:
            return rows
        found = written(rows.join(keys.select(key).distinct(), key, "left_semi"))
        self.seen[name] = self.seen.get(name, 0) + rows.count()  # by the files' footers; an observation is lost where adaptive execution drops its side of the join
        return found

    @staticmethod
    def _last(rows: DataFrame, key: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in (key, "gen", "bucket")]
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "gen").alias("x")).select(key, "x.*")

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None, dimensions: DataFrame | None = None) -> DataFrame:
        """Take over changed rows, deleted row_ids and changed dimensions, one row an id each; the summaries of the keys they touch."""
        s, self.seen = self.store, {}
        columns = names(self.row)
        put = s.spark.createDataFrame([], self.row) if changed is None else changed.select(*columns)
        gone = s.spark.createDataFrame([], "row_id long") if deleted is None else deleted.select("row_id").distinct()
        dims = s.spark.createDataFrame([], self.dimension) if dimensions is None else dimensions.select(*names(self.dimension))
        put, dims = written(put), written(dims)
        # rows that a changed dimension reaches are changed rows too
        reached = self._of("links", dims.select("dim")).select("row_id").distinct()
        ids = written(put.select("row_id").unionByName(gone).unionByName(reached).distinct())
        old = self._last(self._of("rows", ids), "row_id").where("alive")
        # a link may be older than the row's present dimension: such a row is not touched
        told = put.select("row_id").unionByName(gone).distinct().withColumn("told", F.lit(True))
        old = written(old.join(told, "row_id", "left").join(dims.select("dim", F.lit(True).alias("moved")), "dim", "left").where("told OR moved").drop("told", "moved"))
        kept = old.join(put.select("row_id"), "row_id", "left_anti").join(gone, "row_id", "left_anti").join(dims.select("dim"), "dim", "left_semi").select(*columns)
        new = written(put.unionByName(kept))
        known = self._last(self._of("dims", new.select("dim").where("dim IS NOT NULL")), "dim")
        joined = dims.unionByName(known.join(dims.select("dim"), "dim", "left_anti").select(*dims.columns))
        told = written(new.join(joined, "dim", "left").select(*columns, F.filter(self.facts().cast(FACT), lambda x: x["value"].isNotNull()).alias("facts"), F.lit(True).alias("alive")))
        ended = old.join(gone, "row_id", "left_semi").join(put.select("row_id"), "row_id", "left_anti").select(*columns, "facts", F.lit(False).alias("alive"))
        signed = told.select("key", F.inline("facts"), F.lit(1).alias("s")).unionByName(old.select("key", F.inline("facts"), F.lit(-1).alias("s")))
        delta = written(signed.groupBy("key", "measure", "value").agg(F.sum("s").alias("n")).where("n <> 0"))
        s.write("rows", told.unionByName(ended))
        s.write("links", told.where("dim IS NOT NULL").select("dim", "row_id").join(old.select("dim", "row_id"), ["dim", "row_id"], "left_anti"))
        s.write("dims", dims)
        s.write("states", delta)
        s.commit()
        return self.summaries(delta.select("key").distinct())

    def summaries(self, keys: DataFrame) -> DataFrame:
        """Of these keys; one without a fact left has no row."""
        return self._summed(self._of("states", keys))

    def current(self) -> DataFrame:
        """Of all keys."""
        return self._summed(self.store.read("states"))

    def _summed(self, states: DataFrame) -> DataFrame:
        held = states.groupBy("key", "measure", "value").agg(F.sum("n").alias("n")).where("n > 0")
        return held.groupBy("key").agg(*self.summary)


def count_of(measure: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("n"))), F.lit(0))


def distinct_of(measure: str) -> Column:
    return F.count_if(F.col("measure") == measure)


def least_of(measure: str) -> Column:
    return F.min(F.when(F.col("measure") == measure, F.col("value")))


def greatest_of(measure: str) -> Column:
    return F.max(F.when(F.col("measure") == measure, F.col("value")))


def share_of(measure: str, value: str) -> Column:
    """How often one value of a measure holds."""
    return F.coalesce(F.sum(F.when((F.col("measure") == measure) & (F.col("value") == value), F.col("n"))), F.lit(0))


def fact(measure: str, value: Column | str = "") -> Column:
    return F.struct(F.lit(measure).alias("measure"), (F.lit(value) if isinstance(value, str) else value.cast("string")).alias("value"))
