"""Tables kept in the shared folder as generations of buckets, for results that are maintained instead of made anew.

A change never rewrites what lies there: it adds rows as a new generation, and a generation counts once it is committed, so a
run that died half-way leaves nothing that is read and its number is written over by the next. Reading a few keys opens
the buckets of those keys only; a bucket is a directory, so Spark prunes the others when it plans.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


class Store:
    """Named tables, each (schema, key column), that share their generations. One writer at a time; readers see the last commit."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int = 64) -> None:
        self.spark, self.path, self.tables, self.buckets = spark, path, tables, buckets
        try:
            self.last = spark.read.parquet(f"{path}/commits").agg(F.max("last")).first()[0]
        except Exception as e:  # noqa: BLE001  the folder is new
            if "PATH_NOT_FOUND" not in str(e):
                raise
            for name, (schema, _) in tables.items():  # an empty file, so that a table without rows can be read
                spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}/gen=-1/bucket=0")
            self.last = -1
            self.commit(-1)

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(self.tables[name][1])), F.lit(self.buckets)).cast("int")

    def write(self, name: str, rows: DataFrame, placed: bool = False) -> None:
        """Rows of the generation that the next commit makes valid, sorted by key inside a bucket so that row groups can be skipped too; ``placed`` rows are written by the tasks that hold them, without a shuffle."""
        key = self.tables[name][1]
        rows = rows.select(*names(self.tables[name][0])).withColumn("bucket", self.bucket(name))
        (rows if placed else rows.repartitionByRange("bucket", key)).sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/gen={self.last + 1}")

    def commit(self, generation: int | None = None) -> int:
        self.last = self.last + 1 if generation is None else generation
        self.spark.createDataFrame([(self.last,)], "last int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return self.last

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """Committed rows with gen and bucket; of these ``buckets`` alone, if given."""
        rows = self.spark.read.schema(f"{self.tables[name][0]}, gen int, bucket int").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        rows = rows.where(F.col("gen").between(0, self.last))
        return rows if buckets is None else rows.where(F.col("bucket").isin(sorted(buckets)) if buckets else F.lit(False))

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """Buckets of these keys; there are ``buckets`` at most."""
        return [r[0] for r in keys.select(self.bucket(name)).distinct().collect()]
