"""Session defaults, checkpoints and written tables for the engine's own operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "lodestream", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; anything may be overridden."""
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only on one machine, as in tests, is a folder of our own made where that setting is absent; a cluster without it is
    an error, since no executor would see what another one wrote.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        said = spark.conf.get("spark.checkpoint.dir", None)
        if said is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(said or tempfile.mkdtemp(prefix="lodestream-"))
    return sc.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan would leave most of them idle, as that of one small file does; larger inputs stay as they are read."""
    spark = df.sparkSession
    cores, piece = spark.sparkContext.defaultParallelism, 128 << 20
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 4 * size < cores * piece else df


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most ``size`` while a table is written, so that rows of any length need little memory beside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are kept in the shared folder."""
    shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: smaller than a checkpoint, and columns can be read apart."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
