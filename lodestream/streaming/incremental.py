"""Incremental work: health folded from a fetch log, due sources, fixed windows, micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder


def fetch_health(log: DataFrame, interval: int = 30) -> DataFrame:
    """Failures in a row, waiting minutes and health of each source after its whole log. log: user_id, event_id, ts, event_type.

    No window over a source's log: the failures in a row are those after the last success, so one aggregate finds that success
    and a second counts what came later; both combine on the map side, and a very busy source is no task of its own.
    """
    moment = F.struct("ts", "event_id")
    ends = log.groupBy("user_id").agg(F.max("ts").alias("last_at"), F.max(F.when(F.col("event_type") != "error", moment)).alias("good"))
    bad = log.where("event_type = 'error'").select("user_id", moment.alias("m"))
    fails = bad.join(ends.select("user_id", "good"), "user_id").where(F.col("good").isNull() | (F.col("m") > F.col("good"))).groupBy("user_id").agg(F.count("*").alias("fails"))
    out = ends.join(fails, "user_id", "left").withColumn("fails", F.coalesce("fails", F.lit(0)))
    wait = F.least(interval * F.pow(F.lit(2.0), F.least("fails", F.lit(6))), F.lit(360.0)).cast("long")
    health = F.when(F.col("fails") >= 5, "failing").when(F.col("fails") > 0, "degraded").otherwise("ok")
    return out.select("user_id", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_fetch"), "fails", wait.alias("wait_minutes"), health.alias("health"))


def due(health: DataFrame, now: str, limit: int) -> DataFrame:
    """Sources whose waiting time is over, longest idle first."""
    next_at = F.unix_timestamp("last_fetch") + 60 * F.col("wait_minutes")
    return health.where(next_at <= F.unix_timestamp(F.lit(now))).orderBy("last_fetch", "user_id").limit(limit).select("user_id", "last_fetch", "wait_minutes")


def fixed_window(calls: DataFrame, seconds: int, most: int) -> DataFrame:
    """Calls and refusals per key and fixed window."""
    start = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("long")
    return calls.groupBy("user_id", start.alias("start")).agg(F.count("*").alias("calls")).withColumn("refused", F.greatest(F.lit(0), F.col("calls") - most))


def run_available(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a stream over all files that are there and return what it wrote, as a test of stream = batch.

    Appended rows go to files in the shared folder; a complete result replaces the table there with every micro-batch. Nothing
    passes the driver.
    """
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0])
    out = transform(raw.withColumn("ts", F.col("ts").cast("timestamp")))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], out.schema).write.parquet(f"{base}/out")
    sink = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch-{number}")  # a batch that is run again writes the same place

    sink.foreachBatch(replace if mode == "complete" else append).start().awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Last row of each key by an explicit order."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).where("_k = 1").drop("_k")


CALL = "user_id long, event_id long, nth long, refused boolean"


def rate_limit(calls: DataFrame, seconds: int, most: int, late: str = "7 days") -> DataFrame:
    """Each call with its place in its key's window and whether it is refused; a stream with state.

    A window starts with the first call after the one before it ended, so it cannot be told from the clock as in
    ``fixed_window``; the state of a key is the window's start and its count, and goes when the watermark has passed the
    window. calls: user_id, event_id, ts (a stream). Calls of one key and micro-batch are taken in the order of time; one that comes
    after its window ended, but within ``late``, counts for the window that is open.
    """
    import pandas as pd

    def judge(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        nth = []
        for at in rows["ts"].astype("datetime64[us]").astype("int64") // 1000:
            if start is None or at >= start + 1000 * seconds:
                start, count = int(at), 0
            count += 1
            nth.append(count)
        state.update((start, count))
        state.setTimeoutTimestamp(max(start + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "nth": nth, "refused": [n > most for n in nth]})

    timed = calls.select("user_id", "event_id", "ts").withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(judge, CALL, "start long, n long", "append", "EventTimeTimeout")
