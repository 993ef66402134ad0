"""Streams with state over several micro-batches."""

import os
from datetime import datetime, timedelta

from lodestream.streaming import incremental

SCHEMA = "user_id long, event_id long, ts timestamp, event_type string"


def test_windows_carry_over_batches(spark, tmp_path):
    began = datetime(2024, 1, 1, 0, 0, 30)
    calls = [(u, 100 * u + i, began + timedelta(seconds=at), "view") for u in (1, 2) for i, at in enumerate((0, 10, 20, 59, 60, 61, 200))]
    for k, part in enumerate((calls[:3] + calls[7:9], calls[3:7] + calls[9:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"x{k}"))
        (src,) = (p for p in (tmp_path / f"x{k}").iterdir() if p.suffix == ".parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        src.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1000 + k, 1000 + k))
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.rate_limit(raw, 60, 2).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == 2
    got = {r.event_id: (r.nth, r.refused) for r in spark.table("windows").collect()}
    want = [(1, False), (2, False), (3, True), (4, True), (1, False), (2, False), (1, False)]
    assert got == {100 * u + i: w for u in (1, 2) for i, w in enumerate(want)}
