"""Slots that start once a local day, fired by timers of a stream; and evidence that may arrive before its article.

``fired``: each desk's timer stands at its next slot. Ticks only let time pass: a slot fires when the watermark has reached its
instant, in whatever batch that is, and days on which clocks are changed have their slots once like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

FIRED = "desk string, day string, slot string, at timestamp"


def instants(after: int, until: int, slots: dict[str, str], zone: str) -> list[tuple[int, str, str]]:
    """(second, local day, slot) of all slots after one second and up to another, in order. A time that a changed clock repeats counts the first time, one it leaves out counts as if clocks had not been changed yet."""
    tz, out = ZoneInfo(zone), []
    day = datetime.fromtimestamp(after, tz).date()
    while datetime(day.year, day.month, day.day, tzinfo=tz).timestamp() <= until:
        for name, hm in slots.items():
            at = int(datetime.fromisoformat(f"{day}T{hm}").replace(tzinfo=tz).timestamp())
            if after < at <= until:
                out.append((at, str(day), name))
        day += timedelta(days=1)
    return sorted(out)


class Slots(StatefulProcessor):
    """State of a desk: the last second whose slots have fired."""

    def __init__(self, slots: dict[str, str], zone: str) -> None:
        self.slots, self.zone = slots, zone

    def init(self, handle) -> None:
        self.handle, self.done = handle, handle.getValueState("done", "second long")

    def _wait(self, second: int) -> None:
        """The timer at the next slot, which is at most two days off."""
        self.handle.registerTimer(1000 * instants(second, second + 3 * 86400, self.slots, self.zone)[0][0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min((t for part in rows for t in part["at"].dropna()), default=None)
        if first is not None and key[0] is not None and not self.done.exists():
            second = int(first.timestamp()) - 1
            self.done.update((second,))
            self._wait(second)
        yield shown(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, now = self.done.get()[0], timerValues.getCurrentWatermarkInMs() // 1000
        if now > done:
            self.done.update((now,))
            self._wait(now)
        yield shown(key[0], instants(done, now, self.slots, self.zone))

    def close(self) -> None:
        pass


def shown(desk: str | None, fired: list[tuple[int, str, str]]) -> pd.DataFrame:
    at = pd.Series([datetime.fromtimestamp(s, timezone.utc) for s, *_ in fired], dtype="datetime64[us, UTC]")
    return pd.DataFrame({"desk": pd.Series([desk] * len(fired), dtype=object), "day": pd.Series([d for _, d, _ in fired], dtype=object), "slot": pd.Series([x for *_, x in fired], dtype=object), "at": at})


def fired(ticks: DataFrame, slots: dict[str, str], zone: str, late: str = "1 hour") -> DataFrame:
    """FIRED for a stream of ticks (desk, at): from a desk's first tick on, every slot of every local day. A null desk only lets time pass."""
    return ticks.withWatermark("at", late).groupBy(F.col("desk").cast("string").alias("desk")).transformWithStateInPandas(Slots(slots, zone), FIRED, "Append", "EventTime")


def matched(evidence: DataFrame, articles: DataFrame, late: str = "1 day", apart: str = "2 days") -> DataFrame:
    """Evidence (claim_id, article_id, at) with its article (article_id, published, source), null if none came within ``apart`` of it; two streams.

    Either may come first: what waits is kept until the watermarks of both have passed what could still match it, and is
    then given up, so state is bounded by ``late`` and ``apart``.
    """
    e = evidence.withWatermark("at", late)
    a = articles.select(F.col("article_id").alias("_id"), "published", "source").withWatermark("published", late)
    near = (F.col("article_id") == F.col("_id")) & (F.col("published") >= F.col("at") - F.expr(f"INTERVAL {apart}")) & (F.col("published") <= F.col("at") + F.expr(f"INTERVAL {apart}"))
    return e.join(a, near, "left_outer").drop("_id")
