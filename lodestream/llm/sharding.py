"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are sets of equal texts. Sorted by size they enter the bin with the tightest remaining capacity,
found in a balanced tree. Two levels keep it distributed: groups are first bundled by best-fit-decreasing
inside many hash buckets; what each bucket leaves below half a bundle is bundled again in fewer buckets, so that the list
of bundles is bounded by the number of shards alone; that list is packed into the shards, at the smallest
capacity (found by bisection) for which best-fit-decreasing needs no more shards than there are.

Only a group larger than a shard's fair share, of which there are fewer than shards, parts: it is dealt by a hash
of doc_id into as many pieces as shares it fills. All other groups stay whole; those of some size are bundles of
their own, around which the small ones are packed.

Defined cases: a null text has size 8 and crc32 0 and groups with empty texts; repeated rows are rows like
any other; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, crc32_text, written

#: Bundles of a fair share: the driver sees about twice as many sizes per shard.
BUNDLES = 1000
#: Groups of a bucket on average, and rows of a numbering bucket.
BUCKET_ROWS = 20_000


class Tree:
    """Balanced search tree (treap) of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root = None
        self.random = random.Random(7).random

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            t[3] = a
            return t, b
        a, b = self._split(t[2], key)
        t[2] = b
        return a, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self.random(), None, None]), b)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the entry of least capacity that holds ``size``."""
        best, t, key = None, self.root, (size, -1)
        while t is not None:
            if t[0] >= key:
                best, t = t[0], t[2]
            else:
                t = t[3]
        if best is not None:
            a, b = self._split(self.root, best)
            _, b = self._split(b, (best[0], best[1] + 1))
            self.root = self._merge(a, b)
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, least: int = 1) -> tuple[list[int], int]:
    """Bin of each item of ``sizes`` (already in falling order) and the number of bins; larger items get bins of their own. ``least``: bins with less room are closed."""
    tree, n, out = Tree(), 0, []
    for size in sizes:
        got = tree.take_tightest(size)
        room, k = got or (max(capacity, size), n)
        n += got is None
        if room - size >= least:
            tree.add((room - size, k))
        out.append(k)
    return out, n


def shard_units(sizes: list[int], shards: int) -> list[int]:
    """Shard of each unit: best-fit-decreasing at the smallest capacity that needs at most ``shards`` bins."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = [sizes[i] for i in order]
    low = max(-(-sum(sizes) // shards), max(falling, default=1))
    high = low + max(falling, default=1)
    while best_fit_decreasing(falling, high)[1] > shards:
        high += high - low
    while low < high:
        mid = (low + high) // 2
        if best_fit_decreasing(falling, mid)[1] <= shards:
            high = mid
        else:
            low = mid + 1
    out = [0] * len(sizes)
    for i, k in zip(order, best_fit_decreasing(falling, high)[0], strict=True):
        out[i] = k
    return out


def _bundler(capacity: int):
    def bundle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "name"], ascending=[False, True])
        bins, _ = best_fit_decreasing(frame["bytes"].tolist(), capacity, 9)
        return pd.DataFrame({"name": frame["name"], "bundle": [f"{b}-{k}" for b, k in zip(frame["bucket"], bins, strict=True)]})

    return bundle


def bundled(items: DataFrame, buckets: int, capacity: int) -> DataFrame:
    """name and bundle of each item (name string, bytes long), by best-fit-decreasing inside ``buckets`` hash buckets."""
    items = items.withColumn("bucket", F.pmod(F.xxhash64("name", F.lit(buckets)), F.lit(buckets)))
    return written(items.groupBy("bucket").applyInPandas(_bundler(capacity), "name string, bundle string"))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), crc32_text(F.col("text").cast("string")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    base = checkpoint(base)  # texts are read and hashed once
    groups = base.groupBy("digest").agg(F.sum("size").alias("group_bytes"))
    total, n_groups, n_rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.approx_count_distinct("digest"), F.count("*")).first()
    share = max(1, total // shards)
    # at most ``shards`` groups exceed a share, so this side has a proven bound
    large = groups.where(F.col("group_bytes") > share).select("digest", F.ceil(F.col("group_bytes") / share).cast("int").alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0)).cast("int")
    dealt = base.join(F.broadcast(large), "digest", "left").select("doc_id", "size", "text_crc32", "digest", piece.alias("piece"))
    units = written(dealt.groupBy("digest", "piece").agg(F.sum("size").alias("bytes")).withColumn("name", F.concat_ws("-", F.hex("digest"), "piece")))
    buckets, capacity = max(64, n_groups // BUCKET_ROWS), max(1, share // BUNDLES)
    first = bundled(units.select("name", "bytes"), buckets, capacity)
    sums = first.join(units.select("name", "bytes"), "name").groupBy("bundle").agg(F.sum("bytes").alias("bytes"))
    # a bundle below half its capacity is left once a bucket at most: the left ones are bundled again, in a few buckets
    second = bundled(sums.where(2 * F.col("bytes") < capacity).select(F.col("bundle").alias("name"), "bytes"), max(1, buckets // BUCKET_ROWS), capacity)
    whole = sums.join(second.select(F.col("name").alias("bundle"), F.concat(F.lit("left-"), "bundle").alias("into")), "bundle", "left").select("bundle", F.coalesce("into", "bundle").alias("into"), "bytes")
    whole = written(whole)
    # 2 * BUNDLES * shards sizes at most, and one for each of the few buckets
    sizes = whole.groupBy("into").agg(F.sum("bytes").alias("b")).orderBy("into").toPandas()
    placed = docs.sparkSession.createDataFrame(list(zip(sizes["into"].tolist(), shard_units(sizes["b"].tolist(), shards), strict=True)), "into string, shard int")
    where = units.join(first, "name").join(whole.select("bundle", "into"), "bundle").join(F.broadcast(placed), "into").withColumnRenamed("bytes", "unit_bytes")
    where = written(where.select("digest", "piece", "unit_bytes", "shard"))
    # the rows of a unit over an eighth of a share, of which there are at most 8 * shards, must not meet in one task
    big = where.where(F.col("unit_bytes") * 8 > share).select("digest", "piece", F.col("shard").alias("big_shard"))
    at = dealt.join(F.broadcast(big), ["digest", "piece"], "left")
    small = at.where("big_shard IS NULL").drop("big_shard").join(where.where(F.col("unit_bytes") * 8 <= share).select("digest", "piece", "shard"), ["digest", "piece"])
    columns = ["doc_id", "size", "text_crc32"]
    rows = small.select(*columns, "shard").unionByName(at.where("big_shard IS NOT NULL").select(*columns, F.col("big_shard").alias("shard")))
    return number(rows, "shard", max(8, n_rows // shards // BUCKET_ROWS))


def number(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """Add slot, gapless from 0 in each ``key``: numbered inside ``parts`` hash parts, shifted by the parts before."""
    rows = checkpoint(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(parts)).cast("int")))
    sizes = rows.groupBy(key, "part").count()
    before = sizes.withColumn("before", F.sum("count").over(W.partitionBy(key).orderBy("part")) - F.col("count")).drop("count")
    inside = F.row_number().over(W.partitionBy(key, "part").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("inside", inside).join(before, [key, "part"]).withColumn("slot", (F.col("inside") + F.col("before")).cast("long")).drop("part", "inside", "before")
