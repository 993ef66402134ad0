"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, shared_folder, written

__all__ = ["BROADCAST_IDS", "WORD", "checkpoint", "connected_components", "crc32_text", "frugal", "lookup", "only", "shared_folder", "take_over", "texts", "values", "written"]

#: Word of the contracts: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids up to which a set of ids is broadcast (16 MB at most); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: A key with this many rows, and with a thousandth of all, is heavy: there are a thousand heavy keys at most.
HEAVY = 1_000
#: Edges from which the hubs of a graph are looked up apart.
HUBS_FROM = 1_000_000


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


_HELD: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that; without it an idle worker stays as large as it ever was."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function whose worker gives freed memory back when the task ends, since stages without Python may follow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def take_over(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called at the start of an operator's task in a Python worker: what other operators keep there between their tasks is cleared, so that caches never add up.

    ``clear`` is a function of a module, since a method of a module's table would be shipped with a copy of that table.
    """
    for other in [k for k in _HELD if k != owner]:
        _HELD.pop(other)()
        give_back()
    _HELD[owner] = clear


def values(b: pa.RecordBatch, *columns: str, rows: int = 256) -> Iterator[tuple]:
    """Tuples of the columns as Python objects, made for a few rows at a time."""
    for at in range(0, b.num_rows, rows):
        part = b.slice(at, rows)
        yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def texts(b: pa.RecordBatch) -> Iterator[str | None]:
    return (t for (t,) in values(b, "text"))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has one row a key; its column ``count`` says how many rows bear the key, ``total`` how many there are.

    Heavy keys, a thousand at most, are broadcast, so that their rows need no shuffle; no other key has over a
    thousandth of the rows (or HEAVY) and those meet by a shuffle. Rows with a null key find nothing.
    """
    heavy = F.col(count) >= max(HEAVY, total // 1000)
    marked = rows.join(F.broadcast(table.where(heavy).drop(count).withColumn("heavy", F.lit(True))), keys, "left")
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    light = rows.join(F.broadcast(table.where(heavy).select(*keys)), keys, "left_anti").where(known).join(table.where(~heavy).drop(count), keys)
    return marked.where("heavy").drop("heavy").unionByName(light)


def only(rows: DataFrame, key: str, kept: DataFrame, dropped: DataFrame, n_dropped: int) -> DataFrame:
    """The rows whose ``key`` is in ``kept``; ``dropped`` holds all other keys. Few dropped ones are broadcast, else the rows are shuffled to those kept."""
    if n_dropped <= BROADCAST_IDS:
        return rows.join(F.broadcast(dropped.select(key)), key, "left_anti")
    return rows.join(kept.select(key), key, "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a long, b long); component is the smallest id reachable.

    Alternates large-star and small-star steps until the edge set stands still, so each round is two
    aggregations and two joins; no adjacency list is ever gathered in one row, and the edges of hubs are not
    shuffled to the hub's least neighbour. Self-loops and repeated edges are harmless; no edges give an empty result.
    """

    def least(e: DataFrame, rows: DataFrame, low: DataFrame, n: int) -> DataFrame:
        return rows.join(low.drop("n"), "u") if n < HUBS_FROM else lookup(rows, low, ["u"], "n", n)

    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark, n = None, e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = least(e, both, low, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = least(e, large, low, 2 * n).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = checkpoint(small)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.col("v") % 1000003).cast("double"))).first())
        if now == mark:
            return e.groupBy("u").agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()).withColumnRenamed("u", "id").groupBy("id").agg(F.min("component").alias("component"))
        mark, n = now, now[0]
