"""Quality rules with host-level verdicts.

Per document, five counts are taken from the whole text and two base rules are applied. Rule failures are
then aggregated by host; each host's failure rate is shrunk with a beta prior fitted to all hosts by the
method of moments, and the host's verdict is joined back to its documents.

Defined cases: a null or empty text has no words and fails; a null host has no verdict and is kept when
its own rules pass; repeated rows are judged one by one; an empty table gives an empty result; only the
named columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, frugal, lookup, take_over, texts, written

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5


def _coded(a: np.ndarray) -> np.ndarray:
    return np.unique(a, return_inverse=True)[1]


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice; exact, as windows are coded by doubling without hashing."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    code: dict = {}
    ids = np.array([code.setdefault(w, len(code)) for w in words], dtype=np.int64)
    if len(code) == len(words):
        return 0
    at = np.arange(n)
    key = ids[:n].copy()
    for k in range(1, window):  # only positions whose first k words repeat are looked at further
        new = key * len(words) + ids[at + k]
        key, count = np.unique(new, return_inverse=True, return_counts=True)[1:]
        again = count[key] > 1
        at, key = at[again], key[again]
        if not len(at):
            return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the white space of the contract
    kept = b"".join(words)
    chars = len(kept) if kept.isascii() else len(kept) - sum(map(kept.count, _CONTINUATION)) if len(kept) < 64 else int((np.frombuffer(kept, np.int8) >= -64).sum())
    symbols = sum(raw.count(s) for s in _SYMBOL_BYTES)
    return len(words), chars, symbols, dup_lines(text), repeat_words(words)


_SYMBOL_BYTES = [s.encode() for s in SYMBOLS]
_CONTINUATION = [bytes([b]) for b in range(0x80, 0xC0)]


@frugal
def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_over("quality")
    for b in batches:
        got = np.array([text_counts(t) for t in texts(b)], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in b.schema.names if c != "text"}, **{c: pa.array(got[:, i]) for i, c in enumerate(COUNTS)}})


def document_counts(docs: DataFrame, host: str = "source", carry: tuple = ()) -> DataFrame:
    """One row per document: doc_id, host, the five counts, base_failed, and the columns of ``carry`` as the struct row."""
    more = (F.struct(*carry).alias("row"),) * bool(carry)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"), *more)
    schema = base.drop("text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    out = base.mapInArrow(_count_batches, schema)
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(counts: DataFrame, max_rate: float = 0.5, min_docs: int = 20) -> DataFrame:
    """host, host_docs, host_failed, host_rate, host_kept from rows of (host, base_failed).

    The beta prior is fitted over all hosts: mean m and variance v of their rates, less the mean binomial
    variance, give strength s = m(1-m)/v - 1, held within 1 and 1000. A host goes only when its shrunken rate
    exceeds ``max_rate`` and at least ``min_docs`` documents speak against it, so that one bad page on a
    small host condemns nothing.
    """
    hosts = counts.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg((F.sum("host_failed") / F.sum("host_docs")).alias("m"), F.var_pop(rate).alias("raw"), F.avg(rate * (1 - rate) / F.col("host_docs")).alias("noise"))
    v = F.greatest(F.col("raw") - F.col("noise"), F.lit(0.0))
    m = F.col("m")
    strength = F.when(v <= m * (1 - m) / 1001, F.lit(1000.0)).otherwise(F.greatest(F.lit(1.0), F.try_divide(m * (1 - m), v) - 1))
    prior = prior.select("m", F.coalesce(strength, F.lit(1000.0)).alias("s"))
    shrunk = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", (F.col("host_failed") + F.col("m") * F.col("s")) / (F.col("host_docs") + F.col("s")))  # one row of two numbers
    return shrunk.select("host", "host_docs", "host_failed", "host_rate", ((F.col("host_rate") <= max_rate) | (F.col("host_docs") < min_docs)).alias("host_kept"))


def judge(docs: DataFrame, host: str = "source", carry: tuple = (), **limits) -> DataFrame:
    """The counts of every document with base_failed and kept, and the columns of ``carry`` as the struct row."""
    counts = (checkpoint if carry else written)(document_counts(docs, host, carry))  # texts are counted once; writing and reading whole texts as Parquet takes memory beside the heap
    verdicts = written(host_verdicts(counts, **limits).select("host", "host_docs", "host_rate", "host_kept"))
    total = verdicts.agg(F.coalesce(F.sum("host_docs"), F.lit(0))).first()[0]
    said = lookup(counts, verdicts, ["host"], "host_docs", total)
    silent = counts.where("host IS NULL").withColumns({"host_rate": F.lit(None).cast("double"), "host_kept": F.lit(True)})
    return said.unionByName(silent).select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_rate", *("row",) * bool(carry))
