"""Token counts by map-side two-tier lookup.

Pre-tokens are the stretches between single spaces. No piece of the vocabulary has white space behind
another character, so no merge crosses a pre-token's start and a text's count is the sum of its
pre-tokens' counts; texts for which that does not hold as they stand (runs of spaces, a space at either
end, the vocabulary's own space mark) are encoded whole by the library.

First tier: frequent pre-tokens, found over all texts by Misra-Gries summaries. Each task keeps a bounded
summary, summaries of a few tasks are merged level by level, and the last one, of at most ``frequent``
entries, becomes a broadcast table of lengths. Second tier: a bounded cache in every Python worker for
what that table lacks. No pre-token is ever shuffled, only whole summaries.

Defined cases: null and empty texts have 0 bytes and 0 tokens; texts of any length are counted whole;
repeated rows are counted one by one; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, take_over, texts

#: Entries of a summary and of the broadcast table: at most about 2 MB.
FREQUENT = 32_768
#: Entries of a worker's cache.
CACHE = 400_000
MARK = "▁"


def trim(counts: Counter, size: int) -> Counter:
    """Misra-Gries reduction: subtract the count of rank ``size`` + 1 and keep what remains positive."""
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def _packed(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], names=["words", "counts"])


def _summarise(size: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in texts(b):
                if text:
                    seen.update(w for w in text.split(" ") if len(w) <= 64)
                    if len(seen) > 8 * size:
                        seen = trim(seen, size)
        seen = trim(seen, size)
        if seen:
            yield _packed(seen)

    return run


def _merge(size: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for words, counts in zip(b.column("words").to_pylist(), b.column("counts").to_pylist(), strict=True):
                for w, n in zip(words, counts, strict=True):
                    seen[w] += n
                seen = trim(seen, size)
        if seen:
            yield _packed(seen)

    return run


def frequent_words(docs: DataFrame, size: int = FREQUENT, fan_in: int = 16) -> list[str]:
    """At most ``size`` pre-tokens; every one above 1 / size of all pre-tokens is among them."""
    schema = "words array<string>, counts array<long>"
    some = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_summarise(size), schema)
    n = some.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan_in)
        some = some.repartition(n).mapInArrow(_merge(size), schema)
    got = some.first()
    return [w for w, _ in sorted(zip(got["words"], got["counts"], strict=True), key=lambda x: (-x[1], x[0]))] if got else []


class Lengths(dict):
    """Tokens of a pre-token: the broadcast tier, then this cache, then the library."""

    def __init__(self, model: str, words: list[str], counts: bytes) -> None:
        import sentencepiece

        super().__init__(zip(words, counts, strict=True))
        self.encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
        self.first, self.cached = len(self), 0

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word)) if word else 0
        if len(word) <= 64:
            if self.cached >= CACHE:
                for w in list(self)[self.first :]:
                    del self[w]
                self.cached = 0
            self.cached += 1
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return len(self.encode(text, num_threads=1))
        return sum(map(self.__getitem__, text.split(" ")))


_OPEN: dict = {}


def _forget() -> None:
    _OPEN.clear()


def _lengths(model: str, table) -> Lengths:
    """Kept between the tasks of a worker, one at a time."""
    key = (model, id(table))
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Lengths(model, *table.value)
    return _OPEN[key]


def _count(model: str, table):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("tokens", _forget)
        lengths = _lengths(model, table)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array([lengths.count(t) for t in texts(b)], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document under a sentencepiece model file."""
    import sentencepiece

    words = frequent_words(docs, frequent)
    found = sentencepiece.SentencePieceProcessor(model_file=model).encode(words, num_threads=1)
    kept = [(w, len(x)) for w, x in zip(words, found, strict=True) if len(x) < 256]
    table = docs.sparkSession.sparkContext.broadcast(([w for w, _ in kept], bytes(n for _, n in kept)))
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return base.mapInArrow(_count(model, table), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
