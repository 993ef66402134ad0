"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Every document is tokenised once; documents longer than a sequence are cut into full pieces, the first of
which may be shorter. Full pieces are sequences as they are. The rest are dealt by hash into blocks of
about ``BLOCK`` pieces. Each block evolves on several islands, which are Spark rows of their own: crossover
injects whole well-filled bins of one parent into another, drops the bins that would hold a piece twice
and best-fits the displaced pieces; mutation empties poor bins. Between epochs each island's elite migrates
to the next island of its block. A block stops at the lower bound ceil(tokens / capacity).

Defined cases: a null or empty text is the end token alone; texts of any length are cut, none is dropped;
repeated rows are packed one by one; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import os
import random
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, frugal, take_over, values

CAPACITY = 2048
BLOCK = 4096
#: Entries of each of the two generations of a worker's cache of encoded pre-tokens.
CACHE = 350_000
#: Beyond these letters two libraries' Unicode tables could differ; such texts take the slower library whole.
_PLAIN = re.compile("[^\x00-ɏ]| \\s|\\s ")


class Ids(dict):
    """Little-endian ids of a space and a pre-token, as the tokenizer file gives them."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.old: dict = {}
        self.special = [t["content"] for t in said["added_tokens"]]
        # the same vocabulary and merge order for the faster library: ids of byte-level pieces are their merge ranks
        byte = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in said["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marks = {m: self._raw(m) for m in ".,"}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            stem, mark = word[:-1], word[-1:]
            if stem.isalpha() and mark in self.marks:  # letters and a mark are separate pre-tokens
                ids = self[stem] + self.marks[mark]
            else:
                ids = self._raw(" " + word)
        if len(word) <= 64:
            if len(self) >= CACHE:  # the older half goes
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _raw(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, text: str) -> bytes:
        """All ids of a text, four bytes each."""
        if not text:
            return b""
        if _PLAIN.search(text) or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *rest = text.split(" ")
        return (self._raw(first) if first else b"") + b"".join(map(self.__getitem__, rest))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, else from U+0100 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


_OPEN: dict[str, Ids] = {}


def _forget() -> None:
    _OPEN.clear()


def ids_of(path: str) -> Ids:
    if path not in _OPEN:
        _OPEN[path] = Ids(path)
    return _OPEN[path]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document's ids."""
    n = len(ids) // 4
    if n <= capacity:
        return [(0, n, zlib.crc32(ids))]
    ends = list(range(n % capacity or capacity, n + 1, capacity))
    view = memoryview(ids)
    return [(a, b - a, zlib.crc32(view[4 * a : 4 * b])) for a, b in zip([0, *ends], ends, strict=False)]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut_batches(path: str, capacity: int, end: bytes):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("packing", _forget)
        ids = ids_of(path)
        for b in batches:
            docs, number, start, length, crc = [], [], [], [], []
            for doc, text in values(b, "doc_id", "text"):
                for k, (a, n, c) in enumerate(cut(ids.of(text or "") + end, capacity)):
                    docs.append(doc)
                    number.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


# ---- the genetic algorithm on one block


class Packing:
    """Bins of item numbers with the room left in each."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]]) -> None:
        self.sizes, self.capacity, self.bins = sizes, capacity, bins
        self.room = [capacity - sum(map(sizes.__getitem__, b)) for b in bins]

    def fit(self, items: list[int]) -> Packing:
        """Best-fit items in the order given. Bins lie on shelves by room; a bit set finds the tightest shelf."""
        shelves: dict[int, list[int]] = {}
        mask = 0
        for k, r in enumerate(self.room):
            shelves.setdefault(r, []).append(k)
            mask |= 1 << r
        for i in items:
            s = self.sizes[i]
            above = mask >> s
            if above:
                r = s + (above & -above).bit_length() - 1
                k = shelves[r].pop()
                if not shelves[r]:
                    mask ^= 1 << r
                self.bins[k].append(i)
            else:
                k, r = len(self.bins), self.capacity
                self.bins.append([i])
                self.room.append(r)
            self.room[k] = r = r - s
            shelves.setdefault(r, []).append(k)
            mask |= 1 << r
        return self

    def fitness(self) -> tuple[int, float]:
        """Smaller is better: bins, then less of the squared fill that rewards full bins."""
        return len(self.bins), -sum((self.capacity - r) ** 2 for r in self.room)

    def assigned(self) -> list[int]:
        out = [0] * len(self.sizes)
        for k, b in enumerate(self.bins):
            for i in b:
                out[i] = k
        return out


def from_assigned(sizes: list[int], capacity: int, of: list[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(of, default=-1) + 1)]
    for i, k in enumerate(of):
        bins[k].append(i)
    return Packing(sizes, capacity, [b for b in bins if b])


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Whole well-filled bins of ``a`` enter ``b``."""
    full = sorted(range(len(a.bins)), key=a.room.__getitem__)[: max(1, len(a.bins) // 2)]
    chosen = [a.bins[k] for k in rng.sample(full, max(1, len(full) // 2))]
    there = {i for x in chosen for i in x}
    kept, displaced = [], []
    for x in b.bins:
        if there.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in there]
    displaced.sort(key=lambda i: -a.sizes[i])
    return Packing(a.sizes, a.capacity, [list(x) for x in chosen] + kept).fit(displaced)


def mutate(a: Packing, rng: random.Random) -> Packing:
    """Empty the poorest bins and a few others, and best-fit their items, larger ones first on the whole."""
    n = len(a.bins)
    poor = sorted(range(n), key=lambda k: -a.room[k])[: 1 + n // 20]
    gone = set(poor) | set(rng.sample(range(n), min(n, 1 + n // 50)))
    loose = [i for k in gone for i in a.bins[k]]
    loose.sort(key=lambda i: -a.sizes[i] * (0.8 + 0.4 * rng.random()))
    return Packing(a.sizes, a.capacity, [list(x) for k, x in enumerate(a.bins) if k not in gone]).fit(loose)


def evolve(sizes: list[int], elites: list[list[int]], capacity: int, seed: int, population: int = 4, generations: int = 6) -> list[int]:
    """Best assignment found on one island in one epoch; never worse than best-fit-decreasing or any given elite."""
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    herd = [from_assigned(sizes, capacity, e) for e in elites] or [Packing(sizes, capacity, []).fit(falling)]
    herd.sort(key=Packing.fitness)
    if len(herd[0].bins) <= bound:
        return herd[0].assigned()
    while len(herd) < population:
        noisy = sorted(falling, key=lambda i: -sizes[i] * (0.9 + 0.2 * rng.random()))
        herd.append(Packing(sizes, capacity, []).fit(noisy))
    for _ in range(generations):
        herd.sort(key=Packing.fitness)
        if len(herd[0].bins) <= bound:
            break
        a, b = herd[0], herd[rng.randrange(1, len(herd))]
        herd = herd[: population - 2] + [crossover(b, a, rng), mutate(crossover(a, b, rng), rng)]
    return min(herd, key=Packing.fitness).assigned()


_ISLAND = "block long, island int, sizes array<int>, elites array<array<int>>, n_bins int, bound int"


def _island_batches(capacity: int, epoch: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                best = evolve(row["sizes"], row["elites"] or [], capacity, 1000 * epoch + 31 * row["island"] + row["block"])
                row |= {"elites": [best], "n_bins": max(best, default=-1) + 1, "bound": -(-sum(row["sizes"]) // capacity)}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("elites", pa.list_(pa.list_(pa.int32()))), ("n_bins", pa.int32()), ("bound", pa.int32())]))

    return run


def offsets(sizes: list[int], of: list[int]) -> list[int]:
    at: dict[int, int] = {}
    out = []
    for s, k in zip(sizes, of, strict=True):
        out.append(at.get(k, 0))
        at[k] = out[-1] + s
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_cut_batches(tokenizer, capacity, struct.pack("<I", end_id)), _PIECE)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, islands: int = 3, epochs: int = 2, block: int = BLOCK) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    cuts = checkpoint(pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()))
    short = cuts.where(F.col("length") < capacity)
    n_blocks = max(1, short.count() // block)
    items = short.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    blocks = checkpoint(items.groupBy("block").agg(F.collect_list(item).alias("items")))  # a block holds about ``block`` pieces, whatever the input
    state = blocks.select("block", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), F.transform("items", lambda x: x["length"].cast("int")).alias("sizes"), F.lit(None).cast("array<array<int>>").alias("elites"))
    for epoch in range(epochs):
        spread = state.repartition(max(8, min(n_blocks * islands, 4096)), "block", "island")
        state = checkpoint(spread.mapInArrow(_island_batches(capacity, epoch), _ISLAND))
        worst = state.agg(F.max(F.col("n_bins") - F.col("bound"))).first()[0]
        if not worst or epoch == epochs - 1:
            break
        coming = state.select("block", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.col("elites").alias("coming"))
        state = state.join(coming, ["block", "island"]).select("block", "island", "sizes", F.concat("elites", "coming").alias("elites"))
    best = state.groupBy("block").agg(F.min_by(F.element_at("elites", 1), F.struct("n_bins", "island")).alias("bins"))
    places = F.udf(offsets, "array<int>")  # one call a block
    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    placed = blocks.join(best, "block").select("block", F.explode(F.arrays_zip("items", "bins", places(lengths, F.col("bins")).alias("at"))).alias("x"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = placed.select("x.items.*", (2 * (F.col("block") * (1 << 24) + F.col("x.bins"))).cast("long").alias("sequence_id"), F.col("x.at").cast("long").alias("offset"))
    full = cuts.where(F.col("length") == capacity).select(*columns, (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
