"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct word shingles. Tokens have one global order: rare ones
first by hash, frequent ones (found over all documents by window counts) last by frequency. With a least
overlap a = ceil(threshold * n), the l-prefix of a set of n tokens is its first n - a + l tokens; two sets
that link share at least min(l, l') tokens of their prefixes. Each document picks the l of least estimated
cost: a longer prefix means more postings to scan but asks for more shared tokens before a pair is verified.

1. Documents with equal sets form classes; only the smallest id of a class goes on.
2. Postings, a token and an id with the set's size and l in one number, are shuffled by token once, and lists of one
   member end there. In every other list each member is paired with the list's smallest id alone, and the pairs that
   share enough are verified: groups of near copies become connected in linear time.
3. Of the pairs that remain, only those between different components matter. Lists that still hold more than
   one component are cut into blocks, and inside a task each pair of a block is held against a bound from
   parity bitmaps: tokens that only one of two sets holds flip at most one bit each, so sets that differ in
   more bits than similar sets may are no pair. Pairs that pass and share enough tokens are verified exactly.
   Of tokens that two sets share at most ``BESIDE`` places apart only the first and the last write the pair, with
   their places, which bounds how many are shared, so that near copies are not written once for every token.

So no link between components is missed, while a group of thousands of near copies never becomes pairs.

Defined cases: without words the set is empty and links with nothing; fewer words than a shingle are one
shingle; texts are used whole; a null doc_id gets a null component; repeated rows share a set and so a
component; an empty table gives an empty result; only doc_id, text and the columns asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, connected_components, frugal, lookup, take_over, values, written

#: Tokens of a counting window; a token in at least ``HOT_IN_WINDOW`` different sets of one is counted as frequent.
WINDOW_TOKENS, HOT_IN_WINDOW = 1 << 21, 3
#: Frequent tokens kept, the most frequent ones: the broadcast is 1 MB at most. Others merely order by hash.
HOT = 65_536
#: Longest prefix extension tried, and cost of verifying a pair in postings scanned.
MOST_MATCHES, VERIFY_COST = 8, 40.0
WORD_CACHE = 150_000
#: Members of a block of a list, and bits of a parity bitmap.
SIDE, BITS = 512, 512
#: Tokens looked at on either side of one, among those of its set that are held in lists.
BESIDE = 4
BEFORE, BEHIND = ([f"{side}{i}" for i in range(BESIDE)] for side in ("before", "behind"))
#: A set of n tokens with prefix extension l is written n * NL + l.
NL = 16


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _WordHash()


def _forget() -> None:
    _HASH.clear()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; ASCII letters are lower-cased first."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    width = min(n, k)
    codes = np.fromiter(map(_HASH.__getitem__, words), np.uint64, n)
    h = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        h = (h ^ codes[j : n - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))


def _texts(b: pa.RecordBatch):
    return values(b, "doc_id", "text")


def parity(s: np.ndarray) -> bytes:
    """Bitmap in which each token flips one bit."""
    bits = np.bincount(s & (BITS - 1), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _digest_batches(k: int, carry: tuple):
    whole = ("doc_id", "n_shingles", "d1", "d2", *carry)
    schema = pa.schema([*((c, pa.int64()) for c in (*whole, "token", "sets")), ("bits", pa.binary())])

    def frequent(window: dict) -> pa.RecordBatch | None:
        token, count = np.unique(np.concatenate(list(window.values())), return_counts=True)
        hot = count >= HOT_IN_WINDOW
        none = pa.nulls(int(hot.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([*(none,) * len(whole), pa.array(token[hot]), pa.array(count[hot].astype(np.int64)), pa.nulls(len(none), pa.binary())], schema=schema) if hot.any() else None

    @frugal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("shingles", _forget)
        window, held = {}, 0
        for b in batches:
            rows, bits = [], []
            for doc, text in _texts(b):
                s = shingle_set(text, k)
                bits.append(parity(s))
                both = xxhash.xxh3_128_intdigest(s.tobytes())
                d1, d2 = (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)
                rows.append((doc, len(s), d1, d2))
                if len(s) and both not in window:  # equal sets count once
                    window[both] = s
                    held += len(s)
                    if held >= WINDOW_TOKENS:
                        if (hot := frequent(window)) is not None:
                            yield hot
                        window, held = {}, 0
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((),) * 4)), *map(b.column, carry), none, none, pa.array(bits, pa.binary())], schema=schema)
        if window and (hot := frequent(window)) is not None:
            yield hot

    return run


def least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def adaptive_prefix(s: np.ndarray, hot: np.ndarray, sets: np.ndarray, num: int, den: int) -> tuple[int, np.ndarray]:
    """(l, prefix) of least estimated cost. hot: sorted frequent tokens, sets: their counts."""
    n = len(s)
    freq = np.zeros(n)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        freq = np.where(hot[at] == s, sets[at], 0).astype(float)
    order = np.lexsort((s, freq))
    alpha = least_overlap(n, num, den)
    cost = np.cumsum(freq[order])
    best, least = 1, None
    for m in range(1, min(MOST_MATCHES, alpha) + 1):
        p = n - alpha + m
        now = p + cost[p - 1] * (1 + VERIFY_COST / m)
        if least is None or now < least:
            best, least = m, now
    return best, s[order[: n - alpha + best]]


def _prefix_batches(k: int, num: int, den: int, table):
    schema = pa.schema([("doc", pa.int64()), ("nl", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    @frugal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("shingles", _forget)
        hot, sets = table.value
        for b in batches:
            docs, sizes, tokens = [], [], []
            for doc, text in _texts(b):
                s = shingle_set(text, k)
                if len(s):
                    m, prefix = adaptive_prefix(s, hot, sets, num, den)
                    docs.append(doc)
                    sizes.append(len(s) * NL + m)
                    tokens.append(prefix)
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            flat = pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], schema=schema)

    return run


def _set_batches(k: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("shingles", _forget)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                got = [(doc, shingle_set(text, k).tobytes()) for doc, text in _texts(b.slice(at, 256))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], names=["doc", "tokens"])

    return run


def _verify_batches(num: int, den: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in values(b, "x", "y"):
                u, v = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = np.concatenate((u, v))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(den * shared >= num * (len(u) + len(v) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _list_batches(num: int, den: int):
    """Pairs that the bitmaps allow, from runs of equal (token, lo, hi) in sorted rows; a run may go on in the next batch.

    The sum of ``shared`` over the rows of a pair is at least the number of tokens it shares: where none of the last tokens
    before is shared, a stretch begins, where none of the next behind is, it ends, and the places in the set of the
    smaller id (``pos``) tell its length. Where fewer stand before or behind, the token itself fills up.
    """
    names = ["token", "lo", "hi", "doc", "nl", "c", "own", "pos", *BEFORE, *BEHIND]
    kinds = ("x", "y", "x_nl", "y_nl", "shared")

    def one(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        own = x["own"]
        left, right = (np.arange(len(own)),) * 2 if x["lo"][0] == x["hi"][0] else (np.flatnonzero(own == x["lo"][0]), np.flatnonzero(own == x["hi"][0]))
        ok = x["c"][left][:, None] != x["c"][right][None, :]
        if not ok.any():
            return None
        n = x["nl"] // NL
        total = n[left][:, None] + n[right][None, :]
        overlap = -(-num * total // (num + den))
        small = np.minimum(n[left][:, None], n[right][None, :])
        i, j = np.nonzero(ok & (overlap <= small))
        if x["lo"][0] == x["hi"][0]:
            i, j = i[i < j], j[i < j]
        most = (total - 2 * overlap)[i, j]
        i, j = left[i], right[j]
        i, j = np.where(x["doc"][i] < x["doc"][j], (i, j), (j, i))
        flips = np.zeros(len(i), np.int64)
        for w in range(BITS // 64):
            flips += np.bitwise_count(x["bits"][i, w] ^ x["bits"][j, w])
        i, j = i[flips <= most], j[flips <= most]
        begins, ends = (~np.any([(x[p][i] == x[q][j]) & (x[p][i] != x["token"][0]) for p in names for q in names], axis=0) for names in (BEFORE, BEHIND))
        told = begins | ends
        return i[told], j[told], (ends * (x["pos"][i] + 1) - begins * x["pos"][i])[told]

    @frugal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        none = pa.RecordBatch.from_pydict({k: pa.array([], pa.int64()) for k in kinds})

        def runs(x: dict, last: bool):
            n = len(x["token"])
            new = np.flatnonzero((x["token"][1:] != x["token"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1])) + 1
            edges = [0, *new.tolist(), n]
            done = edges if last else edges[:-1]
            out = ([], [], [], [], [])
            for a, b in zip(done, done[1:], strict=False):
                if b - a > 1 and (got := one({k: v[a:b] for k, v in x.items()})) is not None:
                    i, j = got[0] + a, got[1] + a
                    for to, column in zip(out, (x["doc"][i], x["doc"][j], x["nl"][i], x["nl"][j], got[2]), strict=True):
                        to.append(column)
            rest = None if last else {k: v[edges[-2] :] for k, v in x.items()}
            found = pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(c)) for k, c in zip(kinds, out, strict=True)}) if out[0] else none
            return found, rest

        for b in batches:
            if not b.num_rows:
                continue
            x = {k: b.column(k).to_numpy(zero_copy_only=False) for k in names}
            x["bits"] = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            if held is not None:
                x = {k: np.concatenate((held[k], x[k])) for k in x}
            found, held = runs(x, False)
            yield found
        if held is not None:
            yield runs(held, True)[0]

    return run


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    few = ids.count() <= BROADCAST_IDS
    some = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = some.mapInArrow(_set_batches(k), "doc long, tokens binary")
    sets = written(sets.groupBy("doc").agg(F.first("tokens").alias("tokens")))  # repeated rows of an id: any of them
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(_verify_batches(num, den), "a long, b long"))


def _candidates(pairs: DataFrame, a: str, b: str, num: int, den: int) -> tuple[Column, Column]:
    """(sizes are similar, least number of shared prefix tokens) of pairs of columns a and b with a_nl and b_nl.

    Overlap <= shared prefix tokens + what lies behind the prefix that ends first, whichever that is.
    """

    def share(n: Column, of: int) -> Column:
        return F.floor((n * num + (of - 1)) / of)  # ceil in whole numbers

    n = [F.floor(F.col(f"{x}_nl") / NL) for x in (a, b)]
    l = [F.col(f"{x}_nl") % NL for x in (a, b)]  # noqa: E741
    behind = [share(x, den) - y for x, y in zip(n, l, strict=True)]
    return den * F.least(*n) >= num * F.greatest(*n), F.greatest(F.least(*l), share(n[0] + n[1], num + den) - F.greatest(*behind))


def join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, carry: tuple = ()) -> DataFrame:
    """doc_id, n_shingles, the columns of ``carry`` (longs) and component_id of every document; sets link when den * shared >= num * union."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("long").alias(c) for c in carry))
    longs = ", ".join(f"{c} long" for c in ("doc_id", "n_shingles", "d1", "d2", *carry, "token", "sets"))
    first = written(base.mapInArrow(_digest_batches(k, carry), f"{longs}, bits binary"))
    rows = first.where("token IS NULL").select("doc_id", "n_shingles", "d1", "d2", *carry)
    same = ["n_shingles", "d1", "d2"]
    classes = written(rows.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    members, n_classes = classes.agg(F.coalesce(F.sum("members"), F.lit(0)), F.count("rep")).first()
    hot = first.where("token IS NOT NULL").groupBy("token").agg(F.sum("sets").alias("sets")).orderBy(F.desc("sets"), "token").limit(HOT).toPandas().sort_values("token")
    table = docs.sparkSession.sparkContext.broadcast((hot["token"].to_numpy(np.int64), hot["sets"].to_numpy(np.int64)))

    reps = classes.where("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct()
    texts, prefix = base.select("doc_id", "text").where("doc_id IS NOT NULL"), _prefix_batches(k, num, den, table)
    if members - n_classes <= BROADCAST_IDS:  # the other members of classes are few: their texts are left out at once
        others = rows.where("n_shingles > 0").select("doc_id").join(reps, "doc_id", "left_anti")
        prefixes = texts.join(F.broadcast(others), "doc_id", "left_anti").mapInArrow(prefix, "doc long, nl long, tokens array<long>")
    else:
        prefixes = texts.mapInArrow(prefix, "doc long, nl long, tokens array<long>").join(reps.withColumnRenamed("doc_id", "doc"), "doc", "left_semi")
    by = W.partitionBy("token").orderBy("doc")
    lists = prefixes.select(F.explode("tokens").alias("token"), "doc", "nl").select("token", "doc", "nl", F.first("doc").over(by).alias("leader"), F.first("nl").over(by).alias("leader_nl"), F.lead("doc").over(by).alias("next"))
    shared = written(lists.where("leader < doc OR leader < next").drop("next"))

    similar, needed = _candidates(shared, "leader", "doc", num, den)
    near = shared.withColumnRenamed("nl", "doc_nl").where("leader < doc").where(similar).groupBy("leader", "leader_nl", "doc", "doc_nl").count()
    tried = written(near.where(2 * F.col("count") >= needed).select(F.col("leader").alias("a"), F.col("doc").alias("b")))
    linked = _verified(tried, base, k, num, den)

    comp = checkpointed_components(linked)
    comp = F.broadcast(comp) if comp.count() <= BROADCAST_IDS else comp
    every = W.partitionBy("token")
    placed = shared.select("token", "doc", "nl").join(comp, "doc", "left").withColumn("c", F.coalesce("c", "doc"))
    placed = placed.select("*", F.min("c").over(every).alias("lo"), F.max("c").over(every).alias("hi"), F.count("*").over(every).alias("members")).where("lo < hi")
    placed = placed.select("token", "doc", "nl", "c", F.ceil(F.col("members") / SIDE).cast("int").alias("parts"))
    held = W.partitionBy("doc").orderBy("token")
    beside = [F.coalesce(f("token", i + 1).over(held), "token").alias(name) for f, names in ((F.lag, BEFORE), (F.lead, BEHIND)) for i, name in enumerate(names)]
    placed = placed.repartition("doc").dropDuplicates(["doc", "token"]).select("*", *beside, F.row_number().over(held).cast("long").alias("pos"))
    bits = first.where("token IS NULL AND n_shingles > 0").select(F.col("doc_id").alias("doc"), "bits").join(reps.withColumnRenamed("doc_id", "doc"), "doc", "left_semi").dropDuplicates(["doc"])
    own = placed.join(bits, "doc").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    own = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    group = ["token", "lo", "hi"]
    own = own.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "doc", "nl", "c", "own", "pos", *BEFORE, *BEHIND, "bits").repartition(*group).sortWithinPartitions(*group)
    cross = own.mapInArrow(_list_batches(num, den), "x long, y long, x_nl long, y_nl long, shared long").groupBy("x", "y", "x_nl", "y_nl").agg(F.sum("shared").alias("shared"))
    cross = cross.where(F.col("shared") >= _candidates(cross, "x", "y", num, den)[1]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    more = _verified(written(cross.join(tried, ["a", "b"], "left_anti")), base, k, num, den)

    final = connected_components(linked.unionByName(more)).select(F.col("id").alias("rep"), "component")
    classes = written(classes.join(final, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"), "members"))
    found = lookup(rows.where("n_shingles > 0"), classes, same, "members", members).unionByName(rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    return found.select("doc_id", "n_shingles", *carry, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def checkpointed_components(links: DataFrame) -> DataFrame:
    """(doc, c) of every linked document."""
    return written(connected_components(links).select(F.col("id").alias("doc"), F.col("component").alias("c")))
