"""Repeated byte strings across documents, from merged Burrows-Wheeler transforms of shards.

Every window of ``length`` bytes has an anchor, the ANCHOR bytes in it with the smallest hash, so that equal windows have
equal anchors. Neighbouring windows of one anchor are one short string; strings go to the bucket of their anchor, where
all equal windows of the table meet and nothing else must. Equal strings are one string with several places, in a chunk of
documents already before the shuffle.

In a bucket, strings that share enough of their anchor's surroundings with a different string are dealt into shards of
SHARD bytes, and each shard is transformed by itself: its suffixes in the order of their first bytes, their transform and the places where
neighbours share ``length`` bytes. The transforms are then merged by refining their interleave: beginning with one
shard after the other, each round moves every place of the interleave to its predecessor, grouped by the symbol read from
the shard's transform, so that after h rounds suffixes stand in the order of their first h bytes. Shards are never
sorted together. A block whose members come from one shard is settled and leaves. After ``length`` rounds a block is
an interval of suffixes with that many bytes in common: the smallest doc_id in it is where the string starts first.

Memory is bounded by CHUNK and BUCKET; a bucket beyond LIMIT, as of an anchor that a third of all documents hold in different
surroundings, is not held: its windows become rows of their own with a hash of 128 bits, are summed by hash before the
shuffle, and look up the smallest doc_id, heavy ones by broadcast.

Defined cases: a null text is empty; texts shorter than ``length`` stay whole; broken UTF-8 is made valid first; rows with a null doc_id stay whole
and count for nothing; rows that repeat a doc_id do not count against each other, and each is judged by its own text; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, lookup, take_over, written

ANCHOR = 8
CHUNK, BUCKET, LIMIT, SHARD, SLICE, HOME = 16 << 20, 16 << 20, 96 << 20, 128 << 10, 128 << 10, 64 << 20
END = 0xFF  # never a byte of UTF-8
NONE = np.iinfo(np.int64).max
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]  # odd multipliers
MERGED = "home int, blob binary, h1 long, h2 long, doc_id long, tag long, start long"


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[k]
    return x ^ (x >> np.uint64(29))


def row_hash(rows: np.ndarray, k: int = 0) -> np.ndarray:
    """64-bit hash of each row of bytes; rows are as long as a multiple of eight."""
    h = np.zeros(len(rows), np.uint64)
    for column in np.ascontiguousarray(rows).view(np.uint64).T:
        h = mixed(h ^ (column * MIX[(k + 1) % 4]), k)
    return h


def eight(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number; the last seven places are read with zeros behind them."""
    x = np.append(a, np.zeros(7, np.uint8)).astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchored(a: np.ndarray, good: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, number of windows and place of the anchor of each string of ``a``; ``good`` says where a window may start."""
    w, out = length - ANCHOR + 1, []
    for s in range(0, len(a) - length + 1, SLICE):
        e = min(s + SLICE, len(a) - length + 1)
        x = eight(a[s : e + length - 1])[: e - s + w - 1]
        x = (mixed(x, 0) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64)
        at = (sliding_min(x, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ok = good[s:e]
        change = np.r_[True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])]
        first = np.flatnonzero(change)
        count = np.diff(np.r_[first, len(at)])
        keep = ok[first]
        out.append((first[keep] + s, count[keep], at[first[keep]] + s))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


#: By the number of bytes that count in a word of eight, END in all others.
PAD = np.array([(1 << 64) - (1 << 8 * k) for k in range(8)] + [0], np.uint64)


def gathered(a: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The bytes from each start in rows of ``width``, a multiple of eight, padded by END."""
    a = np.append(a, np.full(width, END, np.uint8))
    rows = np.lib.stride_tricks.sliding_window_view(a, width)[start]
    words = rows.view(np.uint64)
    for k in range(width // 8):
        if (short := size < 8 * k + 8).any():
            words[short, k] |= PAD[np.maximum(size[short] - 8 * k, 0)]
    return rows


def grouped(rows: np.ndarray, *first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and where groups of equal ones begin in it."""
    h = row_hash(rows)
    order = np.lexsort((h, *first)) if first else np.argsort(h)
    new = h[order][1:] != h[order][:-1]
    twins = np.flatnonzero(~new) + 1
    new[twins - 1] = (rows[order[twins]] != rows[order[twins - 1]]).any(1)
    for x in first:
        new |= x[order][1:] != x[order][:-1]
    return order, np.r_[True, new][: len(order)]


# a piece: the strings of a bucket in a chunk of documents and where each stands


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def packed(kinds: str, *arrays: np.ndarray) -> bytes:
    head = np.array([len(x) for x in arrays], "<i8").tobytes()
    raw = head + b"".join(planes(x.astype(k)) for k, x in zip(kinds.split(), arrays, strict=True))
    return np.array([len(raw)], "<i8").tobytes() + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def raw_size(piece: bytes) -> int:
    return int(np.frombuffer(piece, "<i8", 1)[0])


def unpacked(kinds: str, piece: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(piece[8:], raw_size(piece), asbytes=True)
    types, at, out = [np.dtype(k) for k in kinds.split()], 0, []
    sizes, at = np.frombuffer(raw, "<i8", len(types)), 8 * len(types)
    for t, n in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n).T).reshape(-1).view(t))
        at += n * t.itemsize
    return out


#: bytes, sizes and anchors of strings, number of places of each; doc_id, tag and start of places. Spans: doc_id, tag, start, end.
PIECE, SPANS = "u1 <u2 <u2 <u4 <i8 <u4 <u4", "<i8 <u4 <u4 <u4"


def width(length: int) -> int:
    """Of a string at most, in whole words of eight bytes with room for one more."""
    return (2 * length - ANCHOR) // 8 * 8 + 16


def _cutting(length: int, buckets: int):
    """(bucket, piece) of the strings of each chunk of documents."""

    def cut(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, sizes, ids, tags = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.cumsum(sizes)
        good = np.ones(len(a) + 1, bool)  # the last windows of a document have no room
        good[np.maximum((ends - sizes)[:, None], ends[:, None] - np.arange(1, length)) * (sizes > 0)[:, None] + len(a) * (sizes == 0)[:, None]] = False
        start, count, at = anchored(a, good, length)
        if not len(start):
            return
        size = count + length - 1
        bucket = (mixed(gathered(a, at, np.full(len(at), ANCHOR), ANCHOR).view(np.uint64)[:, 0], 2) >> np.uint64(16)).astype(np.int64) % buckets
        doc = np.searchsorted(ends, start, side="right")
        order, lead = grouped(gathered(a, start, size, width(length)), bucket)
        start, size, at, bucket, doc = start[order], size[order], at[order], bucket[order], doc[order]
        head = np.flatnonzero(lead)
        places = np.diff(np.r_[head, len(start)])
        edges = np.flatnonzero(np.r_[True, bucket[head][1:] != bucket[head][:-1], True])
        which, pieces = [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            s, p = head[lo:hi], slice(head[lo], head[hi] if hi < len(head) else len(start))
            flat = np.repeat(start[s] - np.r_[0, np.cumsum(size[s])[:-1]], size[s]) + np.arange(size[s].sum())
            which.append(bucket[s[0]])
            pieces.append(packed(PIECE, a[flat], size[s], (at - start)[s], places[lo:hi], ids[doc[p]], tags[doc[p]], start[p] - (ends - sizes)[doc[p]]))
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(pieces, pa.binary())], ["bucket", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("suffix_dedup")
        held, n = [], 0
        for b in batches:
            body = b.column("body").cast(pa.large_binary())
            offsets = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, 8 * body.offset)
            data = np.frombuffer(body.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            held.append((data.copy(), np.diff(offsets), b.column("doc_id").to_numpy(), b.column("tag").to_numpy()))
            n += len(data)
            if n >= CHUNK:
                yield from cut(held)
                held, n = [], 0
        if n:
            yield from cut(held)

    return run


# transforms of shards and their merging


class Shard:
    """Transform of a few strings: ``bwt`` symbol and predecessor ``lf`` of every suffix in their order, and its first block of ``length`` equal bytes."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, length: int) -> None:
        n, w = rows.shape
        real = (np.arange(w) <= size[:, None]).reshape(-1)  # a suffix begins at each byte and at the end mark
        at = np.flatnonzero(real)
        column, end = at % w, np.repeat(size, size + 1)
        key, depth, ranks = eight(rows.reshape(-1))[at], 8, {}  # every row ends in eight end marks at least
        while True:
            order = np.argsort(key)
            new = np.r_[False, key[order][1:] != key[order][:-1]]
            rank = np.empty(len(at), np.int64)
            rank[order] = np.cumsum(new)
            ranks[depth] = rank
            if depth >= length:
                break
            table = np.zeros(n * w + 2 * w, np.int64)
            table[at] = rank
            behind = np.where(column + depth <= end, table[at + depth], rank.max())  # all that lies behind an end mark is alike
            key, depth = rank * (len(at) + 1) + behind, 2 * depth
        place = np.full(n * w, -1, np.int64)
        place[at[order]] = np.arange(len(at))
        before = np.where(column > 0, at - 1, 0)
        self.bwt = np.where(column > 0, rows.reshape(-1)[before], END).astype(np.uint8)[order]
        self.lf = np.where(column > 0, place[before], -1)[order]
        self.suffix = at[order]
        # windows of equal ``length`` bytes: two overlapping words of a power of two
        step = 1 << (length.bit_length() - 1)
        table = np.full(n * w + w, 0, np.int64)
        table[at] = ranks[step]
        self.window = np.flatnonzero(self.suffix % w + length <= size[self.suffix // w])  # ranks of suffixes with room for a window
        pair = table[self.suffix[self.window]] * (len(at) + 1) + table[self.suffix[self.window] + length - step]
        self.block = np.cumsum(np.r_[True, pair[1:] != pair[:-1]][: len(pair)]) - 1


def merged_blocks(shards: list[Shard], length: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of a shard, numbered through all shards; block of the merged transform) for blocks that several shards hold."""
    sizes = np.array([len(s.bwt) for s in shards])
    base = np.r_[0, np.cumsum(sizes)]
    blocks = np.r_[0, np.cumsum([s.block[-1] + 1 if len(s.block) else 0 for s in shards])]
    bwt = np.concatenate([s.bwt for s in shards])
    lf = np.concatenate([np.where(s.lf >= 0, s.lf + b, -1) for s, b in zip(shards, base, strict=False)])
    shard_of = np.repeat(np.arange(len(shards), dtype=np.uint16 if len(shards) < 1 << 16 else np.int64), sizes)
    # one window stands for its shard's block; the interleave begins at the suffix ``length`` bytes on, shard after shard
    own, z = np.full(base[-1], -1, np.int64), []
    for k, s in enumerate(shards):
        if len(s.block):
            lead = np.flatnonzero(np.r_[True, s.block[1:] != s.block[:-1]])
            own[s.window[lead] + base[k]] = s.block[lead] + blocks[k]
            rank = np.full(s.suffix.max() + length + 1, -1, np.int64)
            rank[s.suffix] = np.arange(len(s.suffix))
            z.append(np.sort(rank[s.suffix[s.window[lead]] + length]) + base[k])
    z = np.concatenate(z) if z else np.zeros(0, np.int64)
    head = np.arange(len(z)) == 0
    for h in range(length):
        block = np.cumsum(head) - 1
        order = np.argsort(bwt[z], kind="stable")  # counting by symbol keeps the order before
        symbol, block, z = bwt[z][order], block[order], lf[z[order]]
        head = np.r_[True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])][: len(z)]
        if h % 4 == 3 or h == length - 1:  # blocks of one shard are settled
            first = np.flatnonzero(head)
            if len(first):
                of = shard_of[z]
                several = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
                keep = np.repeat(several, np.diff(np.r_[first, len(z)]))
                z, head = z[keep], head[keep]
    return own[z], np.cumsum(head) - 1


def first_docs(rows: np.ndarray, size: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each string and each of its windows the smallest doc_id of any string that holds the window; ``least``: of the string itself."""
    n, w = rows.shape
    out = np.repeat(least[:, None], length - ANCHOR + 1, axis=1)
    edges = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(size) // SHARD])) if n else []
    cuts = [*map(int, edges), n]
    shards = [(lo, Shard(rows[lo:hi], size[lo:hi], length)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo]
    shards = [(lo, s) for lo, s in shards if len(s.block)]
    if not shards:
        return out
    offset = np.r_[0, np.cumsum([s.block[-1] + 1 for _, s in shards])]
    string = np.concatenate([s.suffix[s.window] // w + lo for lo, s in shards])
    column = np.concatenate([s.suffix[s.window] % w for _, s in shards])
    block = np.concatenate([s.block + o for (_, s), o in zip(shards, offset, strict=False)])
    low = np.full(offset[-1], NONE, np.int64)
    np.minimum.at(low, block, least[string])
    if len(shards) > 1:
        own, met = merged_blocks([s for _, s in shards], length, w)
        if len(own):
            best = np.minimum.reduceat(low[own], np.flatnonzero(np.r_[True, met[1:] != met[:-1]]))
            low[own] = best[met]
    out[string, column] = low[block]
    return out


def alive(rows: np.ndarray, size: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Strings that may share a window with a different one: the window holds the anchor and half of the rest on one side of it."""
    half = (length - ANCHOR) // 2
    reach = (ANCHOR + half + 7) // 8 * 8
    live = np.zeros(len(rows), bool)
    flat = rows.reshape(-1)
    for first, room in ((at, size - at >= ANCHOR + half), (at - half, at >= half)):
        them = np.flatnonzero(room)
        h = row_hash(gathered(flat, them * rows.shape[1] + first[them], np.full(len(them), ANCHOR + half), reach))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        live[them[order[np.r_[same, False][: len(order)] | np.r_[False, same][: len(order)]]]] = True
    return live


def spans_of(rows: np.ndarray, size: np.ndarray, at: np.ndarray, string: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, first byte, end) of all bytes of a bucket's places that an earlier document holds too. ``string``: of each place."""
    least = np.full(len(rows), NONE, np.int64)
    np.minimum.at(least, string, doc)
    live = alive(rows, size, at, length)
    whole = np.flatnonzero(~live[string] & (least[string] < doc))
    out = [(whole, start[whole], start[whole] + size[string[whole]])]
    if live.any():
        docs = first_docs(rows[live], size[live], least[live], length)
        number = np.cumsum(live) - 1
        them = np.flatnonzero(live[string])
        for lo in range(0, len(them), 1 << 16):
            part = them[lo : lo + (1 << 16)]
            hit = (docs[number[string[part]]] < doc[part, None]) & (np.arange(docs.shape[1]) + length <= size[string[part], None])
            edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            (p, first), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            out.append((part[p], start[part[p]] + first, start[part[p]] + end - 1 + length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _merging(length: int, homes: int, limit: int):
    """Spans of each bucket, a row for each home of documents; a bucket beyond ``limit`` gives its windows instead."""
    w = width(length)

    def strings(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        body, size, at, places, doc, tag, start = (np.concatenate(x) for x in zip(*(unpacked(PIECE, p) for p in pieces), strict=True))
        size, at = size.astype(np.int64), at.astype(np.int64)
        rows = gathered(body, np.r_[0, np.cumsum(size)[:-1]], size, w)
        return rows, size, at, np.repeat(np.arange(len(size)), places), doc, tag, start.astype(np.int64)

    def solved(pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows, size, at, string, doc, tag, start = strings(pieces)
        order, lead = grouped(rows)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(lead) - 1
        head = order[lead]
        place, first, end = spans_of(rows[head], size[head], at[head], number[string], doc, start, length)
        home = home_of(doc[place], homes)
        order = np.lexsort((first, doc[place], home))
        place, first, end, home = place[order], first[order], end[order], home[order]
        edges = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True][: len(home) + 1]) if len(home) else []
        blobs = [packed(SPANS, doc[place[lo:hi]], tag[place[lo:hi]], first[lo:hi], end[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        if blobs:
            yield record(home=pa.array(home[edges[:-1]], pa.int32()), blob=pa.array(blobs, pa.binary()))

    def windows(piece: bytes) -> Iterator[pa.RecordBatch]:
        rows, size, _, string, doc, tag, start = strings([piece])
        for k in range(length - ANCHOR + 1):
            place = np.flatnonzero(size[string] >= k + length)
            if len(place):
                them, of = np.unique(string[place], return_inverse=True)
                window = gathered(rows.reshape(-1), them * w + k, np.full(len(them), length), (length + 7) // 8 * 8)
                h1, h2 = (row_hash(window, s)[of].view(np.int64) for s in (1, 3))
                yield record(h1=pa.array(h1), h2=pa.array(h2), doc_id=pa.array(doc[place]), tag=pa.array(tag[place].astype(np.int64)), start=pa.array(start[place] + k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("suffix_dedup")
        now, held, n, over = None, [], 0, False
        for b in batches:
            for bucket, piece in zip(b.column("bucket").to_pylist(), b.column("piece"), strict=True):
                if bucket != now:
                    if held:
                        yield from solved(held)
                    now, held, n, over = bucket, [], 0, False
                held.append(piece.as_py())
                n += raw_size(held[-1])
                if over or n > limit:
                    over = True
                    for p in held:
                        yield from windows(p)
                    held = []
        if held:
            yield from solved(held)

    return run


def home_of(doc: np.ndarray, homes: int) -> np.ndarray:
    return (mixed(doc.view(np.uint64), 3) >> np.uint64(20)).astype(np.int64) % homes


def record(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"home": pa.int32(), "blob": pa.binary()}
    names = [x.split()[0] for x in MERGED.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kinds.get(c, pa.int64()))) for c in names], names)


def _gathering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each document in their order, joined where they meet, from the blobs of a home."""
    now, held = None, []

    def joined() -> Iterator[pa.RecordBatch]:
        doc, tag, first, end = (np.concatenate(x) for x in zip(*(unpacked(SPANS, p) for p in held), strict=True))
        order = np.lexsort((first, tag, doc))
        doc, tag, first, end = doc[order], tag[order], first[order].astype(np.int64), end[order].astype(np.int64)
        new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
        # ends of a document lie above all ends of those before it, so that one running maximum serves all
        lift = (np.cumsum(new) - 1) << 33
        reach = np.maximum.accumulate(end + lift)
        begin = new | np.r_[True, (first + lift)[1:] > reach[:-1]]
        at = np.flatnonzero(begin)
        last = np.r_[at[1:] - 1, len(doc) - 1]
        spans = np.column_stack((first[at], reach[last] - lift[last]))
        heads = np.flatnonzero(new[at])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[2 * heads, 2 * len(spans)], pa.int32()), pa.array(spans.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[at[heads]]), pa.array(tag[at[heads]].astype(np.int64)), lists], ["doc_id", "tag", "spans"])

    for b in batches:
        for home, blob in zip(b.column("home").to_pylist(), b.column("blob"), strict=True):
            if home != now and held:
                yield from joined()
                held = []
            now = home
            held.append(blob.as_py())
    if held:
        yield from joined()


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text once its spans are cut out. ``spans``: lists of first and end, several lists where buckets were not held."""
    for b in batches:
        out = []
        for doc, body, lists in zip(b.column("doc_id").to_pylist(), b.column("body"), b.column("spans").to_pylist(), strict=True):
            text, left, at, n, runs = memoryview(body.as_buffer()), hashlib.sha256(), 0, 0, 0
            reach = -1
            for lo, hi in sorted((x[k], x[k + 1]) for x in lists or () for k in range(0, len(x), 2)):
                runs += lo > reach
                if lo > at:
                    left.update(text[at:lo])
                n += max(0, hi - max(lo, at))
                at, reach = max(at, hi), max(reach, hi)
            left.update(text[at:])
            out.append((doc, len(text), n, runs, left.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spans(rows: DataFrame, length: int, total: int, limit: int = LIMIT) -> DataFrame:
    """doc_id, tag and spans of every row of ``rows`` (doc_id, tag, body; ``total`` bytes) that loses bytes."""
    buckets, homes = max(8, int(total * (1 + 2 * length / (length - ANCHOR + 2))) // BUCKET), max(8, total // HOME)
    pieces = rows.where("doc_id IS NOT NULL").mapInArrow(frugal(_cutting(length, buckets)), "bucket int, piece binary")
    met = written(pieces.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_merging(length, homes, limit)), MERGED))
    found = met.where("home IS NOT NULL").select("home", "blob").repartition(homes, "home").sortWithinPartitions("home").mapInArrow(_gathering, "doc_id long, tag long, spans array<long>")
    # windows of buckets that were not held
    over = met.where("home IS NULL").select("h1", "h2", "doc_id", "tag", "start")
    if n := over.count():
        first = over.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        late = lookup(over, written(first), ["h1", "h2"], "n", n).where("first < doc_id")
        found = found.unionByName(late.select("doc_id", "tag", F.array("start", F.col("start") + length).alias("spans")))
    return found.groupBy("doc_id", "tag").agg(F.collect_list("spans").alias("spans"))


def dedup(docs: DataFrame, length: int = 50, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    doc_id = F.col("doc_id").cast("long")
    total, n, different = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(doc_id), F.count_distinct(doc_id)).first()
    rows = docs.select(doc_id.alias("doc_id"), F.make_valid_utf8(F.coalesce(F.col("text"), F.lit(""))).cast("binary").alias("body"))
    # only where an id repeats must its rows be told apart
    rows = rows.withColumn("tag", F.lit(0).cast("long") if n == different else F.crc32("body"))
    found = spans(rows, length, total, limit)
    return rows.join(found, ["doc_id", "tag"], "left").select("doc_id", "body", "spans").mapInArrow(frugal(_removing), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
