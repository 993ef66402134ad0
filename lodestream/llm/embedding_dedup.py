"""Embedding near-dedup by spherical-cap filters from structured random product codes.

There are ``TABLES`` codes, each with a seeded rotation of its own: a rotated vector is split into four blocks with ``B``
random code words each, of equal length; a filter is one code word per block, its score the sum of the four inner products. List decoding returns every filter
whose score exceeds ``alpha``, by adding the sorted sums of two halves without visiting the B**4 filters one
by one; a vector that exceeds few gets its best ``LEAST`` ones. B grows with the fourth root of the input so
that lists stay short, and alpha is set so that a pair right at the threshold would miss all filters of one code with
probability 0.02, if its filters were independent, and those of all codes with 1e-5. Within a code they are not, between codes
they are nearly so: 0.98 or more of such pairs are found, with 64 and with 768 dimensions, and more of closer ones
(measured in the tests).

Vectors of one label and filter meet; lists over ``SIDE`` members are cut into blocks, and each pair of blocks
is a unit of work of its own. Cosines are computed in double precision by blocked products. A pair counts
only in the smallest filter that both share, so counts need no list of pairs; what leaves a task is one
count and one spanning link per member.

Defined cases: vectors that are null, zero, of another length than their partner, or hold null or non-finite
components, and rows with a null label, link with nothing; equal vectors of a label are one representative
with a multiplicity; a null vec_id has a null component and kept; labels of any type count as equal when their texts are;
an empty table gives an empty result; only vec_id, embedding and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lookup, written

TABLES, BLOCKS, LEAST, SIDE = 3, 4, 8, 256
#: Lists up to SMALL members share one product, PAIRS pairs at a time.
SMALL, PAIRS = 48, 20_000


def tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def plan_code(n: int, threshold: float, miss: float = 0.02) -> tuple[int, float]:
    """(B, alpha) for n vectors; miss: of one code."""
    b = max(24, math.ceil(n ** (1 / BLOCKS)))
    filters, alpha = float(b**BLOCKS), 6.0
    grid = np.linspace(0, 4, 400)
    while alpha > 1:
        weight = np.exp(-((alpha + grid) ** 2 - alpha**2) / 2)
        both = np.array([tail((alpha - threshold * (alpha + g)) / math.sqrt(1 - threshold**2)) for g in grid])
        p = float((weight * both).sum() / weight.sum())
        if filters * tail(alpha) * math.log1p(-p) <= math.log(miss):
            break
        alpha -= 0.02
    return b, alpha


class Code:
    """One product code for vectors of one length."""

    def __init__(self, dim: int, b: int, alpha: float, seed: int = 11) -> None:
        rng = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.linspace(0, dim, BLOCKS + 1).astype(int)
        words = [rng.standard_normal((b, hi - lo)) for lo, hi in zip(self.cuts, self.cuts[1:], strict=False)]
        self.words = [w * math.sqrt(w.shape[1]) / np.maximum(np.linalg.norm(w, axis=1), 1e-9)[:, None] for w in words]  # so that no filter takes in more than others
        self.b, self.alpha = b, alpha

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """Sorted filters of one unit vector."""
        y = self.turn @ unit
        s = [w @ y[lo:hi] for w, lo, hi in zip(self.words, self.cuts, self.cuts[1:], strict=False)]
        left, right = np.add.outer(s[0], s[1]).ravel(), np.add.outer(s[2], s[3]).ravel()
        by = np.argsort(-right)
        falling = right[by]
        alpha = self.alpha
        while True:
            some = np.flatnonzero(left >= alpha - falling[0])
            reach = np.searchsorted(-falling, left[some] - alpha, side="right")
            if reach.sum() >= LEAST or alpha < -50:
                break
            alpha -= 0.25
        out = np.concatenate([left_i * self.b**2 + by[:r] for left_i, r in zip(some.tolist(), reach.tolist(), strict=True)]) if len(some) else np.empty(0, np.int64)
        if alpha < self.alpha:  # the best LEAST only
            score = left[out // self.b**2] + right[out % self.b**2]
            out = out[np.argsort(-score, kind="stable")[:LEAST]]
        return np.sort(out.astype(np.int64))


def all_filters(codes: list[Code], unit: np.ndarray) -> np.ndarray:
    """Sorted filters of one unit vector in all codes, numbered through."""
    return np.concatenate([code.decode(unit) + k * code.b**BLOCKS for k, code in enumerate(codes)])


def all_codes(dim: int, b: int, alpha: float) -> list[Code]:
    return [Code(dim, b, alpha, 11 + k) for k in range(TABLES)]


def _unit(v) -> np.ndarray | None:
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.asarray(v, dtype=np.float64)
    size = float(np.sqrt(x @ x))
    return x / size if np.isfinite(x).all() and size > 0 and np.isfinite(size) else None


def _decode_batches(b: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[Code]] = {}
        for rows in batches:
            out = []
            for v in rows.column("embedding").to_pylist():
                u = _unit(v)
                if u is None:
                    out.append([])
                    continue
                out.append(all_filters(codes.get(len(u)) or codes.setdefault(len(u), all_codes(len(u), b, alpha)), u))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.list_(pa.int64()))], names=[*rows.schema.names, "filters"])

    return run


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows reaches through the links i - j."""
    i, j = np.concatenate((i, j)), np.concatenate((j, i))
    root = np.arange(n)
    while len(i):
        new = root.copy()
        np.minimum.at(new, i, root[j])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def compare(units: np.ndarray, filters: list[np.ndarray], own: int, copies: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links gained, a member of the same component) of each member in one list. side: members pair across 0 and 1 only; None: all pair."""
    n = len(units)
    close = units @ units.T >= threshold
    np.fill_diagonal(close, False)
    if side is not None:
        close &= side[:, None] != side[None, :]
    if close.any():
        at = np.flatnonzero(close.any(axis=1))
        kinds, flat = np.unique(np.concatenate([filters[i][filters[i] < own] for i in at]), return_inverse=True)
        if len(kinds):
            m = np.zeros((len(at), len(kinds)), np.float32)
            m[np.repeat(np.arange(len(at)), [int((filters[i] < own).sum()) for i in at]), flat] = 1
            close[np.ix_(at, at)] &= (m @ m.T) == 0  # pairs that already met in a smaller filter
    gained = close @ copies
    root = spanning(n, *np.nonzero(close))
    return gained, root


_OUT = pa.schema([("rep", pa.int64()), ("gained", pa.int64()), ("other", pa.int64())])
_KEY = ("label", "filter", "lo", "hi")


def _met_before(pairs: tuple[np.ndarray, np.ndarray], own: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a filter smaller than ``own``; row i's filters are flat[starts[i]:starts[i + 1]]."""
    keys = []
    for rows in pairs:
        n = np.diff(starts)[rows]
        pair = np.repeat(np.arange(len(rows)), n)
        f = flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[rows], n)]
        early = f < own[pair]
        keys.append(np.rec.fromarrays((pair[early], f[early]), names="p,f"))
    both = np.concatenate(keys)
    both = both[np.lexsort((both["f"], both["p"]))]
    twice = (both["p"][1:] == both["p"][:-1]) & (both["f"][1:] == both["f"][:-1])
    out = np.zeros(len(own), bool)
    out[both["p"][1:][twice]] = True
    return out


def small_lists(units: np.ndarray, sizes: np.ndarray, length: np.ndarray, side: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) inside consecutive lists of ``sizes`` rows; mixed lists pair across sides only."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    after = ends - np.arange(len(units)) - 1
    i = np.repeat(np.arange(len(units)), after)
    j = i + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
    ok = (length[i] == length[j]) & (~mixed[i] | (side[i] != side[j]))
    return i[ok], j[ok]


def _lists(x: dict, sizes: np.ndarray, threshold: float) -> pa.RecordBatch | None:
    """Links of complete lists. Lists up to SMALL are compared together, longer ones by a product of their own."""
    units, starts, flat = x["units"], x["starts"], x["flat"]
    mixed = x["lo"] < x["hi"]
    found: list[tuple] = []
    small = sizes <= SMALL
    at = np.flatnonzero(np.repeat(small, sizes))
    if len(at):
        i, j = small_lists(units[at], sizes[small], x["length"][at], x["side"][at], mixed[at])
        close = np.concatenate([np.einsum("nd,nd->n", units[at[i[k : k + PAIRS]]], units[at[j[k : k + PAIRS]]]) >= threshold for k in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0, bool)
        i, j = at[i[close]], at[j[close]]
        if len(i):
            new = ~np.concatenate([_met_before((i[k : k + PAIRS], j[k : k + PAIRS]), x["filter"][i[k : k + PAIRS]], flat, starts) for k in range(0, len(i), PAIRS)])
            i, j = i[new], j[new]
        if len(i):
            gained = np.bincount(i, x["copies"][j], len(units)) + np.bincount(j, x["copies"][i], len(units))
            found.append((gained.astype(np.int64), spanning(len(units), i, j)))
    for a, b in zip(np.cumsum(sizes)[~small] - sizes[~small], np.cumsum(sizes)[~small], strict=True):
        for d in np.unique(x["length"][a:b]):
            rows = a + np.flatnonzero(x["length"][a:b] == d)
            gained, root = compare(units[rows], [flat[starts[r] : starts[r + 1]] for r in rows], int(x["filter"][a]), x["copies"][rows], x["side"][rows] if mixed[a] else None, threshold)
            if gained.any():
                all_gained, all_root = np.zeros(len(units), np.int64), np.arange(len(units))
                all_gained[rows], all_root[rows] = gained, rows[root]
                found.append((all_gained, all_root))
    if not found:
        return None
    parts = [(np.flatnonzero(g), g, r) for g, r in found]
    columns = [np.concatenate(c) for c in ([x["rep"][k] for k, _, _ in parts], [g[k] for k, g, _ in parts], [x["rep"][r[k]] for k, _, r in parts])]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_OUT)


def _columns(b: pa.RecordBatch) -> dict:
    """The rows as arrays; vectors shorter than the longest are padded with zeros."""
    x = {k: b.column(k).to_numpy(zero_copy_only=False) for k in (*_KEY, "rep", "copies", "side")}
    vectors, filters = b.column("embedding"), b.column("filters")
    x["length"] = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    units = np.zeros((b.num_rows, int(x["length"].max())))
    units[np.arange(units.shape[1]) < x["length"][:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    x["units"] = units / np.sqrt(np.einsum("nd,nd->n", units, units))[:, None]
    x["flat"] = filters.flatten().to_numpy(zero_copy_only=False)
    x["starts"] = np.concatenate(([0], np.cumsum(filters.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    return x


def _cut(x: dict, a: int, b: int) -> dict:
    out = {k: v[a:b] for k, v in x.items() if k not in ("flat", "starts")}
    return out | {"flat": x["flat"][x["starts"][a] : x["starts"][b]], "starts": x["starts"][a : b + 1] - x["starts"][a]}


def _joined(x: dict, y: dict) -> dict:
    wide = max(x["units"].shape[1], y["units"].shape[1])
    out = {k: np.concatenate((x[k], y[k])) for k in x if k not in ("starts", "units")}
    out["units"] = np.concatenate([np.pad(z["units"], ((0, 0), (0, wide - z["units"].shape[1]))) for z in (x, y)])
    return out | {"starts": np.concatenate((x["starts"], y["starts"][1:] + x["starts"][-1]))}


def _list_batches(threshold: float):
    """Runs of equal (label, filter, lo, hi) in sorted rows; a run may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x = _columns(b) if held is None else _joined(held, _columns(b))
            n = len(x["rep"])
            new = np.zeros(n - 1, bool)
            for k in _KEY:
                new |= x[k][1:] != x[k][:-1]
            edges = np.concatenate(([0], np.flatnonzero(new) + 1))
            if edges[-1] and (out := _lists(_cut(x, 0, edges[-1]), np.diff(edges), threshold)) is not None:
                yield out
            held = _cut(x, edges[-1], n)
        if held is not None and (out := _lists(held, np.array([len(held["rep"])]), threshold)) is not None:
            yield out

    return run


def dedup(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    number = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{number}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    usable = base.where(good)
    reps = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    total, n = base.agg(F.count_if(good), F.count("*")).first()
    b, alpha = plan_code(max(1, n), threshold)
    reps = written(reps.mapInArrow(_decode_batches(b, alpha), f"label string, embedding array<{number}>, rep long, copies long, filters array<long>"))

    keys = reps.select("label", "rep", F.explode("filters").alias("filter"))
    lists = keys.groupBy("label", "filter").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / SIDE).cast("int")).drop("count")
    keys = keys.join(lists, ["label", "filter"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    keys = keys.select("label", "filter", "rep", "own", other).select("label", "filter", "rep", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    work = keys.join(reps.select("rep", "copies", "embedding", "filters"), "rep")
    group = ["label", "filter", "lo", "hi"]
    met = written(work.repartition(*group).sortWithinPartitions(*group).mapInArrow(_list_batches(threshold), "rep long, gained long, other long"))

    links = met.groupBy("rep").agg(F.sum("gained").alias("gained"))
    comp = connected_components(met.select(F.col("rep").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("rep"), "component")
    known = reps.select("label", "embedding", "rep", "copies").join(links, "rep", "left").join(comp, "rep", "left")
    known = known.select("label", "embedding", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("gained", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "copies")
    known = written(known)
    out = lookup(usable, known, ["label", "embedding"], "copies", total).select("vec_id", "n_links", "component_id")
    out = out.unionByName(base.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"))
