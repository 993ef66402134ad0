"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import filter_audit, hard_negatives, suffix_dedup

CLASH = "doc_id long, text string, source string, tag string, spans string, home int, part string, own int, first boolean, good int"


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)] + ["naïve", "日本語", "x"]
    passages = [" ".join(rng.choices(words, k=40)) for _ in range(8)]
    rows = [(None, passages[0]), (1, None), (2, ""), (3, "a" * 500), (4, "a" * 49), (5, "a" * 50), (6, "ab" * 100)]
    for i in range(50):
        t = " ".join(rng.choices(words, k=rng.randint(5, 120)))
        for _ in range(rng.randint(0, 3)):
            p, a = rng.choice(passages), rng.randint(0, 60)
            t += " " + p[a : a + rng.randint(20, 150)] + " " + " ".join(rng.choices(words, k=5))
        rows.append((100 - i, t))
    rows.append((99, " ".join(rng.choices(words, k=20000)) + passages[1]))
    return rows + [(7, rows[20][1]), (7, rows[21][1]), (7, rows[21][1]), (200, rows[20][1])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "t", "s", 1, "p", 2, True, 3) for d, t in rows], CLASH)


def removed(rows, length):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1 if d is not None else 0):
            first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        yield d, len(b), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("length", "limit"), [(50, suffix_dedup.LIMIT), (20, suffix_dedup.LIMIT), (50, 3000)])
def test_repeated_bytes(spark, length, limit):
    got = suffix_dedup.dedup(frame(spark, texts()).repartition(3), length, limit)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(removed(texts(), length), key=str)


def test_no_texts_no_rows(spark):
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in suffix_dedup.dedup(frame(spark, [(1, None)])).collect()] == [(1, 0, 0, 0)]


@pytest.mark.parametrize("shard", [100, 1000, 1 << 20])
def test_merged_transforms_find_every_first_window(monkeypatch, shard):
    """Shards of one string up to one shard of all; what is merged equals a dictionary of all windows."""
    rng = np.random.default_rng(shard)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    base, strings = [bytes(rng.integers(97, 101, 120, dtype=np.uint8)) for _ in range(6)], []
    for _ in range(300):
        x, s = bytearray(base[rng.integers(6)]), rng.integers(0, 28)
        x = x[s : s + rng.integers(50, 93)]
        if rng.random() < 0.5:
            x[rng.integers(len(x))] = 120
        strings.append(bytes(x))
    size, least = np.array([len(x) for x in strings]), rng.integers(0, 1000, len(strings))
    rows = suffix_dedup.gathered(np.frombuffer(b"".join(strings), np.uint8), np.r_[0, np.cumsum(size)[:-1]], size, suffix_dedup.width(50))
    first = {}
    for x, d in zip(strings, least, strict=True):
        for i in range(len(x) - 49):
            first[x[i : i + 50]] = min(d, first.get(x[i : i + 50], d))
    got = suffix_dedup.first_docs(rows, size, least, 50)
    assert all(got[k, i] == first[x[i : i + 50]] for k, x in enumerate(strings) for i in range(len(x) - 49))


def test_transform_of_a_shard_walks_back_through_its_strings():
    strings = [b"banana" * 9, b"ananas" * 10, b"mississippi" * 5]
    size = np.array([len(x) for x in strings])
    shard = suffix_dedup.Shard(suffix_dedup.gathered(np.frombuffer(b"".join(strings), np.uint8), np.r_[0, np.cumsum(size)[:-1]], size, 104), size, 50)
    for k, x in enumerate(strings):
        rank, back = int(np.flatnonzero(shard.suffix == k * 104 + len(x))[0]), b""
        while shard.lf[rank] >= 0:
            back, rank = bytes([shard.bwt[rank]]) + back, int(shard.lf[rank])
        assert back == x
    suffixes = [strings[s // 104][s % 104 :] + b"\xff" * 60 for s in shard.suffix]
    assert [s[:50] for s in suffixes] == sorted(s[:50] for s in suffixes)


def audited(rows, labels):
    good, toxic = ({d for d, q, t in labels if x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    first, out = {}, []
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    fails = []
    for d, t, s in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = "A" * (len(w) < 200) + "B" * (2 * len(set(w)) < len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + "D" * any(c in "#$%&*|" for c in t) + "E" * (d is not None and first[t] < d)
        fails.append((s or "", f, d in good and d is not None, d in toxic and d is not None))
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        table = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, x in enumerate(order):
                gone = [f for f in left if x in f[0]]
                left = [f for f in left if x not in f[0]]
                shapley[x] += len(gone)
                again = [f for f in mine if x in f[0] and set(f[0]) & set(order[:k])]
                table.append([part, order, k + 1, len(left), len(gone), len(again), sum(f[0] == x for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone)])
        out += [tuple(r + [shapley[r[1][r[2] - 1]]]) for r in table]
    return out


def test_audit(spark):
    rng = random.Random(2)
    long = " ".join(f"w{i}" for i in range(250))
    base = [None, "", " \t", "one", "AB cd", "a # b", "a " * 250, long, long + " $", long.upper(), "naïve É " * 120, "W " * 30000]
    rows = [(i, rng.choice(base), rng.choice([None, "", "s1", "s2"])) for i in range(60)] + [(None, "one", "s1"), (None, None, None), (3, long, "s1"), (3, long, "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", True, 9) for r in rows], "doc_id long, text string, source string, mask int, digest string, good boolean, n int")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, said)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(audited(rows, labels))
    assert filter_audit.audit(docs.where("false"), said).count() == 0
    assert filter_audit.audit(docs, said.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def mined(rows):
    rows = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    one = {}
    for i, l, v in rows:
        one[i] = min(one.get(i, (l, v)), (l, v))
    for a, (label, v) in one.items():
        if a % 10:
            continue
        score = {i: sum(int(x) * int(y) for x, y in zip(v, w, strict=True)) for i, (_, w) in one.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if one[i][0] == label][:5]:
            fit = [i for i in order if one[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            yield from ((a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:5]))


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many cells, blocks, groups and leaves
        for name, value in (("BLOCK_ROWS", 16), ("SAMPLE", 128), ("LEAF", 4), ("ANCHOR_LEAF", 2)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    centers = rng.integers(-60, 60, (6, 12))
    rows = [(i, int(rng.integers(0, 4)), (centers[rng.integers(6)] + rng.integers(-9, 10, 12)).astype(float).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, rows[7][2]) for i in range(40)]  # ties
    rows += [(500, None, rows[0][2]), (510, 1, None), (520, 1, [None] * 12), (530, 1, [float("nan")] * 12), (540, 1, []), (None, 1, rows[0][2]), (550, 2, [1.0, 2.0]), (551, 2, [2.0, 2.0]), (552, 3, [1.0, 2.0]), (560, 9, rows[0][2])]
    rows += [rows[10], (10, 0, rows[11][2]), (570, 3, [0.0] * 12)]
    vectors = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], "vec_id long, label int, embedding array<double>, cell int, home int, block string")
    got = hard_negatives.mine(vectors.repartition(3), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows))
    assert hard_negatives.mine(vectors.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_intervals_hold_all_products():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 50, (70, 9)).round(), rng.normal(9, 40, (300, 9)).round()
    ta, tb = hard_negatives.Tree(a, a, 8), hard_negatives.Tree(b, b, 16)
    for i in range(len(ta.start)):
        for j in range(len(tb.start)):
            s = a[ta.items(i)] @ b[tb.items(j)].T
            low, high = hard_negatives.interval(ta, i, tb, j)
            assert low <= s.min() and s.max() <= high
    top = 0.9 * (a @ b.T).max()
    met = {(x, y) for i, j in hard_negatives.leaf_pairs(ta, tb, lambda i, j, low, high: high >= top) for x in ta.items(i) for y in tb.items(j)}
    assert {(x, y) for x, y in zip(*np.nonzero(a @ b.T >= top), strict=True)} <= met and len(met) < 70 * 300


def test_near_copies_write_few_rows_for_many_shared_tokens():
    """Pairs that share up to 40 listed tokens write few rows, whose sum bounds what they share from above."""
    import numpy as np
    import pyarrow as pa

    from lodestream.llm import ngram_join as nj

    rng = np.random.default_rng(1)
    sets = {d: np.sort(rng.permutation(40)[:n]) for d, n in ((1, 40), (2, 36), (3, 30), (4, 3))}
    rows = []
    for d, s in sets.items():
        for i, t in enumerate(s.tolist()):
            near = [[int(s[i + k * step]) if 0 <= i + k * step < len(s) else t for k in range(1, nj.BESIDE + 1)] for step in (-1, 1)]
            rows.append({"token": t, "lo": 0, "hi": 0, "doc": d, "nl": 200 * nj.NL + 1, "c": d, "own": 0, "pos": i + 1, "bits": bytes(nj.BITS // 8)} | dict(zip(nj.BEFORE, near[0])) | dict(zip(nj.BEHIND, near[1])))
    rows.sort(key=lambda r: r["token"])
    batches = [pa.RecordBatch.from_pylist(rows[:50]), pa.RecordBatch.from_pylist(rows[50:])]
    out = [r for b in nj._list_batches(80, 100)(iter(batches)) for r in b.to_pylist()]
    pairs = [(a, b) for a in sets for b in sets if a < b]
    for a, b in pairs:
        told = [r["shared"] for r in out if (r["x"], r["y"]) == (a, b)]
        shared = len(np.intersect1d(sets[a], sets[b]))
        assert (sum(told) >= shared and told) if shared else not told
        assert len(told) <= 6 < shared or shared <= 3
    assert len(out) <= 6 * len(pairs)
