"""Helpers of the operators, the decoder and the sizes of shards against brute force."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np

from lodestream.llm import common, sharding, toxicity


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HUBS_FROM", 1)
    monkeypatch.setattr(common, "HEAVY", 5)
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (300, 301), (301, 300)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_of_heavy_light_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 5)
    keys = ["big"] * 50 + ["small"] * 3 + [None] * 20 + ["absent"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k string")
    table = spark.createDataFrame([("big", 1, 50), ("small", 2, 3)], "k string, v long, n long")
    got = {r.i: r.v for r in common.lookup(rows, table, ["k"], "n", 74).collect()}
    assert got == {i: {"big": 1, "small": 2}[k] for i, k in enumerate(keys) if k in ("big", "small")}


def test_decoder_finds_the_cheapest_of_all_readings():
    words = "idiot idiot loser stupid moron the and there other trash clown".split() * 50
    grams = toxicity._grams(Counter(words))
    lm = toxicity.Trigrams(np.array([toxicity.code(*g) for g in grams]), np.array(list(grams.values())))
    for token in ("1d10t", "l0s3r", "mooron", "m o r", "s-t.u", "tr@$h", "*diot", "1!1"):
        prices = {}
        for path in itertools.product(*toxicity.lattice(token)):
            a, b, said, cost = " ", " ", "", 0.0
            for part, price in path:
                cost += price
                for c in part:
                    if c == " " and b == " ":
                        continue
                    cost += lm.cost(a, b, c)
                    a, b = b, c
                said += part
            cost += lm.cost(a, b, " ")
            prices[said] = min(cost, prices.get(said, 1e9))
        assert prices[toxicity.decode(token, lm)] <= min(prices.values()) + 1e-6, token


def test_sizes_and_sums_of_shards(spark):
    texts = [None, "", "é", "a" * 5000, "a" * 5000, *(f"text {i}" for i in range(200))]
    rows = spark.createDataFrame([(i, t, "x", 9) for i, t in enumerate(texts)], "doc_id long, text string, bundle string, bytes int")
    got = {r.doc_id: r for r in sharding.shard(rows, 3).collect()}
    assert {i: (got[i]["size"], got[i].text_crc32) for i in got} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    assert got[0].shard == got[1].shard and sorted(got) == list(range(len(texts)))
