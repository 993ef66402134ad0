"""Toxicity after noisy-channel deobfuscation.

Words that look disguised (symbols or digits beside a letter, letters repeated three times or more, three signs or
more set apart by white space) become a lattice of characters: a symbol may stand for its letters, a separator for
nothing, a run of one letter for one or two of them, a space for a word's end or nothing. Viterbi decoding
finds the reading that is cheapest under the channel's costs and a character trigram language model, whose
counts come from all words of all documents, rare ones too. Restored words and their beginnings are then the features of
a logistic regression.

The classifier is fitted on at most ``max_labelled`` labelled rows (those with the smallest hashes of their
ids); rows held out by the caller never enter. Candidate features are words and beginnings of four to six
letters seen in at least ``MIN_TOXIC`` toxic rows of that sample; the ``FEATURES`` most telling ones are kept.

Defined cases: null and empty texts have no feature and score the fitted base rate of such texts; texts of any
length are read whole and words of any length are decoded, in linear time; of tokens with ``://`` the words between
their marks are taken, and tokens without a letter say nothing; repeated rows score alike;
without labels of both kinds every score is the smoothed share of toxic labels; an empty table gives an
empty result; of documents only doc_id and text are read, of labels only doc_id and toxic.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, frugal, take_over, texts, values

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_~'`^\"/\\:;,#=%&"
VOWELS = "aeiou"
MAX_LABELLED, MIN_TOXIC, FEATURES = 20_000, 4, 400
PREFIXES = (4, 5, 6)
LONG, FLUSH, CACHE = 64, 200_000, 400_000

#: Characters of the language model: the space and the lower-case letters below U+0180.
ALPHABET = " " + "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c == c.lower())
_PLACE = {c: i for i, c in enumerate(ALPHABET)}


def code(a: str, b: str, c: str) -> int:
    """Place of a trigram in the table of costs."""
    k = len(ALPHABET)
    return (_PLACE.get(a, k) * (k + 1) + _PLACE.get(b, k)) * (k + 1) + _PLACE.get(c, k)


_EDGE = ".,;:!?\"'()[]{}<>*-_"
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_TRIPLE = re.compile(r"(.)\1\1")


class Trigrams:
    """Costs of characters after two others, from the counts of trigrams by code; a space stands on either side of a word.

    Back-off runs from trigrams over bigrams to single characters. All costs fit in one table of len(ALPHABET) + 1 cubed
    numbers (some 8 MB), whatever the size of the corpus, so no trigram is left out; the last place of each axis is any
    other character.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        k = self.k = len(ALPHABET) + 1
        three = np.zeros(k**3)
        three[codes] = counts
        three = three.reshape(k, k, k)
        two = three.sum(0)
        one = (two.sum(0) + 0.5) / (two.sum() + 30)
        two = (two + 5 * one) / (two.sum(1)[:, None] + 5)
        three = (three + 5 * two) / (three.sum(2)[:, :, None] + 5)
        self.costs = array("f", (-np.log(three)).astype(np.float32).tobytes())

    def cost(self, a: str, b: str, c: str) -> float:
        return self.costs[code(a, b, c)]


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """Readings with channel costs for each stretch of one character."""
    for c, run in groupby(token):
        n = len(list(run))
        if c == " ":
            yield [("", 0.3), (" ", 1.5)]
        elif c == "*":
            yield [("", 1.0), *((v, 2.0) for v in VOWELS)]
        elif c in LEET:
            yield [(x * k, 1.0 + 0.2 * abs(n - k)) for x in LEET[c] for k in ((1, 2) if n > 1 else (1,))]
        elif c in SEPARATORS:
            yield [("", 0.5)]
        elif n == 1:
            yield [(c, 0.0)]
        else:
            yield [(c * 2, 0.3 * (n - 2)), (c, 1.0 if n == 2 else 0.3 * (n - 2))]


def _spoken(said: tuple) -> list[str]:
    parts = []
    while said:
        said, text = said
        parts.append(text)
    return parts[::-1]


def decode(token: str, lm: Trigrams) -> str:
    """Cheapest reading of a disguised token; the open paths are bounded by the pairs of last characters, so time is linear."""
    paths: dict[tuple[str, str], tuple[float, tuple]] = {(" ", " "): (0.0, ())}
    parts: list[str] = []
    for readings in lattice(token):
        new: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (a, b), (cost, said) in paths.items():
            for text, price in readings:
                x, y, total = a, b, cost + price
                for c in text:
                    if c == " " and y == " ":
                        continue
                    total += lm.cost(x, y, c)
                    x, y = y, c
                best = new.get((x, y))
                if best is None or total < best[0]:
                    new[x, y] = (total, (said, text) if text else said)
        paths = new
        if len(paths) == 1:  # all later readings share this beginning
            ((at, (cost, said)),) = paths.items()
            parts += _spoken(said)
            paths = {at: (cost, ())}
    said = min(paths.items(), key=lambda p: p[1][0] + lm.cost(*p[0], " "))[1][1]
    return "".join(parts + _spoken(said))


def restored(token: str, lm: Trigrams) -> list[str]:
    """Words that a lower-case token stands for."""
    bare = token.strip(_EDGE)
    if bare.isalpha():
        return [bare, decode(bare, lm)] if _TRIPLE.search(bare) else [bare]
    parts = [w for w in re.split(r"[^\w]+|_", bare) if w.isalpha()]
    if not any(map(str.isalpha, bare)) or "://" in bare:
        return parts
    # a mark at the end may be a letter or just a mark
    return list({w for t in {bare, token.strip(".,;:?\"'()[]{}")} for w in decode(t, lm).split()}.union(parts))


def features(words: list[str]) -> set[str]:
    out = set()
    for w in words:
        if len(w) > 1:
            out.add(w)
            out.update(w[:k] + "~" for k in PREFIXES if len(w) > k)
    return out


class Reader:
    """Features of texts, as numbers of a given table; tokens known to have none are remembered up to a bound."""

    def __init__(self, lm: Trigrams, table: dict[str, int] | None) -> None:
        take_over("toxicity")
        self.lm, self.table = lm, table
        self.dull: set[str] = set()
        self.telling: dict[str, frozenset] = {}

    def token(self, token: str) -> frozenset:
        got = features(restored(token, self.lm))
        if self.table is not None:
            got = {self.table[f] for f in got if f in self.table}
        return frozenset(got)

    def text(self, text: str | None) -> set:
        out: set = set()
        if not text:
            return out
        low = text.lower()
        for w in set(low.split()) - self.dull:
            got = self.telling.get(w)
            if got is None:
                got = self.token(w)
                if got:
                    if len(self.telling) >= CACHE // 4:
                        self.telling.clear()
                    self.telling[w] = got
                elif len(w) <= LONG:
                    if len(self.dull) >= CACHE:
                        self.dull.clear()
                    self.dull.add(w)
            out |= got
        for run in {m[0] for m in _SPACED.finditer(low)}:
            words = decode(" ".join(run.split()), self.lm).split()
            for f in features(words):
                if self.table is None:
                    out.add(f)
                elif f in self.table:
                    out.add(self.table[f])
        return out


def _grams(words: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        w = f"  {w} "
        for i in range(len(w) - 2):
            out[w[i : i + 3]] += n
    return out


@frugal
def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_over("toxicity")
    words, grams = Counter(), Counter()
    held = 0
    for b in batches:
        for text in texts(b):
            if text:
                new = text.lower().split()
                words.update(new)
                held += len(text) if len(text) > LONG * len(new) else 0  # very long words are counted at once
                if len(words) > FLUSH or held > LONG * FLUSH:
                    grams.update(_grams(_latin(words)))
                    words.clear()
                    held = 0
    grams.update(_grams(_latin(words)))
    yield pa.RecordBatch.from_arrays([pa.array([code(*g) for g in grams], pa.int64()), pa.array(list(grams.values()), pa.int64())], names=["code", "n"])


def _latin(words: Counter) -> Counter:
    """Words of letters of the alphabet, which bounds the number of trigrams."""
    out: Counter = Counter()
    for w, n in words.items():
        w = w.strip(_EDGE)
        if w.isalpha() and (w.isascii() or max(w) < "ƀ"):
            out[w] += n
    return out


def language_model(docs: DataFrame) -> Trigrams:
    """Fitted to every word of every document. What reaches the driver has at most len(ALPHABET) cubed rows of two numbers."""
    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_gram_batches, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return Trigrams(got["code"].to_numpy(), got["n"].to_numpy())


def _toxic_features(lm):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(lm.value, None), Counter()
        for b in batches:
            for text in texts(b):
                seen.update(reader.text(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    return run


def _feature_counts(lm, table):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(lm.value, table.value), (Counter(), Counter())
        for b in batches:
            for text, toxic in values(b, "text", "toxic"):
                seen[toxic].update(reader.text(text))
        keys = sorted({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([seen[0][k] for k in keys], pa.int64()), pa.array([seen[1][k] for k in keys], pa.int64())], names=["k", "clean", "bad"])

    return run


def _hit_batches(lm, table):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm.value, table.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([sorted(reader.text(t)) for t in texts(b)], pa.list_(pa.int32()))], names=["toxic", "hits"])

    return run


def _score_batches(lm, model, names: tuple):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights, bias = model.value
        reader = Reader(lm.value, table)
        for b in batches:
            z = np.array([bias + sum(weights[k] for k in reader.text(t)) for t in texts(b)])
            columns = {c: b.column(c) for c in names}
            yield pa.RecordBatch.from_pydict({**columns, "score": pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())})

    return run


def fit_logistic(hits: list[list[int]], toxic: np.ndarray, n: int, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the bias is not penalised."""
    x = np.zeros((len(hits), n + 1), np.float32)
    x[:, n] = 1
    for i, h in enumerate(hits):
        x[i, h] = 1
    w = np.zeros(n + 1)
    w[n] = math.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1))
    penalty = np.append(np.full(n, ridge), 1e-6)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (toxic - p) - penalty * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w[:n], float(w[n])


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, carry: tuple = ()) -> DataFrame:
    """doc_id, the columns of ``carry`` (text may be one of them) and score (0 to 1) of every document. labels: doc_id and toxic of the rows that may be learnt from."""
    sc = docs.sparkSession.sparkContext
    carry = tuple(c for c in carry if c != "doc_id")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"))
    lm = sc.broadcast(language_model(base))
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    some = some.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_labelled)
    sample = checkpoint(base.join(F.broadcast(some), "doc_id").select("text", "toxic").repartition(12))  # max_labelled ids at most
    candidates = sample.where("toxic = 1").mapInArrow(_toxic_features(lm), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TOXIC)
    names = [r["feature"] for r in candidates.orderBy(F.desc("n"), "feature").collect()]  # of the max_labelled rows of the sample
    table = {f: i for i, f in enumerate(names)}
    counts = sample.mapInArrow(_feature_counts(lm, sc.broadcast(table)), "k int, clean long, bad long").groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).toPandas()
    n_bad, n_all = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if n_bad and n_bad < n_all and len(counts):
        bad, clean = (counts["bad"].to_numpy() + 0.5) / (n_bad + 1), (counts["clean"].to_numpy() + 0.5) / (n_all - n_bad + 1)
        pool = (counts["bad"] + counts["clean"]).to_numpy() / n_all
        z = (bad - clean) / np.sqrt(pool * (1 - pool) * (1 / n_bad + 1 / (n_all - n_bad)) + 1e-9)
        telling = (bad > 2 * clean) & (z > 2.5)
        best = sorted(np.flatnonzero(telling), key=lambda i: (-z[i], names[counts["k"].iloc[i]]))[:FEATURES]
        table = {names[counts["k"].iloc[i]]: j for j, i in enumerate(best)}
        rows = sample.mapInArrow(_hit_batches(lm, sc.broadcast(table)), "toxic int, hits array<int>").collect()  # max_labelled rows of a few numbers
        weights, bias = fit_logistic([list(r["hits"]) for r in rows], np.array([r["toxic"] for r in rows], float), len(table))
    else:
        table, weights, bias = {}, np.zeros(0), math.log((n_bad + 1) / (n_all - n_bad + 1))
    model = sc.broadcast((table, weights.tolist(), bias))
    kept = base.select("doc_id", *carry)
    return base.mapInArrow(_score_batches(lm, model, tuple(kept.columns)), kept.schema.add("score", "double"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, carry: tuple = (), **limits) -> DataFrame:
    """doc_id, the columns of ``carry``, held_out, score and predicted; rows whose crc32(doc_id as text) mod 4 is 2 are held out of learning."""
    def held():
        return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))

    return score(docs, labels.where(~held()), carry=carry, **limits).select("doc_id", *(c for c in carry if c != "doc_id"), held().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
