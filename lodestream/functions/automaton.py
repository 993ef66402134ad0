"""Many fixed phrases in one pass over each text: an automaton of all aliases, keywords and marks, whose cost does not grow with their number.

The automaton is built once a task from the table of phrases, which is a parameter and no data. A phrase of ASCII letters
and digits at its ends must stand as a word of its own; occurrences of one phrase do not overlap, as a regular
expression counts them. Texts are folded by expressions before they come here.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

FOUND = "array<struct<slug: string, count: bigint>>"
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: Phrases by which a text speaks to a machine; parts of a phrase are alternatives, "" leaves one out.
SPOKEN = (
    (("ignore ",), ("", "all ", "the ", "any "), ("previous ", "above ", "prior "), ("instructions", "prompts")),
    (("disregard ",), ("", "all ", "the "), ("previous ", "above ")),
    (("you are now",),), (("act as ",), ("a ", "an ", "the ")), (("system",), ("", " "), ("prompt",)),
    (("忽略",), ("之前", "以上", "前面", "上述"), ("", "的"), ("指令", "提示", "要求")), (("执行",), ("", "以下"), ("命令", "指令")),
    (("读取", "发送", "泄露", "输出"), ("", "你的"), ("环境变量", "密钥", "apikey", "api key", "token", "系统提示")),
    (("<",), ("", " "), ("system", "assistant", "tool", "function"), (" ", ">")),
)


def spoken() -> list[str]:
    """All phrases of SPOKEN."""
    return ["".join(p) for parts in SPOKEN for p in product(*parts)]


def _scan(phrases: dict[str, list[str]], bounded: bool, most: int, per_phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        slugs: dict[str, list[str]] = {}
        for slug, those in phrases.items():
            for p in those:
                slugs.setdefault(p.lower(), []).append(slug)
        for p, whose in slugs.items():
            machine.add_word(p, (p, whose, bounded and p.isascii()))
        machine.make_automaton()
        for b in batches:
            out = []
            for hay in b.column("hay").to_pylist():
                n, last = Counter(), {}
                for end, (p, _, alone) in machine.iter(hay or ""):
                    start = end - len(p) + 1
                    if start <= last.get(p, -1) or (alone and (hay[start - 1 : start] in WORD or hay[end + 1 : end + 2] in WORD)):
                        continue
                    last[p] = end
                    n[p] += 1
                sums = Counter()
                for p, k in n.items():
                    for slug in slugs[p]:
                        sums[slug] += min(k, per_phrase)
                out.append([{"slug": s, "count": k} for s, k in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:most]])
            kind = pa.list_(pa.struct([("slug", pa.string()), ("count", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "hay"), pa.array(out, kind)], [*(c for c in b.schema.names if c != "hay"), "found"])

    return run


def found(rows: DataFrame, hay: Column, phrases: dict[str, list[str]], bounded: bool = True, most: int = 12, per_phrase: int = 50) -> DataFrame:
    """``rows`` with found: the slugs whose phrases occur in ``hay``, most often first, then by name. Null and empty texts hold nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("hay", hay).mapInArrow(_scan(phrases, bounded, most, per_phrase), f"{schema}, found {FOUND}")


def names(rows: DataFrame, s: Column, table: dict[str, list[str]], most: int = 12) -> DataFrame:
    """As functions.tagging.entities, for tables of any length."""
    return found(rows, text.fold_width(s), table, most=most)


def speaks_to_machines(rows: DataFrame, s: Column) -> DataFrame:
    """``rows`` with injected: whether a text holds a phrase of SPOKEN, whatever its case and its white space; whole texts are read."""
    flat = F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " "))
    got = found(rows, flat, {"injected": spoken()}, bounded=False, most=1)
    return got.withColumn("injected", F.size("found") > 0).drop("found")
