"""JSON of unknown shape, opened as far as it goes: types are asked before values are taken, and what does not fit falls back.

Everything is a Column expression over VARIANT values. Text that holds JSON as a JSON string, once or twice over, is opened
too. Broken JSON, JSON that is no object, and JSON wrapped more often give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 3


def once(v: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(v), use), F.lit(0))


def kind(v: Column, *names: str) -> Column:
    """Whether a VARIANT is of one of these types, such as STRING or OBJECT; false for null."""
    said = F.schema_of_variant(v)
    out = F.lit(False)
    for name in names:
        out = out | F.startswith(said, F.lit(name))
    return F.coalesce(out, F.lit(False))


def opened(s: Column, levels: int = LEVELS) -> Column:
    """The object in a text, parsed ``levels`` times at most while it is still a string."""
    v = F.try_parse_json(s)
    for _ in range(levels - 1):
        v = once(v, lambda x: F.when(kind(x, "STRING"), F.try_parse_json(F.variant_get(x, "$", "string"))).otherwise(x))
    return once(v, lambda x: F.when(kind(x, "OBJECT"), x))


def part(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def string(v: Column, key: str, otherwise: str | None = "") -> Column:
    """A field that is a string, else ``otherwise``; a number is none."""
    return once(part(v, key), lambda x: F.when(kind(x, "STRING"), F.variant_get(x, "$", "string")).otherwise(F.lit(otherwise).cast("string")))


def number(v: Column, key: str) -> Column:
    x = part(v, key)
    return F.when(kind(x, "BIGINT", "DECIMAL", "DOUBLE", "INT", "SMALLINT", "TINYINT", "FLOAT"), F.variant_get(x, "$", "double"))


def record(v: Column, key: str) -> Column:
    x = part(v, key)
    return F.when(kind(x, "OBJECT"), x)


def records(v: Column, key: str) -> Column:
    """The objects in a list; other members, and what is no list, count as none."""
    return F.filter(F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>")), lambda x: kind(x, "OBJECT"))


def claim_items(v: Column, key: str) -> Column:
    return F.transform(records(v, key), lambda x: F.struct(string(x, "text").alias("text"), string(x, "claimId").alias("claim_id"), F.transform(records(x, "citations"), lambda c: F.to_json(c)).alias("citations")))


def summary(v: Column) -> Column:
    """An event's summary with every field of its type: one_liner, confirmed, statements, unverified, disputed and why; null for null."""
    return once(v, _summary)


def _summary(v: Column) -> Column:
    statements = F.transform(
        records(v, "statements"),
        lambda g: F.struct(
            string(g, "party", "unknown").alias("party"),
            F.transform(records(g, "items"), lambda x: F.struct(string(x, "text").alias("text"), string(x, "status", "reported").alias("status"), string(x, "claimId").alias("claim_id"), F.transform(records(x, "citations"), lambda c: F.to_json(c)).alias("citations"))).alias("items"),
        ),
    )
    disputed = F.transform(
        records(v, "disputed"),
        lambda g: F.struct(
            string(g, "topic", "unnamed").alias("topic"),
            F.transform(records(g, "positions"), lambda x: F.struct(string(x, "party", "unknown").alias("party"), string(x, "text").alias("text"), number(x, "number").alias("number"), string(x, "asOf", None).alias("as_of"), F.to_json(record(x, "citation")).alias("citation"))).alias("positions"),
        ),
    )
    w = record(v, "whyItMatters")
    why = F.when(kind(part(w, "text"), "STRING"), F.struct(string(w, "text").alias("text"), F.when(string(w, "generatedBy") == "ai", "ai").otherwise("rule").alias("by")))
    return F.when(v.isNotNull(), F.struct(string(v, "oneLiner").alias("one_liner"), claim_items(v, "confirmed").alias("confirmed"), statements.alias("statements"), claim_items(v, "unverified").alias("unverified"), disputed.alias("disputed"), why.alias("why")))
