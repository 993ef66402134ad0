"""A seed list judged field by field in one pass: every rule it breaks, with its row, and counts that are observed on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.opened import kind, once, opened, part, string
from .desk import CATEGORIES

#: Fields by what they must hold.
TEXTS = ("id", "name", "homepage", "region", "lang", "owner", "ownershipNote", "verifBasis", "lastReviewedAt", "familyId", "addedBy")
OPTIONAL = ("feedUrl", "country", "partyOf", "lastFetchAt", "lastSuccessAt", "backoffUntil", "notes")
FLAGS, WHOLE = ("isParty", "isPrimary", "paywalled", "fetchFulltext", "enabled"), ("intervalMin", "consecFails", "corrections")
CHOICES = {"adapter": ("rss", "jsonfeed", "gdelt", "mastodon", "bluesky", "telegramweb"), "category": CATEGORIES, "verifStatus": ("verified", "pending", "unverified"), "health": ("ok", "degraded", "failing", "disabled", "unknown")}
FIELDS = (*TEXTS, *OPTIONAL, *FLAGS, *WHOLE, *CHOICES, "config")
#: What the adapters that need no feed are configured by: all keys, and those they must have.
CONFIG = {"gdelt": (("query", "timespan"), ("query",)), "mastodon": (("instance", "acct"), ("instance", "acct")), "bluesky": (("actor",), ("actor",)), "telegramweb": (("channel",), ("channel",))}
NAME, URL, PLACE = "^[a-z0-9][a-z0-9-]*$", r"^https?://[^\s/?#@]+([/?#]\S*)?$", "{RSSHUB}"
TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"


def _text(v: Column, key: str) -> Column:
    """A field that is a string with something in it, else null."""
    return F.nullif(F.trim(string(v, key)), F.lit(""))


def _absent(v: Column, key: str) -> Column:
    x = part(v, key)
    return x.isNull() | F.is_variant_null(x)


def _flag(v: Column, key: str) -> Column:
    return F.when(kind(part(v, key), "BOOLEAN"), F.try_variant_get(v, f"$.{key}", "boolean"))


def _whole(v: Column, key: str) -> Column:
    x = part(v, key)
    return F.when(kind(x, "BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, f"$.{key}", "bigint"))


def rules(v: Column) -> dict[str, Column]:
    """Name of each rule and whether a seed ``v`` (VARIANT, an object) breaks it. Rules on how fields go together ask only of fields that are right by themselves."""
    held = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    known = F.array(*map(F.lit, FIELDS))
    out = {"fields missing": F.size(F.array_except(known, held)) > 0, "fields unknown": F.size(F.array_except(held, known)) > 0}
    out |= {k: _text(v, k).isNull() for k in TEXTS} | {k: ~_absent(v, k) & _text(v, k).isNull() for k in OPTIONAL}
    out |= {k: _flag(v, k).isNull() for k in FLAGS} | {k: _whole(v, k).isNull() for k in WHOLE}
    out |= {k: ~F.coalesce(_text(v, k).isin(*values), F.lit(False)) for k, values in CHOICES.items()}
    config, feed, adapter = part(v, "config"), _text(v, "feedUrl"), _text(v, "adapter")
    entries = F.try_variant_get(config, "$", "map<string, variant>")
    out["config"] = ~_absent(v, "config") & ~(kind(config, "OBJECT") & F.coalesce(F.forall(F.map_values(entries), lambda x: kind(x, "STRING") & (F.trim(F.try_variant_get(x, "$", "string")) != "")), F.lit(False)))
    url = lambda s: F.regexp_replace(s, r"^\{RSSHUB\}/", "https://rsshub.example/")
    out |= {"id form": ~_text(v, "id").rlike(NAME), "familyId form": ~_text(v, "familyId").rlike(NAME), "homepage form": ~_text(v, "homepage").rlike(URL), "feedUrl form": ~url(feed).rlike(URL)}
    at = _text(v, "lastReviewedAt")
    out["lastReviewedAt form"] = ~(at.rlike(TIME) & F.try_to_timestamp(at).isNotNull())
    out |= {"country form": ~_text(v, "country").rlike("^[a-z]{2}$"), "interval range": ~_whole(v, "intervalMin").between(5, 1440), "not verified": _text(v, "verifStatus") != "verified"}
    out["party"] = _flag(v, "isParty") == _absent(v, "partyOf")
    out["times set"] = ~(_absent(v, "lastFetchAt") & _absent(v, "lastSuccessAt") & _absent(v, "backoffUntil"))
    out["counts set"] = (_whole(v, "consecFails") != 0) | (_whole(v, "corrections") != 0)
    out["health at start"] = _text(v, "health") != F.when(_flag(v, "enabled"), "unknown").otherwise("disabled")
    out["placeholder enabled"] = F.startswith(feed, F.lit(PLACE)) & _flag(v, "enabled")
    fed, bare, none = adapter.isin("rss", "jsonfeed"), adapter.isin(*CONFIG), _absent(v, "config")
    out |= {"feed needed": fed & _absent(v, "feedUrl"), "feed with config": fed & kind(config, "OBJECT"), "config with feed": bare & ~_absent(v, "feedUrl"), "config needed": bare & none}
    for name, (every, must) in CONFIG.items():
        mine = (adapter == name) & ~none
        out[f"{name} config"] = mine & ((F.size(F.array_except(F.map_keys(entries), F.array(*map(F.lit, every)))) > 0) | F.array_contains(F.array(*(_text(config, k).isNull() for k in must)), F.lit(True)))
    out["gdelt timespan"] = (adapter == "gdelt") & ~_text(config, "timespan").rlike(r"(?i)^\d+[mhd]$")
    out["mastodon instance"] = (adapter == "mastodon") & ~_text(config, "instance").rlike(URL)
    out["telegram channel"] = (adapter == "telegramweb") & ~_text(config, "channel").rlike("^[A-Za-z0-9_]{5,}$")
    return {k: F.coalesce(c, F.lit(False)) for k, c in out.items()}


def judged(raw: DataFrame, watch: Observation | None = None) -> DataFrame:
    """``raw`` (seed: JSON text) with the names of the rules it breaks (faults); ``watch`` observes how often each was broken, of how many rows."""

    def broken(v: Column) -> Column:
        return F.when(v.isNull(), F.array(F.lit("not an object"))).otherwise(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules(v).items()))))

    out = raw.withColumn("faults", once(opened(F.col("seed"), 1), broken))
    if watch is None:
        return out
    names = ["not an object", *rules(F.lit(None).cast("variant"))]
    return out.observe(watch, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("faults") > 0).alias("bad"), *(F.count_if(F.array_contains("faults", k)).alias(k) for k in names))
