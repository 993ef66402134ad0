"""Verdicts on all claims of events: evidence by family, the ladder of statuses, replaced figures and figures in conflict.

One plan runs all parts. Figures of one event and unit that exclude each other are found without pairing them: a source keeps its
latest figures only, so a row of the sweep is a source with its least and greatest figure of each kind of bound, and
the least and greatest of all other sources within reach of time decide whether a figure is contradicted. The sweep
is running values over time slices, so an event of any length is many tasks and a slice with many sources costs no square.

claims: claim_id, event_id, kind, claimed_by, claimed_by_kind, party, number (not negative), unit, qualifier, at (seconds), correction, superseded_by.
evidence: claim_id, article_id, stance, family_key, wire_family, reprint_of, source_id, source_family_id, source_family_kind, domain, has_primary, is_party.
A claim without a time is neither replaced nor compared; a claim without evidence has no chains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How far apart in time and how different figures must be to contradict each other; width of an estimate.
HOURS, RELATIVE, ABSOLUTE, ABOUT = 48, 0.1, 1, 0.15
#: Kinds of families that make one chain, claimants whose reports prove nothing, statements' kind.
OWNED, PARTIES, SAID = ("ownership", "wire"), ("party", "military"), "statement"


def families(evidence: DataFrame) -> DataFrame:
    """``evidence`` with the family that counts as one chain: a copy belongs to its root, and the root to its copies."""
    # a copy names its root by a row of its own, so that evidence is shuffled once, by claim, and all that follows stays in its place
    names = F.when(F.col("reprint_of").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = evidence.withColumn("names", F.explode(names)).repartition("claim_id").withColumn("named", F.when(F.col("names"), F.col("reprint_of")).otherwise(F.col("article_id")))
    rows = rows.withColumn("is_root", F.bool_or("names").over(W.partitionBy("claim_id", "named"))).where("NOT names").drop("names", "named")
    wire = F.when(F.startswith("wire_family", F.lit("wire:")) | F.startswith("wire_family", F.lit("reprint:")), F.col("wire_family")).otherwise(F.concat(F.lit("wire:"), "wire_family"))
    told = lambda name, *parts: F.concat(F.lit(f"{name}:"), *(F.col(p).cast("string") for p in parts))
    owned = F.when(F.col("source_family_kind").isin(*OWNED), told("family", "source_family_id"))
    root = F.when(F.col("is_root"), told("reprint", "article_id"))
    family = F.coalesce("family_key", wire, told("reprint", "reprint_of"), root, owned, told("source", "source_id"), told("domain", "domain"), told("article", "article_id"))
    return rows.withColumn("family", family)


def ladder(least: int = 2) -> Column:
    """Status by the families of each stance (supports, reports, disputes, refutes) and by what is first-hand."""
    s, r, d, x = (F.col(c) for c in ("supports", "reports", "disputes", "refutes"))
    party = F.col("party").isNotNull() | F.coalesce(F.col("claimed_by_kind").isin(*PARTIES), F.lit(False))
    statement = F.when(F.col("primary_support") | (s >= least), "corroborated").when(s > 0, "partially_corroborated").otherwise("reported")
    return (
        F.when(F.col("superseded_by").isNotNull(), "outdated").when((d > 0) | ((x > 0) & (s + r > 0)), "disputed").when((x >= 2) | F.col("primary_refutation"), "refuted").when(x == 1, "disputed")
        .when(F.col("kind") == SAID, statement).when(s >= least, "corroborated").when(s == 1, "partially_corroborated").when(r > 0, F.when(party, "unverified").otherwise("reported")).otherwise("unverified")
    )


def judged(claims: DataFrame, evidence: DataFrame, least: int = 2) -> DataFrame:
    """``claims`` with the families of each stance, chains, has_primary, has_refutation and status."""
    is_, own = lambda x: F.col("stance") == x, F.coalesce("is_party", F.lit(False))
    # one row a family first, so that families are counted by flags; what a party supports itself counts by the claim's kind, which is known behind the sums
    told = {"supports": is_("supports") & ~own, "party": is_("supports") & own, "reports": is_("reports"), "disputes": is_("disputes"), "refutes": is_("refutes")}
    first = {"proved": told["supports"] & F.col("has_primary"), "proved_by_party": told["party"] & F.col("has_primary"), "primary_refutation": told["refutes"] & F.col("has_primary")}
    per = families(evidence).groupBy("claim_id", "family").agg(*(F.coalesce(F.bool_or(x), F.lit(False)).alias(name) for name, x in (told | first).items()))
    n = lambda *x: F.count_if(F.col("family").isNotNull() & reduce(lambda a, b: a | b, (F.col(c) for c in x)))
    sums = {"supports": ("supports",), "all_supports": ("supports", "party"), "reports": ("reports",), "all_reports": ("reports", "party"), "disputes": ("disputes",), "refutes": ("refutes",), "chains": ("supports", "party", "reports")}
    got = per.groupBy("claim_id").agg(*(n(*x).alias(name) for name, x in sums.items()), *(F.bool_or(name).alias(name) for name in first))
    fact = F.coalesce(F.col("kind") != SAID, F.lit(False))
    j = claims.join(got, "claim_id", "left").withColumns({
        "supports": F.when(fact, F.col("supports")).otherwise(F.col("all_supports")), "reports": F.when(fact, F.col("all_reports")).otherwise(F.col("reports")),
        "primary_support": F.when(fact, F.col("proved")).otherwise(F.col("proved") | F.col("proved_by_party")),
    }).drop("all_supports", "all_reports", "proved", "proved_by_party")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("supports", "reports", "disputes", "refutes", "chains")} | {c: F.coalesce(c, F.lit(False)) for c in ("primary_support", "primary_refutation")})
    return j.withColumns({"status": ladder(least), "has_refutation": F.col("refutes") > 0}).withColumnRenamed("primary_support", "has_primary")


def bounds(number: Column, qualifier: Column) -> tuple[Column, Column]:
    """Least and greatest value that a figure allows."""
    low = F.when(qualifier == "up_to", 0.0).when(qualifier == "about", number * (1 - ABOUT)).otherwise(number.cast("double"))
    high = F.when(qualifier.isin("at_least", "more_than"), float("inf")).when(qualifier == "about", number * (1 + ABOUT)).otherwise(number.cast("double"))
    return low, high


def figures(claims: DataFrame) -> DataFrame:
    """Comparable figures of victims with their source's key."""
    actor = F.coalesce(F.concat(F.lit("actor:"), F.lower("claimed_by")), F.concat(F.lit("party:"), "party"), F.concat(F.lit("claim:"), F.col("claim_id").cast("string")))
    low, high = bounds(F.col("number"), F.col("qualifier"))
    return claims.where("kind = 'casualty' AND number IS NOT NULL AND unit <> '' AND at IS NOT NULL").select("claim_id", "event_id", "unit", "number", "qualifier", "at", "correction", actor.alias("actor"), low.alias("low"), high.alias("high"))


def latest_of_each(figs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(figures of each source's last time, figures that the only one of that time replaces, with by)."""
    group = ["event_id", "unit", "actor"]
    last = figs.groupBy(*group).agg(F.max("at").alias("last"))
    j = figs.join(last, group)
    active = j.where("at = last").drop("last")
    only = active.groupBy(*group).agg(F.count("*").alias("n"), F.min("claim_id").alias("by"), F.min("number").alias("now"), F.bool_or(F.coalesce("correction", F.lit(False))).alias("corrects")).where("n = 1")
    older = j.where("at < last").join(only, group).where("number <> now OR corrects")
    return active, older.select("claim_id", "by")


def contradicted(active: DataFrame, hours: int = HOURS, relative: float = RELATIVE, absolute: float = ABSOLUTE) -> DataFrame:
    """Figures (claim_id, event_id, unit, actor, number) that a figure of another source within ``hours`` excludes."""
    reach, group = hours * 3600, ["event_id", "unit"]
    closed, guess, open_ = F.col("qualifier").isin("exact", "up_to"), F.col("qualifier") == "about", F.col("qualifier").isin("exact", "at_least", "more_than")
    kinds = {"least": (F.min, closed), "least_about": (F.min, guess), "most": (F.max, open_), "most_about": (F.max, guess)}
    known = F.coalesce("qualifier", F.lit("exact"))
    sources = active.withColumn("qualifier", known).groupBy(*group, "actor", "at").agg(*(f(F.when(test, F.col("number"))).alias(name) for name, (f, test) in kinds.items()))
    # a slice is as wide as the reach, so what a source reaches is its own slice without itself, the end of the slice before and the
    # start of the next: running values in both directions, taken at the source and where its reach ends, cost the same for any number of sources
    own, k = F.floor(F.col("at") / reach), F.col("k")
    swept = sources.withColumn("k", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumns({"slice": own + k, "place": F.col("at") + k * reach, "asked": k != 0})
    swept = swept.select(*group, "actor", "k", "slice", "place", "asked", *(F.when(k == 0, F.col(name)).alias(name) for name in kinds))
    w = W.partitionBy(*group, "slice")
    before, after = (w.orderBy(*order).rowsBetween(W.unboundedPreceding, -1) for order in (("place", "asked", "actor"), (F.desc("place"), "asked", F.desc("actor"))))
    ends = swept.select(*group, "actor", *(f(F.col(name)).over(over).alias(f"{name}{i}") for name, (f, _) in kinds.items() for i, over in enumerate((before, after))), "k")
    pick = {F.min: F.least, F.max: F.greatest}
    others = ends.groupBy(*group, "actor").agg(*(f(pick[f](F.when(k >= 0, F.col(f"{name}0")), F.when(k <= 0, F.col(f"{name}1")))).alias(name) for name, (f, _) in kinds.items()))
    j = active.join(others, [*group, "actor"])
    v = F.col("number")

    def below(other: str, factor: float) -> Column:
        x = F.col(other)
        return (x * factor < F.col("low")) & (v - x > absolute) & ((v - x) / F.greatest(F.lit(1.0), v.cast("double")) > relative)

    def above(other: str, factor: float) -> Column:
        x = F.col(other)
        return (x * factor > F.col("high")) & (x - v > absolute) & ((x - v) / F.greatest(F.lit(1.0), x.cast("double")) > relative)

    tests = [below("least", 1.0), below("least_about", 1 + ABOUT), above("most", 1.0), above("most_about", 1 - ABOUT)]
    return j.where(reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests))).select("claim_id", *group, "actor", "number")


def disputes(claims: DataFrame) -> DataFrame:
    """Per event and unit with contradicting figures: how many, of how many sources, and the least and greatest."""
    found = contradicted(latest_of_each(figures(claims))[0])
    return found.groupBy("event_id", "unit").agg(F.count("*").alias("claims"), F.count_distinct("actor").alias("sources"), F.min("number").alias("least"), F.max("number").alias("greatest"))


def verified(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, event_id, status, superseded_by, chains, has_primary and has_refutation of every claim after all parts."""
    active, older = latest_of_each(figures(claims))
    found = contradicted(active).select("claim_id", F.lit(True).alias("contradicted"))
    j = judged(claims, evidence).join(older, "claim_id", "left").join(found, "claim_id", "left")
    status = F.when(F.col("by").isNotNull(), "outdated").when(F.col("contradicted"), "disputed").otherwise(F.col("status"))
    return j.select("claim_id", "event_id", status.alias("status"), F.coalesce("by", "superseded_by").alias("superseded_by"), "chains", "has_primary", "has_refutation")
