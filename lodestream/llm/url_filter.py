"""URL filters: explicit rules, then a path-template tree per host; DataFrame functions only.

Explicit rules come first; the longest that fits decides. Every other url is decided by its host's tree of
path templates. Segments that look variable (they hold a digit, or are longer than 32 characters) become the
wildcard ``*``. A branch that has labels keeps its name in the tree, at any depth; where a path leaves the labelled branches
its segments become ``REST``, which no label can reach, so that a template is rejected only on
labels of its own branches. Templates that are equal but for their last named segment, have fewer than ``min_labels`` labels,
and whose blocked share does not differ from their common one (at 1.96 standard errors) are merged, so that many small branches
of one kind count together. A template is
rejected when its smoothed labelled purity (blocked + m * prior) / (labelled + m), the prior being its host's own smoothed share, is at least
``min_purity`` and it has ``min_labels`` labels. Urls that an explicit rule decides are the labels when
none are given: nothing else is known about pages.

Defined cases: a null url, or one without ``://``, has empty host and path and is allowed; repeated rows are
judged one by one; paths of any depth are read whole; an empty table gives
an empty result; only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, written

#: The explicit rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names of branches without labels and of merged ones; a path holds no question mark, so no segment bears them.
REST, MERGED = "*?", "*?~"
#: What stands before the last named segment of a template, that segment, and the wildcards behind it.
LAST = r"(?s)^(.*)/([^/*][^/]*)((?:/\*[^/]*)*)$"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    first = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(first, r"^([^/?#]*)", 1)
    path = F.regexp_extract(first, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def explicit(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """Segments with variable ones generalised."""
    all_of = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(all_of, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > 32), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))


def template_tree(shapes: DataFrame) -> DataFrame:
    """host, segments, urls, labelled, blocked and template for each shape; shapes: host, segments, urls, labelled, blocked (one row a shape)."""
    size = F.size("segments")
    upto = F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice("segments", F.lit(1), i), "/"))
    steps = shapes.where(size > 0).select("host", "segments", "labelled", F.posexplode(upto).alias("at", "prefix"))
    branches = written(steps.groupBy("host", "prefix").agg(F.sum("labelled").alias("n"), F.count("*").alias("shapes")))
    total = branches.agg(F.coalesce(F.sum("shapes"), F.lit(0))).first()[0]
    reached = lookup(steps, branches.where("n > 0").drop("n"), ["host", "prefix"], "shapes", total).groupBy("host", "segments").agg((F.max("at") + 1).alias("known"))
    tree = shapes.join(reached, ["host", "segments"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    names = F.concat(F.slice("segments", F.lit(1), F.col("known")), F.array_repeat(F.lit(REST), size - F.col("known")))
    return tree.withColumn("template", F.array_join(F.transform(names, lambda s: F.concat(F.lit("/"), s)), "")).drop("known")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: tuple = RULES, min_purity: float = 0.8, min_labels: int = 20, m: float = 10.0) -> DataFrame:
    """page_id, host, path, rule, template and verdict of every url. labels: page_id, blocked (0 or 1), unique by page_id."""
    host, path = parts(F.col("url").cast("string"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "said": verdict, "segments": shape(F.col("path"))})
    if labels is None:
        known = base.withColumn("blocked", F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("long")))
    else:
        known = base.join(labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("blocked").cast("long").alias("blocked")).where("page_id IS NOT NULL").dropDuplicates(["page_id"]), "page_id", "left")
    shapes = written(known.groupBy("host", "segments").agg(F.count("*").alias("urls"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")))
    tree = written(template_tree(shapes))
    nodes = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("k"))
    kin = F.when((F.col("n") > 0) & (F.col("n") < min_labels) & F.col("template").rlike(LAST), F.regexp_replace("template", LAST, f"$1/{MERGED}$3"))
    nodes = nodes.withColumn("kin", kin)
    few = nodes.where("kin IS NOT NULL").groupBy("host", "kin").agg((F.sum("k") / F.sum("n")).alias("p"))
    share, off = F.col("p"), F.abs(F.col("k") / F.col("n") - F.col("p"))
    alike = F.coalesce(off <= 1.96 * F.sqrt(share * (1 - share) / F.col("n")), F.lit(False))
    nodes = nodes.where("kin IS NOT NULL").join(few, ["host", "kin"]).withColumn("as", F.when(alike, F.col("kin"))).unionByName(nodes.where("kin IS NULL").withColumn("as", F.lit(None).cast("string")), allowMissingColumns=True)
    nodes = nodes.select("host", "template", F.coalesce("as", "template").alias("as"), "n", "k")
    pooled = nodes.groupBy("host", "as").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = pooled.groupBy("host").agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("prior"))
    purity = (F.col("k") + m * F.col("prior")) / (F.col("n") + m)
    bad = pooled.join(hosts, "host").select("host", "as", ((purity >= min_purity) & (F.col("n") >= min_labels)).alias("bad"))
    bad = nodes.select("host", "template", "as").join(bad, ["host", "as"])
    judged = written(tree.select("host", "segments", "urls", "template").join(bad, ["host", "template"]).select("host", "segments", "urls", F.col("as").alias("template"), "bad"))
    total = judged.agg(F.coalesce(F.sum("urls"), F.lit(0))).first()[0]
    out = lookup(base, judged, ["host", "segments"], "urls", total)
    final = F.coalesce(F.col("said"), F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", "template", final.alias("verdict"))
