"""Briefings with sections, texts, numbered sources and what changed, many at a time; and numbering of rows of any number.

A briefing's events, sections and sources are bounded by its ``most`` events, so windows go over a briefing. Sources are
numbered by where they first stand. ``numbered`` numbers a whole table in an order without one task: rows are dealt by
ranges, each range counts its own, and what the ranges before hold is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Words of a briefing; the sections in the order of their rules: under way, of the own country, security, policy, the rest.
WORDS = {"title": "Briefing", "cutoff": "Up to", "minute": "In one minute", "sources": "Sources", "changed": "Changed: ", "articles": " reports", "confirmed": " confirmed", "unverified": " to verify", "disputed": " disputed"}
SECTIONS = ("Under way", "At home", "Diplomacy and security", "Policy and economy", "World")
#: Topics of two sections, and from when an event is under way.
SECURITY, POLICY, UNDER_WAY = ("diplomacy", "defense", "conflict", "security", "sanctions"), ("policy", "economy", "energy", "finance", "tech", "ai"), 80


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """``rows`` with their place in ``order``, from 1; ties are in any order."""
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    made = written(made.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    counts = made.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return made.join(F.broadcast(before), "_part").withColumn(name, F.col("_place") + F.col("_before") + 1).drop("_at", "_part", "_place", "_before")


def clean(s: Column, most: int) -> Column:
    """One line without tags."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), "<[^>]*>", " "), r"\s+", " ")), 1, most)


def status_line(words: dict[str, str] = WORDS) -> Column:
    """What is confirmed, to be verified and disputed, else how many reports there are."""
    parts = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(words[c]))) for c in ("confirmed", "unverified", "disputed"))))
    return F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise(F.concat(F.coalesce("article_count", F.lit(0)).cast("string"), F.lit(words["articles"])))


def section(home: str, names: tuple[str, ...] = SECTIONS) -> Column:
    """The given section, or the first whose rule holds."""
    among = lambda wanted: F.arrays_overlap(F.coalesce("topics", F.array().cast("array<string>")), F.array(*map(F.lit, wanted)))
    at_home = (F.size(F.coalesce("countries", F.array().cast("array<string>"))) > 0) & F.forall("countries", lambda c: c == home)
    rule = F.when((F.col("status") == "developing") | (F.coalesce("importance", F.lit(0)) >= UNDER_WAY), names[0]).when(at_home, names[1]).when(among(SECURITY), names[2]).when(among(POLICY), names[3]).otherwise(names[4])
    return F.coalesce("section", rule)


def items(events: DataFrame, cutoff: str, home: str, most: int = 30) -> DataFrame:
    """briefing, event_id, place (in the briefing), section, section_place, title, line, status_line and change_note of each item.

    events: briefing, event_id, title, one_liner, status, section, importance, heat, updated, countries, topics, confirmed,
    unverified, disputed, article_count, change_note.
    """
    known = events.where(F.col("updated").isNull() | (F.col("updated") <= F.lit(cutoff).cast("timestamp")))
    order = W.partitionBy("briefing").orderBy(F.desc(F.coalesce("importance", F.lit(0))), F.desc(F.coalesce("heat", F.lit(0))), F.desc_nulls_last("updated"), "event_id")
    top = known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    line = clean(F.coalesce(F.nullif("one_liner", F.lit("")), "title"), 800)
    out = top.select("briefing", "event_id", "place", section(home).alias("section"), clean(F.col("title"), 300).alias("title"), line.alias("line"), status_line().alias("status_line"), "change_note")
    return out.withColumn("section_place", F.min("place").over(W.partitionBy("briefing", "section")))


def footnotes(made: DataFrame, citations: DataFrame) -> DataFrame:
    """briefing, event_id, place, number, first and the source's columns: sources numbered by where they first stand. citations: event_id, pos, article_id, title, source, url, published."""
    c = citations.select("event_id", "pos", "article_id", F.struct("title", "source", "url", "published").alias("source"))
    once = made.select("briefing", "event_id", "section_place", "place").join(c, "event_id").groupBy("briefing", "event_id", "section_place", "place", "article_id").agg(F.min("pos").alias("pos"), F.min_by("source", "pos").alias("source"))
    at = F.struct("section_place", "place", "pos", "article_id")
    first = once.groupBy("briefing", "article_id").agg(F.min(at).alias("first"), F.min_by("source", at).alias("shown"))
    first = first.withColumn("number", F.row_number().over(W.partitionBy("briefing").orderBy("first"))).withColumnRenamed("shown", "source")
    return once.drop("source").join(first, ["briefing", "article_id"]).select("briefing", "event_id", "place", "pos", "article_id", "number", "source")


def briefings(events: DataFrame, citations: DataFrame, previous: DataFrame, cutoff: str, home: str = "cn", most: int = 30, words: dict[str, str] = WORDS) -> DataFrame:
    """briefing, markdown, one_minute, added and updated of each briefing. previous: briefing, event_id, line, status_line of the one before."""
    made = written(items(events, cutoff, home, most))
    notes = written(footnotes(made, citations))
    marks = notes.groupBy("briefing", "event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "article_id", "number"))), lambda x: F.concat(F.lit("["), x["number"].cast("string"), F.lit("]"))), "").alias("marks"))
    j = made.join(marks, ["briefing", "event_id"], "left")
    said = F.concat("line", F.when(F.col("marks") != "", F.concat(F.lit(" "), "marks")).otherwise(""))
    note = F.nullif(F.coalesce("change_note", F.lit("")), F.lit(""))
    block = F.concat(F.lit("### "), "title", F.lit("\n"), said, F.lit("\n- "), "status_line", F.when(note.isNotNull(), F.concat(F.lit(f"\n- {words['changed']}"), clean(note, 500))).otherwise(""), F.lit("\n"))
    head = F.when(F.col("place") == F.col("section_place"), F.concat(F.lit("## "), clean(F.col("section"), 200), F.lit("\n\n"))).otherwise("")
    per = j.groupBy("briefing").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_place", "place", F.concat(head, block).alias("x")))), lambda r: r["x"]), "\n").alias("body"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", said.alias("x"))))), lambda r: r["x"]).alias("one_minute"),
    )
    listed = notes.select("briefing", "number", F.struct("source.*").alias("s")).distinct()
    entry = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), clean(F.col("s.title"), 500), F.lit(" — "), clean(F.col("s.source"), 200), F.coalesce(F.concat(F.lit(", "), "s.published"), F.lit("")), F.lit("  \n"), "s.url")
    sources = listed.groupBy("briefing").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", entry.alias("x")))), lambda r: r["x"]), "\n").alias("sources"))
    old = previous.select("briefing", "event_id", F.struct("line", "status_line").alias("old"))
    changed = note.isNotNull() | ~F.col("line").eqNullSafe(F.col("old.line")) | ~F.col("status_line").eqNullSafe(F.col("old.status_line"))
    delta = made.join(old, ["briefing", "event_id"], "left").groupBy("briefing").agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("old").isNotNull() & changed).alias("updated"))
    minute = F.concat(F.lit(f"## {words['minute']}\n\n"), F.array_join(F.transform("one_minute", lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))
    whole = F.concat(F.lit(f"# {words['title']} "), F.col("briefing").cast("string"), F.lit(f"\n\n> {words['cutoff']} {cutoff}\n\n"), minute, "body", F.coalesce(F.concat(F.lit(f"\n## {words['sources']}\n\n"), "sources"), F.lit("")), F.lit("\n"))
    return per.join(sources, "briefing", "left").join(delta, "briefing").select("briefing", whole.alias("markdown"), F.array_join("one_minute", "|").alias("one_minute"), "added", "updated")
