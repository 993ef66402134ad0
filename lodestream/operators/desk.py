"""What desks read and decide: event lists, details, coverage, verdicts of whole events, proposals, reports, briefings, answers.

All are joins, aggregates and windows over tables that share ids; none gathers more in one row than an event's, a desk's or a
briefing's own bounded list. Nulls: a missing child counts as none, a missing time never passes a bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: States in which a case counts as reviewed, and statuses of a claim.
REVIEWED = ("remanded", "approved", "dispatched", "completed")
STATUSES = ("unverified", "reported", "partially_corroborated", "corroborated", "disputed", "refuted", "outdated")
#: What an event must be of to stand under a tab.
TABS = {"domestic": ("country", ("cn",)), "diplomacy": ("topic", ("diplomacy", "defense", "conflict")), "economy": ("topic", ("economy", "policy", "finance", "energy"))}
#: Topics under the tabs of what is shown already, and names of the own country.
SHOWN, HOME = {"diplomacy": ("diplomacy", "defense", "conflict", "security"), "economy": ("policy", "economy", "energy", "finance", "tech")}, ("CN", "CHN", "中国")
#: Categories of sources, and which an event of some topic needs.
CATEGORIES = ("gov_cn", "official_media_cn", "market_media_cn", "social_cn", "gov_intl", "intl_org", "wire", "intl_media", "local_media", "party_media", "social", "data", "factcheck")
NEEDED = (
    (("conflict", "defense"), None, ("wire", "local_media", "intl_org")),
    (("diplomacy", "intl_politics", "election", "sanctions"), None, ("gov_intl", "wire", "intl_media")),
    (("investigation",), None, ("factcheck", "data")),
    (("disaster", "security", "health", "climate"), None, ("local_media", "data")),
    (("domestic_politics", "policy", "economy", "finance"), "cn", ("gov_cn", "market_media_cn")),
    (("economy", "finance", "energy"), None, ("data",)),
)


def event_list(events: DataFrame, cases: DataFrame, *, since: str | None = None, least: int | None = None, topic: str | None = None, country: str | None = None, ids: DataFrame | None = None, reviewed: bool = False, publishable: bool = False, tab: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page of events that fit every condition given, by importance, heat and time. events: event_id, importance, heat, topic, country, breaking, updated; cases: event_id, state, publishable, completed_at."""
    fits: list[Column] = []
    if since is not None:
        fits.append(F.col("updated") >= F.lit(since).cast("timestamp"))
    if least is not None:
        fits.append(F.col("importance") >= least)
    if topic is not None:
        fits.append(F.col("topic") == topic)
    if country is not None:
        fits.append(F.col("country") == country)
    if tab == "breaking":
        fits.append(F.col("breaking") | (F.col("importance") >= 70))
    elif tab == "intl":
        fits.append(F.col("country") != "cn")
    elif tab is not None:
        column, values = TABS[tab]
        fits.append(F.col(column).isin(*values))
    out = events.where(reduce(lambda a, b: a & b, fits, F.lit(True)))
    if ids is not None:
        out = out.join(ids, "event_id", "left_semi")
    if reviewed:
        out = out.join(cases.where(F.col("state").isin(*REVIEWED)), "event_id", "left_semi")
    if publishable:
        out = out.join(cases.where((F.col("state") == "completed") & F.col("publishable") & F.col("completed_at").isNotNull()), "event_id", "left_semi")
    return out.orderBy(F.desc("importance"), F.desc("heat"), F.desc("updated"), "event_id").offset(max(0, offset)).limit(max(1, min(limit, 200)))


def matches_tab(tab: str) -> Column:
    """Whether an event that is already shown belongs under a tab, which asks otherwise than the list does. Columns: track_mode, status, topics, countries; every event is under a tab of another name."""
    among = lambda c, values: F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, values))), F.lit(False))
    home = among(F.transform(F.coalesce("countries", F.array().cast("array<string>")), lambda x: F.upper(x)), HOME)
    tests = {"breaking": F.coalesce((F.col("track_mode") == "breaking") | (F.col("status") == "developing"), F.lit(False)), "domestic": home, "intl": ~home}
    return tests.get(tab, among(F.coalesce("topics", F.array().cast("array<string>")), SHOWN[tab]) if tab in SHOWN else F.lit(True))


def claims_with_evidence(claims: DataFrame, evidence: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Each claim with its evidence as an array of (article_id, stance, source), in the order of articles; claims without evidence have an empty one."""
    e = evidence.join(articles.select("article_id", "source_id"), "article_id").join(sources.select("source_id", F.col("name").alias("source")), "source_id")
    per = e.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("article_id", "stance", "source"))).alias("evidence"))
    return claims.join(per, "claim_id", "left").withColumn("evidence", F.coalesce("evidence", F.expr("CAST(array() AS array<struct<article_id: bigint, stance: string, source: string>>)")))


def event_detail(events: DataFrame, claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Each event with its claims (with evidence) and its articles, each an array in the order of ids."""
    c = claims.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "status", "evidence"))).alias("claims"))
    a = articles.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("published", "article_id"))).alias("articles"))
    return events.join(c, "event_id", "left").join(a, "event_id", "left")


def effective_stance(stance: Column, party: Column, statement: Column) -> Column:
    """Support by a party for anything but that it said so is a report."""
    return F.when((stance == "supports") & party & ~statement, "reports").otherwise(stance)


def histogram(claims: DataFrame) -> DataFrame:
    """One row per event: the number of claims of each status, zero where there is none."""
    return claims.groupBy("event_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def merge_counts(current: DataFrame, incoming: DataFrame, most: int = 16, cap: int = 999) -> DataFrame:
    """(event_id, slug, n): counts, each at least 1, summed per slug and capped, the ``most`` largest of an event."""
    each = F.greatest(F.col("n"), F.lit(1))
    n = current.unionByName(incoming).groupBy("event_id", "slug").agg(F.least(F.sum(each), F.lit(cap)).alias("n"))
    return n.withColumn("pos", F.row_number().over(W.partitionBy("event_id").orderBy(F.desc("n"), "slug"))).where(F.col("pos") <= most)


def merge_topics(keys: tuple[str, ...], *groups: Column, most: int = 8) -> Column:
    """Topics of several arrays, each once, in the order of the list of ``keys``; others are left out."""
    found = F.array_intersect(F.array(*map(F.lit, keys)), F.flatten(F.array(*groups)))  # a filter would put the groups together for each key
    return F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, most)


def needed_categories(topics: Column, countries: Column) -> Column:
    """Categories of sources that an event of these topics and countries needs, in the order of CATEGORIES."""
    rules = []
    for names, country, gives in NEEDED:
        fits = F.arrays_overlap(topics, F.array(*map(F.lit, names)))
        if country is not None:
            fits = fits & F.array_contains(countries, country)
        rules.append(F.when(fits, F.array(*map(F.lit, gives))).otherwise(F.array().cast("array<string>")))
    return F.array_intersect(F.array(*map(F.lit, CATEGORIES)), F.flatten(F.array(*rules)))  # a filter would try all rules for each category


def featured(reports: DataFrame) -> DataFrame:
    """The most credible report of each event. reports: event_id, article_id, weight, corroborated, verified, healthy, party, primary, reprint, paywalled, published."""
    score = F.col("weight") + 50 * F.col("corroborated").cast("int") + 24 * F.col("verified").cast("int") + 16 * F.col("healthy").cast("int") + 12 * (~F.col("party")).cast("int") + 12 * F.col("primary").cast("int") + 8 * (~F.col("reprint")).cast("int") - 4 * F.col("paywalled").cast("int")
    rows = reports.withColumn("score", score).withColumn("level", F.when(F.col("score") >= 80, "high").when(F.col("score") >= 50, "medium").otherwise("limited"))
    best = F.struct("score", "published", (-F.col("article_id")).alias("low"), "level")
    return rows.groupBy("event_id").agg(F.max(best).alias("b")).select("event_id", (-F.col("b.low")).alias("article_id"), F.col("b.score").alias("score"), F.col("b.level").alias("level"))


def with_fallback(hits: DataFrame, recent: DataFrame, least: int = 8) -> DataFrame:
    """The hits, and where they are fewer than ``least``, recent rows too; a row comes once, hits first. Both are bounded by their limits."""
    few = hits.agg((F.count("*") < least).alias("few"))
    more = recent.crossJoin(F.broadcast(few)).where("few").drop("few")  # one row of one flag
    both = hits.withColumn("from_search", F.lit(True)).unionByName(more.withColumn("from_search", F.lit(False)))
    return both.groupBy(*hits.columns).agg(F.max("from_search").alias("from_search"))


def unique_by_id(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key: the last value, at the first place."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def ask_filters(articles: DataFrame, cutoff: str, official: tuple = (), civilian: bool = False, no_reprints: bool = False, cross_verified: bool = False) -> DataFrame:
    """Articles up to the cutoff that fit the filters. Of rows with one id the first up to the cutoff stands, whether it fits or not.

    articles: article_id, pos, at (without one an article is up to any cutoff), category, party, civilian, reprint, cross_verified, families.
    """
    rest = [c for c in articles.columns if c != "article_id"]
    known = articles.where(F.col("at").isNull() | (F.col("at") <= F.lit(cutoff).cast("timestamp")))
    first = known.groupBy("article_id").agg(F.min_by(F.struct(*rest), "pos").alias("a")).select("article_id", "a.*")
    fits = F.lit(True)
    if official:
        fits = fits & F.coalesce(F.col("category").isin(*official), F.lit(False))
    if civilian:
        fits = fits & ~(F.coalesce(~F.col("civilian"), F.lit(False)) | F.coalesce(F.col("party"), F.lit(False)) | F.coalesce(F.col("category") == "party_media", F.lit(False)))
    if no_reprints:
        fits = fits & ~F.coalesce(F.col("reprint"), F.lit(False))
    if cross_verified:
        fits = fits & (F.coalesce(F.col("cross_verified"), F.lit(False)) | (F.coalesce(F.col("families"), F.lit(0)) >= 2))
    return first.where(fits)


def robots_rules(files: DataFrame, bot: str) -> DataFrame:
    """(host, allow, path) of the rules that hold for ``bot``: those of groups that name it, or else those for every bot. files: host, body (one row a host)."""
    lines = F.transform(F.split("body", "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    at = files.select("host", F.posexplode(lines).alias("line", "said")).where(F.instr("said", ":") > 0)
    at = at.select("host", "line", F.lower(F.trim(F.substring_index("said", ":", 1))).alias("field"), F.trim(F.expr("substr(said, instr(said, ':') + 1)")).alias("value"))
    agent = F.when(F.col("field") == "user-agent", F.lower("value"))
    at = at.withColumn("agent", F.last(agent, ignorenulls=True).over(W.partitionBy("host").orderBy("line")))
    named = (F.col("agent") == bot) | F.contains(F.lit(bot), F.replace(F.col("agent"), F.lit("*"), F.lit("")))
    rules = at.where(F.col("field").isin("allow", "disallow")).select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"), (named & (F.col("agent") != "*")).alias("own"), (F.col("agent") == "*").alias("all"))
    own = rules.groupBy("host").agg(F.bool_or("own").alias("has_own"))
    return rules.join(own, "host").where(F.when(F.col("has_own"), F.col("own")).otherwise(F.col("all"))).select("host", "allow", "path")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (id, host, path) with whether they may be fetched: the longest rule that begins the path decides, without one they may."""
    start = F.replace(F.col("r_path"), F.lit("*"), F.lit(""))
    j = urls.join(rules.select("host", "allow", F.col("path").alias("r_path")).where("r_path <> ''"), "host", "left")
    fits = F.startswith(F.col("path"), start)
    best = F.max_by(F.col("allow"), F.when(fits, F.struct(F.length(start).alias("n"), F.col("allow").alias("a"))))
    return j.groupBy("id").agg(F.coalesce(best, F.lit(True)).alias("allowed"))


def age_text(at: Column, now: Column) -> Column:
    """How long ago: minutes, hours, days below 30, else the date."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return F.when(minutes < 1, "now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(hours < 24, F.concat(hours.cast("string"), F.lit("h"))).when(days < 30, F.concat(days.cast("string"), F.lit("d"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def escape_like(s: Column) -> Column:
    """Without the signs that mean something in a pattern."""
    return F.regexp_replace(s, r"[\\%_]", "")


def fired_slots(ticks: DataFrame, slots: dict[str, str], zone: str, hourly_from: int = 5) -> DataFrame:
    """desk, day, slot and fired_at: each slot (name to HH:mm) starts once a local day, at its desk's first tick at or after its time, and one more each local hour.

    ticks: desk, at (timestamp, UTC). A slot without a tick on its day is not made up for on another; an hour that a changed
    clock repeats counts once. One aggregate: nothing is kept in order.
    """
    local = F.from_utc_timestamp("at", zone)
    hm, hour = F.date_format(local, "HH:mm"), F.when(F.minute(local) >= hourly_from, F.concat(F.lit("hourly:"), F.date_format(local, "HH")))
    due = F.array_compact(F.array(*(F.when(hm >= at, F.lit(name)) for name, at in slots.items()), hour))
    return ticks.where("at IS NOT NULL").select("desk", "at", F.date_format(local, "yyyy-MM-dd").alias("day"), F.explode(due).alias("slot")).groupBy("desk", "day", "slot").agg(F.min("at").alias("fired_at"))


def article_role(party: Column, category: Column) -> Column:
    return F.when(party, "statement").when(category == "data", "data").otherwise("report")


def merged_events(events: DataFrame, arrived: DataFrame) -> DataFrame:
    """Events with what has arrived: span widened, articles counted, version raised and dirty set, once per event. events: event_id, first_at, last_at, version; arrived: event_id, at."""
    new = arrived.groupBy("event_id").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("added"))
    j = events.join(new, "event_id", "left")
    touched = F.col("added").isNotNull()
    return j.select("event_id", F.least("first_at", "a").alias("first_at"), F.greatest("last_at", "b").alias("last_at"), (F.col("version") + touched.cast("int")).alias("version"), touched.alias("dirty"), F.coalesce("added", F.lit(0)).alias("added"))


def briefing_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """Items of a briefing marked new, changed or same against the one before: changed with a note, or another line or status. Both: event_id, note, line, status."""
    old = before.select("event_id", F.struct("line", "status").alias("old"))
    j = now.join(old, "event_id", "left")
    changed = (F.coalesce("note", F.lit("")) != "") | ~F.col("line").eqNullSafe(F.col("old.line")) | ~F.col("status").eqNullSafe(F.col("old.status"))
    return j.select("event_id", "line", F.when(F.col("old").isNull(), "new").when(changed, "changed").otherwise("same").alias("delta"))


def review_gaps(events: DataFrame) -> DataFrame:
    """(event_id, code, level, category): each gap of an event's evidence, one for each of the first eight missing categories.

    events: event_id, importance, breaking, originals, articles, families, verified, claims, refuted, disputed, missing (array).
    """
    high = (F.col("importance") >= 70) | F.col("breaking")
    tests = {
        "NO_ORIGINAL_ARTICLE": (F.col("articles") == 0, True), "ALL_ARTICLES_REPRINTS": ((F.col("articles") > 0) & (F.col("originals") == 0), True), "LOW_SOURCE_INDEPENDENCE": (F.col("families") < 2, None),
        "SOURCE_IDENTITY_UNVERIFIED": ((F.col("articles") > 0) & (F.col("verified") == 0), None), "SOURCE_IDENTITY_PARTIAL": ((F.col("verified") > 0) & (F.col("verified") < F.col("articles")), False),
        "NO_ACTIONABLE_CLAIMS": (F.col("claims") == 0, None), "REFUTED_CLAIM_REQUIRES_REDRAFT": (F.col("refuted") > 0, True), "DISPUTED_CLAIM_REQUIRES_BALANCE": (F.col("disputed") > 0, None),
    }
    level = {True: F.lit("blocker"), False: F.lit("warning"), None: F.when(high, "blocker").otherwise("warning")}
    none = F.lit(None).cast("string").alias("category")
    gaps = F.filter(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), level[blocks].alias("level"), none)) for code, (test, blocks) in tests.items())), lambda g: g.isNotNull())
    missing = F.transform(F.slice(F.coalesce("missing", F.array().cast("array<string>")), 1, 8), lambda c: F.struct(F.lit("REQUIRED_SOURCE_CATEGORY_MISSING").alias("code"), F.lit("warning").alias("level"), c.alias("category")))
    return events.select("event_id", F.inline(F.concat(gaps, missing)))


def desk_reports(events: DataFrame, assigned: DataFrame, claims: DataFrame, desks: tuple, most: int = 12) -> DataFrame:
    """One row per event and desk, whether assigned or not: cited findings, and completed or blocked. assigned: event_id, desk; claims: event_id, desk, claim_id, citations."""
    every = events.select("event_id", F.explode(F.array(*map(F.lit, desks))).alias("desk"))
    found = claims.where("citations > 0").groupBy("event_id", "desk").agg(F.slice(F.array_sort(F.collect_set("claim_id")), 1, most).alias("findings"))
    out = every.join(assigned.withColumn("assigned", F.lit(True)), ["event_id", "desk"], "left").join(found, ["event_id", "desk"], "left")
    ok = F.coalesce(F.col("assigned"), F.lit(False))
    return out.select("event_id", "desk", F.when(ok, "completed").otherwise("blocked").alias("status"), F.when(ok, F.coalesce(F.array_join("findings", ","), F.lit(""))).otherwise("").alias("findings"))


def throttled(events: DataFrame, locks: DataFrame, now: int, most: int = 2, seconds: int = 1800) -> DataFrame:
    """Of the ``most`` most important events those without a search in the last ``seconds``; no other takes the place of one that is held. locks: event_id, at (seconds)."""
    held = locks.where(F.col("at") > now - seconds).select("event_id")
    return events.orderBy(F.desc("importance"), F.desc("heat"), F.desc("updated"), "event_id").limit(most).join(held, "event_id", "left_anti")


def live_values(entries: DataFrame, now: int) -> DataFrame:
    """The last value of each key that has not expired. entries: key, seq, value, expires (seconds, null: never)."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("value", "expires"), "seq").alias("v"))
    return last.where(F.col("v.expires").isNull() | (F.col("v.expires") > now)).select("key", F.col("v.value").alias("value"))
