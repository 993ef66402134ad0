"""Sentences that claims are drawn from, and the claims: type, speaker, figure, time, stance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import figures, tagging, text
from ..session import spread


def claim_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0) and sentence, each normalised form once per document, at its first place."""
    return keyed_sentences(docs).drop("key")


def keyed_sentences(docs: DataFrame) -> DataFrame:
    """claim_sentences() with their normalised form as key.

    Repeats go by an aggregate over (doc_id, normalised form), so a long text costs in proportion to its length.
    """
    parts = spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    keyed = parts.withColumn("key", text.normalize_text(F.col("sentence"))).where("key <> ''")
    first = keyed.groupBy("doc_id", "key").agg(F.min(F.struct("i", "sentence")).alias("f"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("f.i")) - 1
    return first.select("doc_id", place.alias("pos"), F.col("f.sentence").alias("sentence"), "key")


#: Words that mark statements, intentions, questions and corrections; the second of a pair is for Latin letters.
STATEMENT = (r"声称|表示|(?<![名简俗])称(?!为|谓|号)|宣布|通报|发布声明|证实|否认|指责|警告|据.+?(?:称|表示|通报)", r"\b(?:said|says|stated|claimed|announced|reported|confirmed|denied|warned|according to)\b")
#: Each alternative of STATEMENT holds one of these, so a folded sentence without them is told by plain searches.
STATED = ("said", "says", "stated", "claimed", "announced", "reported", "confirmed", "denied", "warned", "according to", "称", "表示", "宣布", "通报", "发布声明", "证实", "否认", "指责", "警告")
INTENT = ("计划|拟议|准备|将会|将于|打算|寻求|承诺|威胁|呼吁", r"\b(?:plans? to|intends? to|will|would|seeks? to|pledged to|threatened to|called on)\b")
UPDATE = ("修正|更正|更新为|上调至|下调至|此前为", r"\b(?:corrected|revised|updated to|raised to|lowered to|previously)\b")
QUESTION = r"[?？]\s*$"
#: Dates, and words for the time a figure holds for.
DATE_FULL = r"((?:19|20)\d{2})[年\-/.](0?[1-9]|1[0-2])[月\-/.]([12]\d|3[01]|0?[1-9])日?"
DATE_WORD = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|tember|ober|ember)?\s+(\d{1,2})(?:,\s*((?:19|20)\d{2}))?"
DATE_SHORT = (r"(0?[1-9]|1[0-2])月(0?[1-9]|[12]\d|3[01])日", r"\b(0?[1-9]|1[0-2])[\-/.](0?[1-9]|[12]\d|3[01])\b")
AS_OF_NOW = r"(?i)截至目前|截至发稿|目前为止|\b(?:as of now|so far|to date)\b"
AS_OF = r"(?i)(?:截至|截止|as of)\s*([^，。；;,.]{2,30})"
#: Who speaks, before a verb of speech; one verb must not be part of a longer word.
SPOKEN = "(?<![名简俗])称(?!为|谓|号)"
SPEAKER = (r"([^，。；;：:\n]{1,36}?)(?:声称|表示|(?<![名简俗])称(?!为|谓|号)|宣布|通报|证实|否认|指责|警告)", r"\b([A-Z][A-Za-z0-9 .'-]{1,50}?)\s+(?:said|stated|claimed|announced|confirmed|denied|warned)\b")
#: Kinds of sources by adapter and category.
SOCIAL_ADAPTERS = ("mastodon", "bluesky", "telegramweb")
KINDS = {"gov_cn": "gov", "gov_intl": "gov", "intl_org": "org", "data": "org", "factcheck": "org"}
FIRST_HAND = ("data", "factcheck", "intl_org")


def has(s: Column, pair: tuple[str, str]) -> Column:
    return s.rlike("(?i)" + "|".join(pair))


def states(s: Column, key: Column) -> Column:
    """has() of STATEMENT; ``key`` is the sentence's normalised form."""
    return reduce(lambda a, b: a | b, (F.contains(key, F.lit(w)) for w in STATED)) & has(s, STATEMENT)


def source_kind(adapter: Column, category: Column, is_party: Column) -> Column:
    by_category = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    party = F.when(is_party, "party")
    return (
        F.when(adapter.isin(*SOCIAL_ADAPTERS), "social").when(category.isin(*KINDS), F.try_element_at(by_category, category)).when(category == "party_media", F.coalesce(party, F.lit("media")))
        .when(category.contains("media") | (category == "wire"), "media").when(category.isin("social", "social_cn"), "social").otherwise(F.coalesce(party, F.lit("unknown")))
    )


def claim_date(s: Column, reference: Column) -> Column:
    """First date in a text, the clearest form first, at midnight UTC; the reference lends the year that is left out.

    A day of two digits is read whole (2026-07-29 is not 2 July); a day that no calendar has gives null.
    """

    def day(year: Column, month: Column, number: Column, form: str = "yyyy M d") -> Column:
        return F.try_to_timestamp(F.concat_ws(" ", F.nullif(year, F.lit("")), F.nullif(month, F.lit("")), F.nullif(number, F.lit(""))), F.lit(form))

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    lent = F.date_format(reference, "yyyy")
    full = day(group(DATE_FULL, 1), group(DATE_FULL, 2), group(DATE_FULL, 3))
    word = day(F.coalesce(F.nullif(group(DATE_WORD, 3), F.lit("")), lent), F.initcap(group(DATE_WORD, 1)), group(DATE_WORD, 2), "yyyy MMM d")
    short = [day(lent, group(p, 1), group(p, 2)) for p in DATE_SHORT]
    return F.when(s.rlike(DATE_FULL), full).when(s.rlike(DATE_WORD), word).when(lent.isNull(), None).when(s.rlike(DATE_SHORT[0]), short[0]).otherwise(short[1])


def as_of(s: Column, reference: Column) -> Column:
    told = F.regexp_extract(s, AS_OF, 1)
    return F.when(s.rlike(AS_OF_NOW), reference).when(told != "", F.coalesce(claim_date(told, reference), F.when(told.rlike(AS_OF_NOW), reference)))


def attribution(s: Column, actors: dict[str, dict]) -> Column:
    """struct<claimed_by, kind, party> of a sentence: a known party named in it, the source where it speaks for itself, whoever
    stands before a verb of speech, else the kind of source alone. Reads source_name, kind, is_party, party_of, is_primary and
    statement. ``actors`` is a table of rules: slug to label, kind, party and aliases."""
    nobody = F.lit(None).cast("string")

    def said(by: Column, kind: Column, party: Column) -> Column:
        return F.struct(by.alias("claimed_by"), kind.alias("kind"), party.alias("party"))

    # a scan for the verbs alone is cheap; the pattern with the words before them tries every start, so it runs only behind that
    verbs = [p[p.rindex("(?:") :] for p in (SPEAKER[0].replace(SPOKEN, "称"), SPEAKER[1])]
    spoken = text.compact(F.coalesce(*(F.when(s.rlike(v), F.nullif(F.regexp_extract(s, p, 1), F.lit(""))) for v, p in zip(verbs, SPEAKER, strict=True)), F.lit("")))
    own = F.col("is_party") | F.col("statement") & F.col("is_primary")
    rest = F.when(own, said(F.col("source_name"), F.col("kind"), F.col("party_of"))).when(spoken != "", said(spoken, F.lit("unknown"), F.col("party_of"))).otherwise(said(nobody, F.col("kind"), F.col("party_of")))
    parties = {slug: a for slug, a in actors.items() if a["party"]}
    if not parties:
        return rest
    known = F.create_map(*(x for slug, a in parties.items() for x in (F.lit(slug), said(F.lit(a["label"]), F.lit(a["kind"]), F.lit(a["party"])))))
    return F.coalesce(F.try_element_at(known, F.get(tagging.entities(s, {slug: a["aliases"] for slug, a in parties.items()}), F.lit(0))["slug"]), rest)


def shown(n: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(n.cast("string"))


def claim_drafts(articles: DataFrame, actors: dict[str, dict] | None = None, most: int | None = None) -> DataFrame:
    """Claims of articles: that something was stated, figures of victims and other figures, and what the lead tells.

    articles: event_id, article_id, title, excerpt, body, published_at, source_name, adapter, category, is_party, party_of,
    is_primary; article_id is unique. Returns id, event_id, article_id, pos (of the sentence), text, type, claimed_by,
    claimed_by_kind, party, number, unit, qualifier, as_of, occurred_at, status, stance, has_primary and proposition. Equal
    event, type, text, party, speaker, figure, unit, qualifier and time give equal ids, so that articles share claims. Articles
    without text have none. ``most`` keeps the first claims of each article only.

    One aggregate for the distinct sentences and one join back by article; figures are read in Arrow batches. Speakers and
    dates are looked for behind the explode, in sentences that give a draft alone.
    """
    empty = F.lit("")
    whole = articles.select(F.col("article_id").alias("doc_id"), F.concat_ws("\n", *(F.nullif(F.coalesce(c, empty), empty) for c in (text.compact(F.col("title")), "excerpt", "body"))).alias("text"))
    about = articles.select(
        "event_id", F.col("article_id").alias("doc_id"), text.normalize_text(F.coalesce("title", empty)).alias("title_key"), "published_at", "source_name", "category", "party_of",
        F.coalesce("is_party", F.lit(False)).alias("is_party"), F.coalesce("is_primary", F.lit(False)).alias("is_primary"),
        source_kind(F.coalesce("adapter", empty), F.coalesce("category", empty), F.coalesce("is_party", F.lit(False))).alias("kind"),
    )
    s = F.col("sentence")
    x = keyed_sentences(whole).join(about, "doc_id").withColumns({"statement": F.col("is_party") | states(s, F.col("key")), "figures": figures.figures_of(s)})
    draft = "struct<type: string, number: double, unit: string, qualifier: string>"

    def one(kind: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.array(F.struct(kind.alias("type"), none.cast("double").alias("number"), none.alias("unit"), none.alias("qualifier")).cast(draft))

    none = F.array().cast(f"array<{draft}>")
    found = F.array_distinct(F.transform("figures", lambda f: F.struct(f["kind"].alias("type"), f["number"].alias("number"), f["unit"].alias("unit"), f["qualifier"].alias("qualifier"))))
    lead = (F.col("pos") < 2) | (F.col("key") == F.col("title_key"))
    generic = F.when(~F.col("statement") & (F.size("figures") == 0) & lead & ~s.rlike(QUESTION), one(F.when(has(s, INTENT), "intent").otherwise("event"))).otherwise(none)
    x = x.withColumn("drafts", F.concat(F.when(F.col("statement"), one(F.lit("statement"))).otherwise(none), found.cast(f"array<{draft}>"), generic))
    x = x.select("*", F.posexplode_outer("drafts").alias("i", "d")).where("i IS NOT NULL")  # an inner one would have drafts made again for each condition that is inferred
    x = x.withColumns({"who": attribution(s, actors or {}), "told_as_of": as_of(s, F.col("published_at")), "told_at": claim_date(s, F.col("published_at"))})
    stated, figure = F.col("d.type") == "statement", F.col("d.type").isin("casualty", "number")
    # a statement is proved by whoever made it; a fact only by first-hand data that nobody merely states
    primary = F.when(stated, F.col("is_primary") | F.col("is_party")).otherwise(F.col("is_primary") & ~F.col("is_party") & F.coalesce(F.col("category").isin(*FIRST_HAND), F.lit(False)) & ~(figure & F.col("statement")))
    when = F.when(stated | figure, F.col("told_as_of"))
    iso = F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), empty)
    key = F.concat_ws("|", F.col("event_id").cast("string"), "d.type", "key", *(F.coalesce(c, empty) for c in ("who.party", "who.claimed_by", shown(F.col("d.number")), "d.unit", iso, "d.qualifier")))
    out = x.select(
        F.concat(F.lit("clm_"), F.substring(F.sha2(key, 256), 1, 16)).alias("id"), "event_id", F.col("doc_id").alias("article_id"), "pos", s.alias("text"), F.col("d.type").alias("type"),
        F.col("who.claimed_by").alias("claimed_by"), F.col("who.kind").alias("claimed_by_kind"), F.col("who.party").alias("party"), F.col("d.number").alias("number"), F.col("d.unit").alias("unit"), F.col("d.qualifier").alias("qualifier"),
        when.alias("as_of"), F.when(~stated, F.col("told_at")).alias("occurred_at"), F.when(~stated & F.col("who.party").isNotNull(), "unverified").otherwise("reported").alias("status"),
        F.when(primary, "supports").otherwise("reports").alias("stance"), primary.alias("has_primary"), F.when(stated, "statement").otherwise("underlying_fact").alias("proposition"), "i",
    )
    if most is not None:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy("article_id").orderBy("pos", "i"))).where(F.col("_n") <= most).drop("_n")
    return out.drop("i")


def evidence(claims: DataFrame, families: DataFrame) -> DataFrame:
    """claim_id, article_id, stance, has_primary and family_key: one row per claim and article; families: article_id, family_key."""
    rows = claims.groupBy(F.col("id").alias("claim_id"), "article_id").agg(F.max("stance").alias("stance"), F.max("has_primary").alias("has_primary"))
    return rows.join(families.select("article_id", "family_key"), "article_id", "left").select("claim_id", "article_id", "stance", "has_primary", "family_key")
