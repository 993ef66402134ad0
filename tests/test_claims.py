"""Figures, claims and their attribution on hand-written sentences."""

from datetime import datetime

import pytest

from lodestream.functions import figures, text
from lodestream.operators import claims


@pytest.mark.parametrize(("raw", "value"), [("2.5万", 25000), ("1.2 million", 1200000), ("三千二百", 3200), ("一百零五", 105), ("两万三千", 23000), ("三亿五千万", 350000000), ("十二", 12), ("2万亿", None), ("二万亿", 2 * 10**12), ("1,200", 1200), ("3 bn", 3 * 10**9), ("12.", None), ("", None), ("9" * 400, None), ("九万亿亿", 90000)])
def test_number(raw, value):
    assert figures.number(raw) == value


def test_victims():
    got = figures.figures("截至7月29日，至少25名平民死亡，41人受伤。")
    assert [(k, n, u, q) for k, n, u, q, *_ in got] == [("casualty", 25, "civilian_deaths", "at_least"), ("casualty", 41, "injuries", "exact")]
    assert [x[:4] for x in figures.figures("About 12 soldiers were killed and the death toll rose to 40")] == [("casualty", 12, "military_deaths", "about"), ("casualty", 40, "deaths", "exact")]
    assert figures.figures(None) == figures.figures("") == []


def test_amounts():
    assert [x[:4] for x in figures.figures("Exports rose 3.5% to more than 2 billion dollars over 40 km")] == [("number", 3.5, "percent", "exact"), ("number", 2e9, "usd", "more_than"), ("number", 40, "km", "more_than")]
    assert [x[:3] for x in figures.figures("投资3亿元")] == [("number", 3e8, "cny")]


COLUMNS = "event_id string, article_id long, title string, excerpt string, body string, published_at timestamp, source_name string, adapter string, category string, is_party boolean, party_of string, is_primary boolean"
ACTORS = {"north": {"label": "North", "kind": "military", "party": "north", "aliases": ["North Army"]}}


def drafts(spark, *articles, **how):
    rows = [("e", i, t, None, b, datetime(2026, 7, 30), "Wire", "rss", c, party, of, first) for i, (t, b, c, party, of, first) in enumerate(articles)]
    return claims.claim_drafts(spark.createDataFrame(rows, COLUMNS), ACTORS, **how)


def test_party_source(spark):
    got = {r.type: r for r in drafts(spark, ("X said on July 29 at least 25 civilians were killed", None, "party_media", True, "north", False)).collect()}
    assert set(got) == {"statement", "casualty"}
    s, c = got["statement"], got["casualty"]
    assert (s.status, s.stance, s.has_primary, s.claimed_by, s.party, s.proposition) == ("reported", "supports", True, "Wire", "north", "statement")
    assert (c.status, c.stance, c.number, c.unit, c.qualifier, c.occurred_at) == ("unverified", "reports", 25, "civilian_deaths", "at_least", datetime(2026, 7, 29))


def test_speakers_and_leads(spark):
    got = drafts(spark, ("The council will meet again", "Prices rose 4% so far. The North Army denied it. John Doe said so! Is it true?", "wire", False, None, None)).orderBy("pos").collect()
    assert [(r.type, r.claimed_by, r.claimed_by_kind, r.party) for r in got] == [("intent", None, "media", None), ("number", None, "media", None), ("statement", "North", "military", "north"), ("statement", "John Doe", "unknown", None)]
    assert got[1].as_of == datetime(2026, 7, 30) and got[0].as_of is None


def test_same_claim_same_id_and_limits(spark):
    a = ("The bridge is shut", "It is long. It is shut. The bridge is shut", "wire", False, None, False)
    rows = drafts(spark, a, a, (None, None, None, None, None, None), ("", "", "", False, "", False)).collect()
    assert len(rows) == 4 and len({r.id for r in rows}) == 2 and {r.type for r in rows} == {"event"}
    assert drafts(spark, a, a, most=1).count() == 2


def test_dates(spark):
    cases = {"on 2026年7月3日": "2026-07-03", "March 5, 2025 it was": "2025-03-05", "May 9": "2026-05-09", "9月1日": "2026-09-01", "at 12-31 ": "2026-12-31", "on 2026-02-30": None, "never": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").selectExpr("s", "timestamp'2026-07-30' AS r")
    got = {r.s: r.d and str(r.d)[:10] for r in df.select("s", claims.claim_date(df.s, df.r).alias("d")).collect()}
    assert got == cases


def test_evidence(spark):
    d = drafts(spark, ("The bridge is shut", None, "data", False, None, True))
    (r,) = claims.evidence(d, spark.createDataFrame([(0, "f")], "article_id long, family_key string")).collect()
    assert (r.stance, r.has_primary, r.family_key) == ("supports", True, "f")


def test_texts_are_cut_over_all_cores(spark, tmp_path):
    path = f"{tmp_path}/docs"
    spark.createDataFrame([(1, "One is here. Two is there.\n"), (2, None), (3, ""), (4, "...")], "doc_id long, text string").coalesce(1).write.parquet(path)
    made = claims.claim_sentences(spark.read.parquet(path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "Repartition" in plan
    assert sorted(tuple(r) for r in made.collect()) == [(1, 0, "One is here."), (1, 1, "Two is there.")]


def test_speakers_and_dates_are_sought_in_drafts_alone(spark):
    lines = ["The bridge is shut.", "It is long.", "Nobody came here."] * 2 + [f"Plain words {'x' * i}." for i in range(1, 9)] + ["Jane Roe denied it on 2026-07-03!", "据悉，官员称 it."]
    made = drafts(spark, (None, "\n".join(lines), "wire", False, None, None))
    above, below = made._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode", 1)
    assert "截至" in above and "截至" not in below and below.count("ArrowEvalPython") == 1 and "when" in below.lower()
    assert {(r.type, r.claimed_by) for r in made.collect()} == {("event", None), ("statement", "Jane Roe"), ("statement", "官员")}


def test_statements_by_plain_searches_first(spark):
    said = ["He SAID so", "she says", "it stated", "X claimed", "Announced", "reported", "confirmed", "denied", "warned", "According to X", "声称", "表示", "他称是", "宣布", "通报", "发布声明", "证实", "否认", "指责", "警告", "据说他表示", "unsaid", "称为", "plain", "", "accor\nding to"]
    df = spark.createDataFrame([(x,) for x in said], "s string")
    rows = df.select(claims.has(df.s, claims.STATEMENT).alias("a"), claims.states(df.s, text.normalize_text(df.s)).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [True] * 21 + [False] * 5
