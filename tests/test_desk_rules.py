"""Rules of desks, briefings, answers, phrases and slots on rows whose results are written by hand."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestream.functions import automaton, tagging
from lodestream.operators import answers, briefing, desk
from lodestream.plans import catalog
from lodestream.streaming import slots

NOW = datetime(2024, 5, 1)
DIR = "/root/testdata/sf0.001"


def test_tabs_and_reviewed_states(spark):
    topics = ["diplomacy", "defense", "conflict", "economy", "policy", "finance", "energy", "sanctions", "election", "health"]
    e = spark.createDataFrame([(i, 10, 0, t, "us", False, NOW) for i, t in enumerate(topics)], "event_id long, importance int, heat int, topic string, country string, breaking boolean, updated timestamp")
    states = ["draft", "remanded", "approved", "dispatched", "reporting", "completed"]
    c = spark.createDataFrame([(i, s, True, NOW) for i, s in enumerate(states)], "event_id long, state string, publishable boolean, completed_at timestamp")
    ids = lambda **how: [r.event_id for r in desk.event_list(e, c, **how).collect()]
    assert ids(tab="diplomacy") == [0, 1, 2] and ids(tab="economy") == [3, 4, 5, 6] and ids(reviewed=True) == [1, 2, 3, 5] and ids(publishable=True) == [5]


def test_review(spark):
    ok = {"importance": 10, "breaking": False, "originals": 1, "articles": 2, "families": 2, "verified": 2, "claims": 3, "refuted": 0, "disputed": 0, "missing": []}
    cases = {
        1: ({}, []), 2: ({"disputed": 1}, [("DISPUTED_CLAIM_REQUIRES_BALANCE", "warning", None)]), 3: ({"disputed": 1, "importance": 80}, [("DISPUTED_CLAIM_REQUIRES_BALANCE", "blocker", None)]),
        4: ({"missing": ["wire", "data"], "breaking": True}, [("REQUIRED_SOURCE_CATEGORY_MISSING", "warning", c) for c in ("wire", "data")]), 5: ({"claims": 0}, [("NO_ACTIONABLE_CLAIMS", "warning", None)]),
        6: ({"missing": list("abcdefghij"), "refuted": 1}, [("REFUTED_CLAIM_REQUIRES_REDRAFT", "blocker", None), *(("REQUIRED_SOURCE_CATEGORY_MISSING", "warning", c) for c in "abcdefgh")]),
        7: ({"articles": 0, "originals": 0, "verified": 0}, [("NO_ORIGINAL_ARTICLE", "blocker", None)]), 8: ({"originals": 0, "verified": 1}, [("ALL_ARTICLES_REPRINTS", "blocker", None), ("SOURCE_IDENTITY_PARTIAL", "warning", None)]),
        9: ({"families": 1, "verified": 0, "importance": 70}, [("LOW_SOURCE_INDEPENDENCE", "blocker", None), ("SOURCE_IDENTITY_UNVERIFIED", "blocker", None)]),
    }
    rows = [(i, *(ok | how).values()) for i, (how, _) in cases.items()]
    schema = "event_id long, importance int, breaking boolean, originals int, articles int, families int, verified int, claims int, refuted int, disputed int, missing array<string>"
    got = {}
    for r in desk.review_gaps(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.event_id, []).append(tuple(r)[1:])
    assert {i: got.get(i, []) for i in cases} == {i: want for i, (_, want) in cases.items()}


def test_search_is_held_not_handed_on(spark):
    e = spark.createDataFrame([(1, 90, 1, NOW), (2, 90, 5, NOW), (3, 80, 9, NOW)], "event_id long, importance int, heat int, updated timestamp")
    locks = spark.createDataFrame([(2, 1000), (3, -5000)], "event_id long, at long")
    assert [r.event_id for r in desk.throttled(e, locks, 1200).collect()] == [1]


def test_changes_between_briefings(spark):
    schema = "event_id long, note string, line string, status string"
    now = spark.createDataFrame([(1, None, "a", "s"), (2, "n", "a", "s"), (3, None, "b", "s"), (4, "", "a", "t"), (5, None, "a", "s"), (6, None, None, "s")], schema)
    before = spark.createDataFrame([(i, None, None if i == 6 else "a", "s") for i in (1, 2, 3, 4, 6)], schema)
    assert {r.event_id: r.delta for r in desk.briefing_delta(now, before).collect()} == {1: "same", 2: "changed", 3: "changed", 4: "changed", 5: "new", 6: "same"}


def test_ask_filters(spark):
    rows = [(1, 1, None, "wire", False, None, False, False, 2), (1, 2, NOW, "gov_intl", False, None, False, True, 2), (2, 1, NOW, "party_media", False, True, False, True, 0), (3, 1, NOW, "gov_intl", None, False, True, None, None), (4, 1, datetime(2025, 1, 1), "wire", False, None, False, True, 2)]
    a = spark.createDataFrame(rows, "article_id long, pos int, at timestamp, category string, party boolean, civilian boolean, reprint boolean, cross_verified boolean, families int")
    ids = lambda **how: sorted(r.article_id for r in desk.ask_filters(a, "2024-06-01", **how).collect())
    assert ids() == [1, 2, 3] and ids(official=("gov_intl",)) == [3] and ids(civilian=True) == [1] and ids(no_reprints=True) == [1, 2] and ids(cross_verified=True) == [1, 2]


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(desk.escape_like(F.lit(r"a\b%c_d"))) == "abcd"
    assert one(desk.merge_topics(("x", "y", "z"), F.array(F.lit("z"), F.lit("q")), F.array(F.lit("x"), F.lit(None).cast("string")))) == ["x", "z"]
    n = spark.createDataFrame([(1, "a", 0), (1, "a", -4), (1, "b", 2000)], "event_id long, slug string, n long")
    assert {r.slug: r.n for r in desk.merge_counts(n, n.where("false")).collect()} == {"a": 2, "b": 999}
    assert "social_cn" in desk.CATEGORIES and "other" not in desk.CATEGORIES and len(desk.CATEGORIES) == 13


def test_slots_of_ticks(spark):
    ticks = spark.createDataFrame([("d", datetime(2024, 3, 31, h, m)) for h, m in ((0, 4), (0, 30), (1, 2), (5, 0), (6, 59), (10, 30), (10, 31))] + [("d", None)], "desk string, at timestamp")
    got = {(r.day, r.slot): r.fired_at.strftime("%H:%M") for r in desk.fired_slots(ticks, {"morning": "07:00", "noon": "12:30"}, "Europe/Berlin").collect()}
    assert got[("2024-03-31", "morning")] == "05:00" and got[("2024-03-31", "noon")] == "10:30" and got[("2024-03-31", "hourly:01")] == "00:30" and ("2024-03-31", "hourly:03") not in got and len(got) == 5


def test_instants_on_days_of_changed_clocks():
    utc = lambda *x: int(datetime(*x, tzinfo=timezone.utc).timestamp())
    got = slots.instants(utc(2024, 10, 26, 5), utc(2024, 10, 28, 6), {"morning": "07:00", "night": "02:30"}, "Europe/Berlin")
    assert [(s - utc(2024, 10, 26), d, n) for s, d, n in got] == [(86400 + 1800, "2024-10-27", "night"), (86400 + 6 * 3600, "2024-10-27", "morning"), (2 * 86400 + 5400, "2024-10-28", "night"), (2 * 86400 + 6 * 3600, "2024-10-28", "morning")]
    assert slots.instants(5, 5, {"a": "07:00"}, "UTC") == []


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_counts_like_expressions(spark, seed):
    rng = random.Random(seed)
    table = {"ab": ["ab", "a b"], "aba": ["a b a", "x"], "han": ["北京", "京"], "up": ["UP", "up and"], "same": ["ab"]}
    texts = [None, "", *("".join(rng.choices(["ab", "a", "b", " ", "x", "北京", "京", "UP", "up ", "and", ",", "1"], k=40)) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    shown = lambda c: F.transform(c, lambda h: F.concat_ws(":", h["slug"], h["count"].cast("string")))
    want = {r.id: r.x or [] for r in df.select("id", shown(tagging.entities(F.col("text"), table)).alias("x")).collect()}
    assert {r.id: r.x for r in automaton.names(df, F.col("text"), table).select("id", shown(F.col("found")).alias("x")).collect()} == want


def test_numbering_and_a_briefing(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.number == r.v + 1 for r in briefing.numbered(rows.repartition(5), ["v"]).collect())
    schema = "briefing string, event_id long, title string, one_liner string, status string, section string, importance int, heat int, updated timestamp, countries array<string>, topics array<string>, confirmed int, unverified int, disputed int, article_count int, change_note string"
    e = spark.createDataFrame([("b", 1, "<b>One</b>", "", "stable", None, 90, 0, NOW, ["us"], [], 1, 0, 2, 3, None), ("b", 2, "Two", "two lines", "stable", None, 10, 0, NOW, ["cn"], ["conflict"], 0, 0, 0, 3, " "), ("b", 3, "Three", None, "developing", None, 5, 0, None, [], [], 0, 0, 0, None, "new"), ("b", 4, "Late", None, "stable", None, 99, 0, datetime(2025, 1, 1), [], [], 0, 0, 0, 1, None), ("c", 5, "Alone", None, "stable", None, 1, 1, NOW, None, ["policy"], 0, 0, 0, 1, None)], schema)
    c = spark.createDataFrame([(3, 1, 30, "T30", "S", "u30", None), (2, 2, 20, "T20", "S", "u20", "d"), (2, 1, 30, "T30", "S", "u30", None), (1, 1, 10, "T10", "S", "u10", None)], "event_id long, pos int, article_id long, title string, source string, url string, published string")
    before = spark.createDataFrame([("b", 1, "One", "1 confirmed · 2 disputed"), ("b", 3, "Three", "0 reports")], "briefing string, event_id long, line string, status_line string")
    got = {r.briefing: r for r in briefing.briefings(e, c, before, "2024-06-01 00:00:00").collect()}
    assert (got["b"].added, got["b"].updated, got["c"].added, got["c"].one_minute) == (1, 1, 1, "Alone")
    assert got["b"].markdown == "# Briefing b\n\n> Up to 2024-06-01 00:00:00\n\n## In one minute\n\n- One [1]\n- two lines [2][3]\n- Three [2]\n\n## Under way\n\n### One\nOne [1]\n- 1 confirmed · 2 disputed\n\n### Three\nThree [2]\n- 0 reports\n- Changed: new\n\n## At home\n\n### Two\ntwo lines [2][3]\n- 3 reports\n- Changed: \n\n## Sources\n\n[1] T10 — S  \nu10\n[2] T30 — S  \nu30\n[3] T20 — S, d  \nu20\n"


def test_answer(spark):
    schema = "article_id long, title string, excerpt string, body string, at timestamp, source string, event_id long, cross_verified boolean, families int, reprint boolean"
    body = "The port was closed. Ships wait at the port of Lemnos today! short. No end here\n"
    a = spark.createDataFrame([(1, "Port news", None, body, NOW, "A", 7, False, 1, False), (2, "Other", "", "", NOW, "B", 8, False, 1, True), (3, "Port news", None, body, NOW, "A", 7, False, 1, False)], schema)
    r = answers.answer(a, "Why do ships wait at Lemnos", "2024-06-01").first()
    assert r.answer == "As of 2024-06-01, the available reporting indicates: According to A, Ships wait at the port of Lemnos today! [1]" and r.citations == ["[1] Port news — A", "[2] Port news — A"] and r.related == [7]
    assert [x.score for x in answers.ranked(a, "port").orderBy("article_id").collect()] == [8.05, 0.0, 8.05]
    none = answers.answer(a.where("false"), "anything", "2024-06-01", ("x",)).first()
    assert none.answer.startswith("As of 2024-06-01, the selected sources do not") and none.citations == [] and none.caveats[1:3] == ["Filter: x.", "Nothing in the selection supports a clear answer."]


def test_topics_are_merged_once(spark):
    """No topic or category has the groups or rules tried again for it."""
    plan = catalog.queries()["topic_merge"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    x = spark.range(1).select(desk.merge_topics(("x", "y"), F.lit(None).cast("array<string>")).alias("none"), F.array_join(desk.needed_categories(F.lit(None).cast("array<string>"), F.array(F.lit("cn"))), ",").alias("needed")).first()
    assert x.none == [] and x.needed == ""
