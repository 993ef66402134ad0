"""Verdicts by hand-written claims and evidence, and figures in conflict against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import verdicts

CLAIM = "claim_id long, event_id long, kind string, claimed_by string, claimed_by_kind string, party string, number long, unit string, qualifier string, at long, correction boolean, superseded_by long"
EVIDENCE = "claim_id long, article_id long, stance string, family_key string, wire_family string, reprint_of long, source_id long, source_family_id long, source_family_kind string, domain string, has_primary boolean, is_party boolean"
H = 3600


def claims(spark, *rows):
    base = {"claim_id": 1, "event_id": 1, "kind": "casualty", "claimed_by": None, "claimed_by_kind": None, "party": None, "number": None, "unit": "deaths", "qualifier": "exact", "at": 0, "correction": False, "superseded_by": None}
    return spark.createDataFrame([tuple((base | {"claim_id": i + 1} | r).values()) for i, r in enumerate(rows)], CLAIM)


def evidence(spark, *rows):
    base = {"claim_id": 1, "article_id": 1, "stance": "reports", "family_key": None, "wire_family": None, "reprint_of": None, "source_id": None, "source_family_id": None, "source_family_kind": None, "domain": None, "has_primary": False, "is_party": False}
    return spark.createDataFrame([tuple((base | {"article_id": 10 + i} | r).values()) for i, r in enumerate(rows)], EVIDENCE)


def test_families(spark):
    e = evidence(spark, {"family_key": "k:1", "wire_family": "ap"}, {"wire_family": "ap"}, {"wire_family": "reprint:7"}, {"reprint_of": 14}, {"source_id": 4}, {"source_family_id": 5, "source_family_kind": "ownership", "source_id": 4}, {"source_family_id": 5, "source_family_kind": "platform", "source_id": 4}, {"domain": "a.org"}, {}, {"claim_id": 2, "article_id": 14, "source_id": 4})
    got = {(r.claim_id, r.article_id): r.family for r in verdicts.families(e).collect()}
    assert [got[1, 10 + i] for i in range(9)] == ["k:1", "wire:ap", "reprint:7", "reprint:14", "reprint:14", "family:5", "source:4", "domain:a.org", "article:18"]
    assert got[2, 14] == "source:4"  # a root of another claim's evidence only


def s(claim, stance, source, **more):
    return {"claim_id": claim, "stance": stance, "source_id": source} | more


def test_ladder(spark):
    c = claims(spark, *[{"kind": "event"}] * 6, {"kind": "event", "party": "p"}, {"kind": "event", "claimed_by_kind": "military"}, *[{"kind": "statement"}] * 4, {"kind": "event", "superseded_by": 3}, *[{"kind": "event"}] * 5)
    e = evidence(
        spark, s(1, "supports", 1), s(1, "supports", 2), s(2, "supports", 1), s(3, "supports", 1, is_party=True), s(4, "refutes", 1), s(5, "refutes", 1), s(5, "refutes", 2), s(6, "refutes", 1, has_primary=True), s(7, "reports", 1), s(8, "reports", 1),
        s(9, "supports", 1, is_party=True), s(10, "supports", 1, has_primary=True), s(11, "reports", 1), s(12, "supports", 1), s(12, "supports", 2), s(13, "supports", 1), s(13, "supports", 2),
        s(14, "disputes", 1), s(15, "supports", 1), s(15, "refutes", 2), s(16, "supports", 1), s(16, "supports", 1), s(18, "reports", 3), s(18, "reports", 4),
    )
    got = {r.claim_id: r for r in verdicts.verified(c, e).collect()}
    want = "corroborated partially_corroborated reported disputed refuted refuted unverified unverified partially_corroborated corroborated reported corroborated outdated disputed disputed partially_corroborated unverified reported".split()
    assert [got[i + 1].status for i in range(18)] == want
    assert [got[i].chains for i in (1, 2, 4, 17, 18)] == [2, 1, 0, 0, 2] and got[10].has_primary and not got[9].has_primary and got[15].has_refutation and got[13].superseded_by == 3


def test_replaced_and_contradicting_figures(spark):
    c = claims(
        spark, {"claimed_by": "Army", "number": 10, "at": 0}, {"claimed_by": "army", "number": 20, "at": H}, {"party": "p", "number": 40, "at": 2 * H}, {"party": "q", "number": 41, "at": 100 * H}, {"party": "r", "number": 38, "at": 2 * H, "qualifier": "at_least"},
        {"event_id": 2, "claimed_by": "a", "number": 5, "at": 0}, {"event_id": 2, "claimed_by": "a", "number": 5, "at": H, "correction": True}, {"event_id": 2, "claimed_by": "b", "number": 5, "at": 0}, {"event_id": 2, "claimed_by": "b", "number": 5, "at": H},
        {"event_id": 3, "claimed_by": "a", "number": 9, "at": 0}, {"event_id": 3, "claimed_by": "a", "number": 30, "at": 0}, {"event_id": 3, "claimed_by": "b", "number": 30, "at": None}, {"event_id": 3, "claimed_by": "c", "number": 10, "at": 0}, {"event_id": 3, "claimed_by": "d", "number": 31, "unit": "injuries"},
    )
    got = {r.claim_id: (r.status, r.superseded_by) for r in verdicts.verified(c, evidence(spark)).collect()}
    assert got[1] == ("outdated", 2) and got[2] == ("disputed", None) and got[3] == ("disputed", None) and got[4] == ("unverified", None)
    assert got[5] == ("disputed", None)  # at least 38 excludes 20, not 40
    assert (got[6], got[8]) == (("outdated", 7), ("unverified", None))  # a correction replaces an equal figure, repeating it does not
    assert [got[i][0] for i in (10, 11, 12, 13, 14)] == ["unverified", "disputed", "unverified", "disputed", "unverified"]
    assert [tuple(r) for r in verdicts.disputes(c).orderBy("event_id").collect()] == [(1, "deaths", 3, 3, 20, 40), (3, "deaths", 2, 2, 10, 30)]


@pytest.mark.parametrize("seed", range(4))
def test_sweep_like_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [{"event_id": rng.randrange(2), "claimed_by": f"s{rng.randrange(14)}", "number": rng.choice([0, 1, 2, rng.randrange(60)]), "qualifier": rng.choice(["exact", "at_least", "more_than", "about", "up_to", None]), "at": rng.choice([0, 48 * H, 48 * H + 1, rng.randrange(0, 300 * H, 6 * H)])} for _ in range(120)]
    active = verdicts.latest_of_each(verdicts.figures(claims(spark, *rows)))[0].collect()

    def apart(a, b):
        v, w = a.number, b.number
        return a.event_id == b.event_id and a.actor != b.actor and abs(a["at"] - b["at"]) <= 48 * H and (a.high < b.low or b.high < a.low) and abs(v - w) > 1 and abs(v - w) / max(1, v, w) > 0.1

    want = {a.claim_id for a in active for b in active if apart(a, b)}
    got = [r.claim_id for r in verdicts.contradicted(verdicts.latest_of_each(verdicts.figures(claims(spark, *rows)))[0]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_nothing(spark):
    c, e = claims(spark, {}).where("false"), evidence(spark, {}).where(F.lit(False))
    assert verdicts.verified(c, e).count() == 0 and verdicts.disputes(c).count() == 0
    assert [(r.status, r.chains) for r in verdicts.verified(claims(spark, {}), e).collect()] == [("unverified", 0)]


def test_sweep_and_evidence_cost_no_squares(spark):
    """No frame slides over its neighbours, and evidence is counted without an expanded row for each stance."""
    c, e = claims(spark, {"number": 1}), evidence(spark, {})
    plan = verdicts.verified(c, e)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and "Expand" not in plan and plan.count("unboundedpreceding$(), -1") >= 2


def test_stance_of_parties_by_kind(spark):
    c = claims(spark, {"kind": "event"}, {"kind": "statement"}, {"kind": None})
    e = evidence(spark, *(s(i, "supports", 1, is_party=True, has_primary=True) for i in (1, 2, 3)), *(s(i, "supports", 2, is_party=None) for i in (1, 2, 3)), *(s(i, "supports", None, has_primary=None) | {"article_id": None} for i in (1, 2, 3)))
    got = {r.claim_id: (r.supports, r.reports, r.chains, r.has_primary, r.has_refutation) for r in verdicts.judged(c, e).collect()}
    assert got == {1: (1, 1, 2, False, False), 2: (2, 0, 2, True, False), 3: (2, 0, 2, True, False)}
