"""Identities against a union of sets, versions against a walk, seeds and JSON against what was put in."""

import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lodestream.functions import opened
from lodestream.operators import identity, seeds
from lodestream.plans import intake_queries as q

ARTICLE = "article_id long, canonical_url string, normalized_url string, source_id long, guid string, content_hash string, title_norm string, changed_at string"


def arriving(seed, n=150):
    rng = random.Random(seed)
    pick = lambda kind, m: rng.choice([None, "", *(f"{kind}{rng.randrange(m)}" for _ in range(6))])
    return [(i, pick("u", 120), pick("u", 120), rng.choice([None, 1, 2, 12]), pick("g", 60), rng.choice([None, "a", "b"]), rng.choice(["t", "t", "s"]), rng.choice([None, "1", "2"])) for i in range(n)]


def united(rows):
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = {}
    for i, c, n, src, g, *_ in rows:
        for key in {("u", x) for x in (c, n) if x} | ({("g", src, g)} if g and src is not None else set()):
            a, b = find(i), find(seen.setdefault(key, i))
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("run", [identity.RUN, 7])
def test_identities_and_their_versions(spark, monkeypatch, seed, run):
    monkeypatch.setattr(identity, "RUN", run)
    rows = arriving(seed)
    df = spark.createDataFrame(rows, ARTICLE)
    found = identity.identities(df)
    want = united(rows)
    assert {r.article_id: r.identity for r in found.collect()} == want
    last, version, expected = {}, {}, {}
    for i, *_, h, title, at in rows:
        k = want[i]
        before = last.get(k)
        differs = before is None or (h and before[0] and h != before[0]) or title != before[1] or (at and before[2] and at != before[2])
        version[k] = version.get(k, 0) + bool(differs)
        expected[i] = (k, "new" if before is None else "update" if differs else "exact", version[k])
        last[k] = (h, title, at)
    assert {r.article_id: (r.identity, r.kind, r.version) for r in identity.arrivals(df, found).collect()} == expected


def test_a_long_chain_is_one_identity(spark):
    n = 300
    rows = [(i, f"u{i}", f"u{i + 1}", None, None, None, "t", None) for i in random.Random(3).sample(range(n), n)]
    assert {r.identity for r in identity.identities(spark.createDataFrame(rows, ARTICLE)).collect()} == {0}
    assert identity.identities(spark.createDataFrame([], ARTICLE)).count() == 0


def test_sources_do_not_share_ids(spark):
    rows = [(1, None, None, 1, "2:x", None, "t", None), (2, None, None, 12, "x", None, "t", None), (3, None, None, 1, "2:x", None, "t", None), (4, None, None, None, "x", None, "t", None)]
    assert {r.article_id: r.identity for r in identity.identities(spark.createDataFrame(rows, ARTICLE)).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_seeds_are_counted_while_they_are_read(spark):
    raw = spark.createDataFrame([(i, (q.SEED.replace(a, b) if a else q.SEED).replace("%", "1")) for i, (_, a, b) in enumerate(q.FAULTS)] + [(99, None), (98, '"x"')], "key long, seed string")
    watch = Observation("seeds")
    got = {r.key: r.faults for r in seeds.judged(raw, watch).collect()}
    assert got == {i: [name] if name else [] for i, (name, *_) in enumerate(q.FAULTS)} | {99: ["not an object"], 98: ["not an object"]}
    seen = watch.get
    assert (seen["rows"], seen["bad"], seen["not an object"]) == (len(got), sum(map(bool, got.values())), 3)
    assert all(seen[name] == 1 for name, *_ in q.FAULTS if name not in ("", "not an object"))
    plan = seeds.judged(spark.read.json(spark.sparkContext.parallelize(['{"seed": "{}"}']))).select(F.explode("faults"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Exchange" not in plan


def test_json_is_opened_as_far_as_it_goes(spark):
    base = json.dumps({"oneLiner": "a", "statements": [{"items": [{"text": "x", "status": 4}]}, 3], "unverified": {"a": 1}, "whyItMatters": {"text": "w", "generatedBy": "you"}, "disputed": [{"topic": "t", "positions": [{"number": 3, "asOf": "d", "citation": {"z": 1}}, {"citation": [1]}]}]})
    texts = {0: base, 1: json.dumps(base), 2: json.dumps(json.dumps(base)), 3: json.dumps(json.dumps(json.dumps(base))), 4: base[:20], 5: "[1]", 6: "7", 7: None, 8: "null", 9: '{"oneLiner": 5, "confirmed": [[1]]}', 10: ""}
    rows = {r.id: r.x for r in spark.createDataFrame(list(texts.items()), "id long, s string").select("id", opened.summary(opened.opened(F.col("s"))).alias("x")).collect()}
    assert rows[0] == rows[1] == rows[2] and {k for k, v in rows.items() if v is None} == {3, 4, 5, 6, 7, 8, 10}
    x = rows[0]
    assert (x.one_liner, x.unverified, tuple(x.why), [(g.party, [(i.text, i.status, i.claim_id) for i in g["items"]]) for g in x.statements]) == ("a", [], ("w", "rule"), [("unknown", [("x", "reported", "")])])
    assert [(p.number, p.as_of, p.citation) for p in x.disputed[0].positions] == [(3.0, "d", '{"z":1}'), (None, None, None)] and x.disputed[0].topic == "t"
    assert (rows[9].one_liner, rows[9].confirmed, rows[9].why) == ("", [], None)


def test_faults_are_found_once_and_over_all_cores(spark, tmp_path):
    spark.range(40).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = q.seed_faults(spark, str(tmp_path))
    conditions = [line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if line.strip(" :+-").startswith("Filter")]
    assert not any("variant" in line for line in conditions)  # else the rules run once more for each condition
    assert q.seeds_of(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    want = {(k, name) for k in range(40) if (name := q.FAULTS[k % len(q.FAULTS)][0])}
    assert {tuple(r) for r in made.collect()} == want


def test_summaries_are_opened_over_all_cores(spark, tmp_path):
    spark.range(80).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = q.opened_summaries(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() > 1
    assert {r.event_id for r in made.where("opened").collect()} == {k for k in range(80) if k % 6 < 4}


def test_a_round_of_identities_says_what_moved(spark, monkeypatch):
    """Each round writes one table, which holds what an article had before, so none is joined again to see whether anything moved."""
    tables, write = [], identity.written
    monkeypatch.setattr(identity, "written", lambda df: tables.append(df.columns) or write(df))
    rows = [(i, f"u{i // 2}", f"u{(i + 1) // 2}", None, None) for i in range(12)]
    a = spark.createDataFrame(rows, "article_id long, canonical_url string, normalized_url string, source_id long, guid string")
    assert {r.identity for r in identity.identities(a).collect()} == {0}
    assert 2 <= len(tables[1:]) <= 6 and all("old" in columns for columns in tables[1:])
