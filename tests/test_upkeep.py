"""Stored index and maintained summaries against making them anew, and what they read."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.operators import index, search
from lodestream.operators.store import Store
from lodestream.plans import upkeep_queries as q

WORDS = "alpha beta gamma delta lake port bridge north south west".split()


def rows(df):
    return [(r.doc_id, r.score) for r in df.collect()]


def test_index_follows_puts_and_deletes(spark):
    rng = random.Random(1)
    stored, live = index.Index(spark, buckets=4, span=8, first=2), {}
    for turn in range(3):
        put = {rng.randrange(120): " ".join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(60)} | ({500: None} if turn == 0 else {})
        gone = rng.sample(sorted(live), min(len(live), 15)) + [9999]
        stored.put(spark.createDataFrame(list(put.items()), "doc_id long, text string"), spark.createDataFrame([(g,) for g in gone], "doc_id long") if turn else None)
        live = {k: v for k, v in live.items() if not turn or k not in gone} | put
        docs = spark.createDataFrame(list(live.items()), "doc_id long, text string")
        for question, limit in (("alpha lake", 5), ("port", 200), ("beta nowhere north", 3))[: 1 + turn]:
            want = rows(search.bm25(docs, question, limit))
            assert rows(stored.search(question, limit)) == want
    assert rows(stored.search("", 5)) == rows(stored.search("nowhere", 5)) == []
    small = stored.compact()
    assert rows(small.search("alpha lake", 7)) == rows(stored.search("alpha lake", 7)) and small.store.read("void").count() == 0
    assert small.store.read("docs").count() == len(live)


def test_index_reads_buckets_of_its_terms_and_skips_blocks(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "lake lake lake").when(F.col("id") % 3 == 0, "lake and a great many other words that make it long").otherwise("other").alias("text"))
    stored = index.Index(spark, buckets=16, span=50, first=1)
    stored.put(docs)
    got = rows(stored.search("lake", 10))
    assert got == rows(search.bm25(docs, "lake", 10))
    assert stored.seen["read"] <= 2 < stored.seen["blocks"] == 80
    plan = stored.postings(["lake"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(gen" in plan and "bucket#" in plan.split("PartitionFilters")[1].split("]")[0] and "PushedFilters" in plan


def test_a_generation_counts_once_it_is_committed(spark, tmp_path):
    tables = {"x": ("k long, v string", "k")}
    store = Store(spark, str(tmp_path / "s"), tables, 4)
    assert store.read("x").count() == 0
    store.write("x", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    assert store.read("x").count() == 0
    assert store.commit() == 0 and store.read("x").count() == 2
    store.write("x", spark.createDataFrame([(3, "lost")], "k long, v string"))
    again = Store(spark, str(tmp_path / "s"), tables, 4)
    again.write("x", spark.createDataFrame([(3, "c")], "k long, v string"))
    again.commit()
    assert sorted((r.k, r.v, r.gen) for r in again.read("x").collect()) == [(1, "a", 0), (2, "b", 0), (3, "c", 1)]
    assert again.read("x", []).count() == 0


def anew(rows, dims):
    out = {}
    for key, dim, at, status in rows.values():
        if key is None:
            continue
        e = out.setdefault(key, [0, set(), [], {"click": 0, "error": 0, "view": 0}])
        e[0] += 1
        if dims.get(dim) is not None:
            e[1].add(dims[dim])
        e[2] += [at] if at is not None else []
        if status in e[3]:
            e[3][status] += 1
    return {k: (n, len(f), min(a, default=None), max(a, default=None), s["click"], s["error"], s["view"]) for k, (n, f, a, s) in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_summaries_follow_any_changes(spark, seed):
    rng = random.Random(seed)
    kept, live, dims = q.summaries_of(spark, buckets=8), {}, {}
    for turn in range(3):
        put = {rng.randrange(40): (rng.choice([1, 2, 3, 4]), rng.choice([None, 1, 2, 3, 9]), rng.choice([None, "2024-01-01", "2024-02-02", "2023-05-05"]), rng.choice(["click", "error", "view", "other"])) for _ in range(20)}
        gone = rng.sample(sorted(live), min(5, len(live))) + [777]
        moved = {k: rng.choice([None, 10, 20]) for k in rng.sample([1, 2, 3, 4], 2)}
        before = anew(live, dims)
        touched = kept.apply(spark.createDataFrame([(k, *v) for k, v in put.items()], q.ROW), spark.createDataFrame([(g,) for g in gone], "row_id long"), spark.createDataFrame(list(moved.items()), q.DIM))
        live, dims = {k: v for k, v in live.items() if k not in gone} | put, dims | moved
        want = anew(live, dims)
        said = {r.key: tuple(r)[1:] for r in touched.collect()}
        assert {r.key: tuple(r)[1:] for r in kept.current().collect()} == want
        assert all(want[k] == v for k, v in said.items()) and all(before.get(k) == v for k, v in want.items() if k not in said)
    assert kept.apply().count() == 0


def test_what_is_read_grows_with_the_change(spark):
    kept = q.summaries_of(spark, buckets=32)
    made = spark.range(3200).select(F.col("id").alias("row_id"), F.pmod("id", F.lit(400)).alias("key"), F.pmod("id", F.lit(50)).alias("dim"), F.lit("2024-01-01").alias("at"), F.lit("click").alias("status"))
    kept.apply(made, dimensions=spark.range(50).select(F.col("id").alias("dim"), F.col("id").alias("family")))
    reads = []
    for n, changes in ((1, 1), (4, 3), (3200, 400)):  # a row put again as it is changes nothing
        touched = kept.apply(made.where(F.col("row_id") < n).withColumn("status", F.lit("view")))
        reads.append(kept.seen["rows"] + kept.seen["states"])
        assert touched.count() == changes
    all_rows = kept.store.read("rows").count()
    assert reads[0] < 0.1 * reads[2] and reads[0] < reads[1] < 0.4 * reads[2] and reads[2] >= all_rows - 3200


def test_an_empty_store_under_shuffled_joins(spark):
    """Adaptive execution drops the stored side of a join that proves empty; how much was read is known all the same."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        kept = q.summaries_of(spark, buckets=4)
        rows = spark.createDataFrame([(i, i % 3, i % 2, "2024-01-01 00:00", "view") for i in range(20)], q.ROW)
        first = kept.apply(rows, dimensions=spark.createDataFrame([(0, 5), (1, 6)], q.DIM))
        assert {(r.key, r.articles, r.families, r.views) for r in first.collect()} == {(0, 7, 2, 7), (1, 7, 2, 7), (2, 6, 2, 6)} and kept.seen["links"] == 0
        kept.apply(deleted=spark.createDataFrame([(0,), (2,)], "row_id long"))
        assert {(r.key, r.articles) for r in kept.current().collect()} == {(0, 6), (1, 7), (2, 5)} and kept.seen["rows"] > 0
    finally:
        spark.conf.set(key, before)


def test_an_index_shuffles_no_texts_and_each_posting_once(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id long, text string")
    assert "Aggregate" not in index.greatest(docs)._jdf.queryExecution().optimizedPlan().toString()
    again = index.greatest(docs.unionByName(spark.createDataFrame([(1, "c"), (2, "a")], "doc_id long, text string")))
    assert sorted(map(tuple, again.collect())) == [(1, "c"), (2, "a"), (3, "b")]
    assert index.counted(pa.array([["a", "b", "a"], None, [], ["b"]])).to_pylist() == [[{"term": "a", "tf": 2}, {"term": "b", "tf": 1}], [], [], [{"term": "b", "tf": 1}]]
    store = Store(spark, f"{index.shared_folder(spark)}/placed", {"x": ("k long", "k")}, 4)
    before = spark.range(8, numPartitions=1).select(F.col("id").alias("k"))
    store.write("x", before, placed=True)
    store.commit()
    assert sorted(r.k for r in store.read("x", store.touched("x", before.where("k < 2"))).where("k < 2").collect()) == [0, 1]
