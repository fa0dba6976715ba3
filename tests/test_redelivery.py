from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lensmill.operators import redelivery

SCHEMA = "recommendationid string, snapshot_unix bigint, id string, bucket string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def test_repeats_are_exact_within_and_across_buckets(spark):
    width = redelivery.BUCKET_SECONDS
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 5 * width), ("c", 3 * width), ("d", None), ("d", 7), (None, 1), (None, 1), ("e", 1), ("", 1), ("", 1)]
    got = {r.id: r.copies for r in redelivery.repeated_ids(make(spark, rows), "recommendationid", "snapshot_unix").collect()}
    assert got == {"a": 2, "b": 2, "d": 2, "": 2}


def test_hot_identifier_and_many_others(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 25_000).cast("string")).alias("recommendationid"), (F.col("id") * 2_000).alias("snapshot_unix")
    )
    got = {r.id: r.copies for r in redelivery.repeated_ids(rows, "recommendationid", "snapshot_unix").collect()}
    want = {k: n for k, n in Counter("hot" if i % 3 == 0 else str(i % 25_000) for i in range(60_000)).items() if n > 1}
    assert got == want


def test_exactly_once_keeps_the_first_copy_and_all_columns(spark):
    rows = make(spark, [("a", 5), ("a", 2), ("b", 9), (None, 1), (None, 1), ("c", None), ("c", 4)])
    got = redelivery.exactly_once(rows, "recommendationid", "snapshot_unix")
    assert got.columns == rows.columns
    assert sorted(map(str, ((r[0], r[1]) for r in got.collect()))) == sorted(map(str, [("a", 2), ("b", 9), (None, 1), (None, 1), ("c", 4)]))


def test_one_shuffle_of_identifiers_does(spark):
    plan = redelivery.repeated_ids(make(spark, [("a", 1)]), "recommendationid", "snapshot_unix")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "clash" not in plan


def test_only_possible_repeats_are_shuffled_whole(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("recommendationid"), F.col("id").alias("snapshot_unix"))
    got = redelivery.exactly_once(rows.unionByName(rows.limit(50)), "recommendationid", "snapshot_unix")
    assert got.count() == 20_000
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_a_batch_reads_only_partitions_that_a_filter_points_to(spark, tmp_path):
    store = redelivery.Deliveries(spark, f"file://{tmp_path}/store", "recommendationid", "snapshot_unix", shards=8)
    store.accept(make(spark, [(f"m{i}", i) for i in range(500)]))
    scan = store.matching([(0, 3)])
    assert {(r.bucket, r.shard) for r in scan.collect()} == {(0, 3)}
    assert store.matching([]).count() == 0 and "PartitionFilters: [" in scan._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    assert redelivery.repeated_ids(make(spark, []), "recommendationid", "snapshot_unix").count() == 0
    assert redelivery.exactly_once(make(spark, []), "recommendationid", "snapshot_unix").count() == 0


def test_batches_let_each_identifier_through_once(spark, tmp_path):
    width = redelivery.BUCKET_SECONDS
    store = redelivery.Deliveries(spark, f"file://{tmp_path}/store", "recommendationid", "snapshot_unix", shards=4)
    take = lambda rows: sorted((r.recommendationid, r.snapshot_unix) for r in store.accept(make(spark, rows)).collect())
    assert take([("a", 1), ("a", 2), ("b", 3 * width), (None, 1)]) == [("a", 1), ("b", 3 * width)]
    assert take([("a", 9 * width), ("c", 5), ("c", 6), ("d", None)]) == [("c", 5), ("d", None)]
    assert take([("a", 1), ("b", 1), ("c", 1), ("d", 1)]) == []
    assert take([]) == []
    many = [(f"m{i}", i * 1_000) for i in range(3_000)]
    assert len(take(many)) == 3_000 and take(many[:50] + [("new", 1)]) == [("new", 1)]


def test_a_batch_that_failed_is_taken_in_again(spark, tmp_path, monkeypatch):
    store = redelivery.Deliveries(spark, f"file://{tmp_path}/store", "recommendationid", "snapshot_unix", shards=2)
    monkeypatch.setattr(store.markers, "add", lambda what: (_ for _ in ()).throw(OSError("lost")))
    try:
        store.accept(make(spark, [("a", 1)]))
    except OSError:
        pass
    monkeypatch.undo()
    assert store.accept(make(spark, [("a", 1)])).count() == 1
    assert store.accept(make(spark, [("a", 1)])).count() == 0
