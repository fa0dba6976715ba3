from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lensmill.operators import incremental

ROWS = "appid bigint, recommendationid string, timestamp_created bigint, timestamp_updated bigint, snapshot_unix bigint, extra string"
MARKS = "app_id bigint, max_created bigint, updated_unix bigint"
CRAWLS = "id bigint, app_id bigint, snapshot_unix bigint, finished_unix bigint"


def pending(spark, rows, marks, crawls=()):
    runs = incremental.last_runs(spark.createDataFrame(list(marks), MARKS), spark.createDataFrame(list(crawls), CRAWLS))
    got = incremental.pending_keys(spark.createDataFrame([(*r, "x") for r in rows], ROWS), runs)
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_what_is_pending(spark):
    rows = [
        (1, "old", 50, 50, 90), (1, "new", 101, None, 120), (1, "edited", 50, 150, 95), (1, "late", 40, 40, 130), (1, "again", 50, 50, 90), (1, "again", 50, 50, 140),
        (1, "at the mark", 100, 100, 90), (1, "no times", None, None, 90), (1, "no times, late", None, None, 111), (2, "unmarked", 1, 1, 1), (3, "zero mark", 1, 1, 1), (1, "no snapshot", 1, 1, None),
    ]
    got = pending(spark, rows, [(1, 100, 110), (1, 90, 105), (3, 0, 500)], [(1, 1, 90, None), (2, 1, 100, 109)])
    assert got == {(1, "new"), (1, "edited"), (1, "late"), (1, "no times, late"), (1, "no snapshot"), (2, "unmarked"), (3, "zero mark")}


def test_empty_tables_and_nulls(spark):
    assert pending(spark, [], []) == set()
    assert pending(spark, [(None, None, None, None, None), (None, None, None, None, None)], [(None, 5, 5)]) == {(None, None)}


def test_null_run_ends_and_keys(spark, tmp_path):
    rows = [(1, "old", 50, 50, 90), (1, "new", 150, 150, 90), (2, None, 50, 50, 90), (2, None, 60, 60, 80), (2, "done", 50, 50, 90)]
    # app 1 has a mark, but no run end: nothing counts as delivered; app 2 rereads from 80, as a crawl was open
    assert pending(spark, rows, [(1, 100, None), (2, 100, 110)], [(1, 2, 80, None)]) == {(1, "old"), (1, "new")}
    top_up = incremental.TopUp(spark, f"file://{tmp_path}/state")
    frame = spark.createDataFrame([(1, None, 5, 5, 90, "a"), (None, "x", 5, 5, 90, "b"), (1, "y", None, None, None, "c")], ROWS)
    assert top_up.run(frame).count() == 3
    assert top_up.run(frame).count() == 0
    assert [r.extra for r in top_up.run(frame.unionByName(spark.createDataFrame([(1, None, 9, 9, 95, "d")], ROWS))).collect()] == ["d"]


def test_low_water_is_the_oldest_open_transaction(spark):
    runs = incremental.last_runs(spark.createDataFrame([(1, 100, 110), (2, 7, 8)], MARKS), spark.createDataFrame([(1, 1, 80, None), (2, 1, 90, 300), (3, 1, 50, 60), (4, 1, 120, None), (5, 2, 3, 4)], CRAWLS))
    assert {r.app_id: r.low_water for r in runs.collect()} == {1: 80, 2: 9}


def test_pending_reviews_are_the_latest_copies(spark):
    rows = spark.createDataFrame([(1, "a", 1, 5, 10, "first"), (1, "a", 1, 9, 11, "second"), (1, "b", 1, 1, 3, "done")], ROWS)
    runs = incremental.last_runs(spark.createDataFrame([(1, 4, 6)], MARKS))
    assert [tuple(r)[1:] for r in incremental.pending_reviews(rows, runs).collect()] == [("a", 1, 9, 11, "second")]


def test_runs_take_in_everything_exactly_once(spark, tmp_path):
    top_up = incremental.TopUp(spark, f"file://{tmp_path}/state")
    first = spark.createDataFrame([(1, "a", 1, 1, 10, ""), (1, "a", 1, 1, 11, ""), (1, "b", 2, 2, 10, "")], ROWS)
    assert {r.recommendationid for r in top_up.run(first).collect()} == {"a", "b"}
    # an edit, a redelivery, a new review and one whose crawl had begun earlier
    second = first.unionByName(spark.createDataFrame([(1, "a", 1, 7, 12, "edit"), (1, "b", 2, 2, 12, ""), (1, "c", 3, 3, 12, ""), (1, "d", 1, 1, 11, "")], ROWS))
    got = top_up.run(second)
    assert sorted((r.recommendationid, r.timestamp_updated) for r in got.collect()) == [("a", 7), ("c", 3), ("d", 1)]
    assert top_up.run(second).count() == 0


def test_a_run_that_failed_counts_as_never_made(spark, tmp_path, monkeypatch):
    top_up = incremental.TopUp(spark, f"file://{tmp_path}/state")
    rows = spark.createDataFrame([(1, "a", 1, 1, 10, "")], ROWS)
    monkeypatch.setattr(top_up, "_commit", lambda what: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        top_up.run(rows)
    monkeypatch.undo()
    assert top_up.ledger().count() == 0
    assert top_up.run(rows).count() == 1
    assert top_up.run(rows.withColumn("extra", F.lit("other"))).count() == 0


def test_two_writers_cannot_commit_the_same_run(spark, tmp_path):
    one, two = (incremental.TopUp(spark, f"file://{tmp_path}/state") for _ in range(2))
    one._commit({"run": "x", "number": 0, "low_water": 0})
    with pytest.raises(RuntimeError):
        two._commit({"run": "y", "number": 0, "low_water": 0})


def test_older_versions_of_a_processed_review_are_not_new(spark, tmp_path):
    top_up = incremental.TopUp(spark, f"file://{tmp_path}/state")
    first = spark.createDataFrame([(1, "a", 5, 20, 10, "newest")], ROWS)
    assert top_up.run(first).count() == 1
    late = spark.createDataFrame([(1, "a", 5, 9, 11, "older, delivered later"), (1, "a", None, None, 12, "no times"), (1, "b", 1, 1, 11, "")], ROWS)
    assert [r.recommendationid for r in top_up.run(late).collect()] == ["b"]


def test_the_ledger_is_compacted(spark, tmp_path):
    top_up = incremental.TopUp(spark, f"file://{tmp_path}/state", compact_every=2)
    for version in range(5):
        rows = spark.createDataFrame([(1, "a", 1, 10 + version, 10 + version, ""), (1, f"b{version}", 1, 1, 10 + version, "")], ROWS)
        assert top_up.run(rows).count() == 2 and top_up.run(rows).count() == 0
    assert top_up.ledger().where("__key = 'a'").count() == 1 and top_up.ledger().count() == 6


def test_abandoned_transactions_do_not_hold_the_low_water(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1, 1, 1_000, "")], ROWS)
    crawls = spark.createDataFrame([(1, 1, 10, None), (2, 1, 950, None), (3, 1, 990, 2_000)], CRAWLS)
    kept, dropped = incremental.TopUp(spark, f"file://{tmp_path}/one"), incremental.TopUp(spark, f"file://{tmp_path}/two", open_for=100)
    kept.run(rows, crawls), dropped.run(rows, crawls)
    assert (kept.low_water(), dropped.low_water()) == (10, 950)


def test_the_source_is_read_once_and_a_stored_ledger_agrees(spark, tmp_path):
    data = [(i % 5, f"r{i % 70}", i % 50, (i * 7) % 60, (i * 13) % 90, "") for i in range(400)]
    spark.createDataFrame(data, ROWS).coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    runs = incremental.last_runs(spark.createDataFrame([(0, 30, 40), (1, 0, 5), (2, 45, None), (3, 20, 60)], MARKS), spark.createDataFrame([(1, 3, 50, None)], CRAWLS))
    derived = incremental.pending_keys(rows, runs)
    assert derived._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    stored = incremental.pending_keys(rows, runs, incremental.ledger_of_past_runs(rows, runs))
    assert sorted(derived.collect()) == sorted(stored.collect())
