from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lensmill import shared


@pytest.mark.parametrize("rows", [100_000, 3])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_joins_agree_whether_broadcast_or_salted(spark, rows, how):
    big = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 20).alias("k"), "id").unionByName(spark.range(2).select(F.lit(None).cast("bigint").alias("k"), "id"))
    small = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = shared.checked_join(big, small, ["k"], how, rows)
    want = big.join(small, "k", how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_places_are_those_of_the_order(spark):
    rows = spark.range(1_000).select(F.format_string("%04d", (F.col("id") * 7919) % 1_000).alias("k"))
    got = shared.numbered(rows, "k", "place")
    assert [(r.k, r.place) for r in got.orderBy("place").collect()] == [(f"{i:04d}", i) for i in range(1_000)]
    assert shared.numbered(rows.limit(0), "k", "place").count() == 0


def test_small_scans_are_spread_and_shuffled_rows_are_not(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t")
    spread = shared.spread(scan)
    assert "Exchange" in spread._jdf.queryExecution().executedPlan().toString() and sorted(r[0] for r in spread.collect()) == list(range(100))
    assert shared.spread(scan.repartition(2)) is not None and shared.at_most(scan, 100) and not shared.at_most(scan, 99)


def test_lineage_is_cut_in_the_shared_folder(spark):
    folder = shared.shared_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    assert "Exchange" not in shared.cut(spark.range(10).repartition(3))._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    """Plan shape: a count by language reads only what it needs."""
    from lensmill.operators import rates, reviews

    spark.createDataFrame([("1", 1, "en", "x", 1, True, 1, 0.5, 1, 1, "{}")], "recommendationid string, appid bigint, language string, review string, timestamp_created bigint, voted_up boolean, votes_up bigint, weighted_vote_score double, timestamp_updated bigint, snapshot_unix bigint, raw_json string").write.parquet(f"{tmp_path}/c")
    rows = reviews.with_defaults(reviews.latest_by_id(spark.read.parquet(f"{tmp_path}/c"), ["recommendationid", "language", "review"]))
    plan = rates.language_histogram(rows)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(recommendationid)" in plan and "raw_json" not in plan and "voted_up" not in plan
