from __future__ import annotations

import random

from lensmill.llm import topn

SCHEMA = "appid bigint, recommendationid string, weighted_vote_score double, votes_up bigint, score string, rank int"


def brute(rows, n):
    best: dict = {}
    for app, i, s, v in rows:
        if i is not None:
            old = best.get((app, i), (0.0, 0))
            best[app, i] = (max(old[0], s or 0.0), max(old[1], v or 0))
    out = set()
    for app in {a for a, _ in best}:
        own = sorted((-s, -v, i) for (a, i), (s, v) in best.items() if a == app)
        out |= {(app, i) for _, _, i in own[:n]}
    return out


def found(spark, rows, n, heavy):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = [(r.appid, r.recommendationid) for r in topn.best_reviews(frame, n, heavy).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_hot_and_cold_groups_agree_with_brute_force(spark):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(40), f"{rng.randrange(900):03d}", rng.choice([None, 0.1, 0.5, 0.5, 0.9]), rng.choice([None, 0, 3, 3])) for _ in range(4_000)]
    rows += [(None, "x", 0.1, 1), (None, "y", 0.2, 1), (3, None, 0.9, 9)]
    want = brute(rows, 5)
    for heavy in (1, 500, 10**9):
        assert found(spark, rows, 5, heavy) == want


def test_ties_go_to_the_smaller_id_whatever_the_partitions(spark):
    rows = [(1, f"{i:03d}", 0.5, 1) for i in range(300)]
    for heavy in (1, 10**9):
        assert found(spark, rows, 3, heavy) == {(1, "000"), (1, "001"), (1, "002")}


def test_empty_and_small(spark):
    assert found(spark, [], 5, 1) == set()
    assert found(spark, [(1, "a", None, None)], 5, 1) == {(1, "a")}


def test_both_branches_read_one_exchange(spark, tmp_path):
    spark.range(2_000).selectExpr("if(id % 3 = 0, 1, id % 50) as appid", "cast(id as string) as recommendationid", "id / 7.0D as weighted_vote_score", "id % 5 as votes_up").write.parquet(f"{tmp_path}/t")
    best = topn.best_reviews(spark.read.parquet(f"{tmp_path}/t"), 5, 500)
    best.collect()
    plan = best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan and plan.count("rangepartitioning") == 1
    # what meets after the range sort are at most n rows of a group and partition
    assert "Partial" in plan.split("rangepartitioning")[0]
