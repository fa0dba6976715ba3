from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from lensmill.llm import calibrate

POOL = "id string, app_id bigint, subset string, predicted string, review string, category string, p double"
TARGET = "app_id bigint, predicted string, target_share double, min_rows bigint, sample_size bigint, available bigint"


def test_pivotal_keeps_probabilities_and_sums():
    p = np.array([0.2, 0.7, 0.6, 0.5, 0.0, 1.0])
    hits = np.zeros(6)
    for s in range(3_000):
        out = calibrate.pivotal(p, np.random.default_rng(s))
        assert set(out.tolist()) <= {0.0, 1.0} and out.sum() == 3
        hits += out
    assert hits / 3_000 == pytest.approx(p, abs=0.035)


def test_pivotal_leaves_at_most_one_open():
    out = calibrate.pivotal(np.full(7, 0.3), np.random.default_rng(0))
    assert ((out > 0) & (out < 1)).sum() == 1 and out.sum() == pytest.approx(2.1)
    assert len(calibrate.pivotal(np.zeros(0), np.random.default_rng(0))) == 0


def test_tilt_meets_overlapping_targets():
    counts = np.array([100.0, 200.0, 50.0, 80.0])
    member = np.array([[1, 0, 0], [0, 1, 0], [1, 1, 0], [0, 0, 1]])
    p = calibrate.tilt(counts, member, np.array([40.0, 60.0, 80.0]))
    assert (p >= 0).all() and (p <= 1).all()
    assert counts * p @ member == pytest.approx([40, 60, 80], abs=1e-6)


def test_tilt_takes_all_where_too_little_is_there():
    p = calibrate.tilt(np.array([5.0, 100.0]), np.eye(2), np.array([20.0, 10.0]))
    assert p.tolist() == pytest.approx([1.0, 0.1])
    assert calibrate.tilt(np.array([5.0]), np.eye(1), np.array([0.0])).tolist() == [0.0]


def pool(spark, rows):
    return spark.createDataFrame([(i, a, "random", c, t, "clash", 2.0) for i, a, c, t in rows], POOL)


def test_gaps(spark):
    rows = [("1", 1, " Bugs", "x"), ("1", 1, "bugs", "x"), ("2", 1, "BUGS\t", "x"), ("3", 1, "bugs", " \n"), ("4", 1, None, "x"), (None, 1, "bugs", "x"), ("5", None, "bugs", "x"), ("6", 1, "story", None)]
    targets = spark.createDataFrame([(1, "bugs", 0.5, 0, 4, 9), (1, "story", 0.1, 1, 4, 9), (1, "price", 0.0, 0, 4, 9), (2, "bugs", 0.5, None, 10, 9), (1, "audio", None, None, None, 9)], TARGET)
    got = {(r.app_id, r.predicted): (r.wanted, r.available, r.gap) for r in calibrate.cell_report(pool(spark, rows), targets).collect()}
    assert got == {(1, "bugs"): (2, 2, 0), (1, "story"): (1, 0, 1), (1, "price"): (0, 0, 0), (2, "bugs"): (5, 0, 5), (1, "audio"): (0, 0, 0)}


def test_found_cells_come_from_the_draw(spark, tmp_path, monkeypatch):
    from lensmill.llm import queries

    rows = [(f"{c}{i}", 1, c, "x") for c, n in (("bugs", 30), ("story", 3), ("price", 8)) for i in range(n)] + [("bugs0", 1, "Story ", "x")]
    pool(spark, rows).write.parquet(f"{tmp_path}/sampled_review.parquet")
    cells = [(1, "bugs", 0.5, 0, 20, 9), (1, "story", 0.3, 0, 20, 9), (1, " STORY", 0.0, 2, 20, 9), (1, "price", 0.1, 9, 20, 9), (1, "audio", 0.0, 0, 20, 9), (None, "bugs", 0.5, 0, 20, 9), (2, "bugs", 0.5, 0, 20, 9)]
    spark.createDataFrame(cells, TARGET).write.parquet(f"{tmp_path}/sample_target.parquet")
    draws, real = [], calibrate.drawn_from
    monkeypatch.setattr(calibrate, "drawn_from", lambda *a: draws.append(a) or real(*a))
    got = [tuple(r) for r in queries.p4_found(spark, str(tmp_path)).collect()]
    assert len(draws) == 1 and sorted(got, key=str) == [(1, "price"), (1, "story"), (2, "bugs"), (None, "bugs")]
    report = {(r.app_id, r.predicted): (r.wanted, r.available, r.drawn) for r in calibrate.draw_report(*queries._sampling(spark, str(tmp_path))).collect()}
    assert report[1, "bugs"][:2] == (10, 30) and 9 <= report[1, "bugs"][2] <= 14 and report[1, "price"] == (9, 8, 8) and report[1, "story"] == (6, 4, 4) and report[2, "bugs"] == (10, 0, 0)


def test_sample_has_the_shares_and_is_repeatable(spark):
    rows = [(f"{a}-{c}-{i}", a, c, "x") for a in (1, 2) for c, n in (("bugs", 300), ("story", 40), ("price", 8)) for i in range(n)]
    rows += [("1-bugs-0", 1, "story", "x"), ("1-bugs-0", 1, "bugs", "x"), ("9", 3, "bugs", "x")]
    targets = spark.createDataFrame([(a, c, s, m, 50, 9) for a in (1, 2) for c, s, m in (("bugs", 0.6, 0), ("story", 0.2, 0), ("price", 0.02, 5))], TARGET)
    draw = lambda seed, parts: sorted((r.app_id, r.id, r.category) for r in calibrate.sampled(pool(spark, rows).repartition(parts), targets, seed).collect())
    got = draw(1, 1)
    assert got == draw(1, 5) and got != draw(2, 1)
    cells = Counter((a, c) for a, _, c in got)
    for a in (1, 2):
        assert abs(cells[a, "bugs"] - 30) <= 1 and abs(cells[a, "story"] - 10) <= 1 and cells[a, "price"] >= 5


def test_many_chunks_give_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "CHUNK_UNITS", 10)
    rows = [(str(i), 1, "bugs" if i % 3 else "story", "x") for i in range(90)]
    targets = spark.createDataFrame([(1, "bugs", 0.5, 0, 20, 9), (1, "story", 0.5, 0, 20, 9)], TARGET)
    assert Counter(r.category for r in calibrate.sampled(pool(spark, rows), targets).collect()) == {"bugs": 10, "story": 10}


@pytest.mark.parametrize("chunk", [1, 7, 10**6])
def test_floors_are_topped_up_in_the_order_of_the_seed(spark, chunk):
    """Spans of a cell give the same items as ranking the whole cell."""
    rows = spark.range(400).selectExpr("cast(id % 2 as bigint) as app_id", "cast(id as string) as id", "if(id % 7 < 3, 'a', 'b') as category", "cast(if(id % 7 < 3, 23, 500) as bigint) as missing")
    got = sorted((r.app_id, r.id) for r in calibrate.first_of_cells(rows, 3, chunk).collect())
    cells = {}
    for r in rows.withColumn("place", calibrate._place(3)).collect():
        cells.setdefault((r.app_id, r.category), []).append((r.place, r.id))
    want = sorted((app, i) for (app, c), own in cells.items() for _, i in sorted(own)[: 23 if c == "a" else 500])
    assert got == want and calibrate.first_of_cells(rows.limit(0), 3, chunk).count() == 0


def test_large_floors_are_met(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "CHUNK_UNITS", 20)
    rows = [(f"{c}{i}", 1, c, "x") for c in ("bugs", "story") for i in range(150)]
    targets = spark.createDataFrame([(1, "bugs", 0.9, 0, 10, 9), (1, "story", 0.1, 120, 10, 9)], TARGET)
    report = {r.predicted: r for r in calibrate.draw_report(pool(spark, rows), targets).collect()}
    assert report["story"].drawn >= 120 and report["bugs"].drawn == 9 and abs(report["bugs"].drawn_share + report["story"].drawn_share - 1) < 1e-9


def test_empty(spark):
    targets = spark.createDataFrame([(1, "bugs", 0.5, 0, 4, 9)], TARGET)
    assert calibrate.sampled(pool(spark, []), targets).count() == 0
    assert calibrate.cell_report(pool(spark, []), targets.limit(0)).count() == 0
