from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lensmill.operators import evaluate, sampling
from lensmill.schema import CLASSIFICATIONS, LABELS


def labels(spark, *rows):
    return spark.createDataFrame([(i, p, s, False, "high", subset, amb) for i, p, s, subset, amb in rows], LABELS)


def classes(spark, *rows):
    return spark.createDataFrame([(i, 1, m[0], 0.9, m, "core-3", a) for i, m, a in rows], CLASSIFICATIONS)


@pytest.fixture(scope="module")
def pairs(spark):
    have = labels(spark, ("1", "bugs", ["price"], "random", False), ("2", "bugs", None, "random", True), ("3", "story", [], "stratified", False), ("4", "audio", None, "random", None))
    return evaluate.compared(have, classes(spark, ("1", ["bugs", "price"], "a"), ("2", ["performance"], "a"), ("3", ["story", "audio"], "b"), ("9", ["bugs"], "c")))


def test_join_keeps_unmatched_labels(pairs):
    got = {r.id: r.predicted for r in pairs.collect()}
    assert got == {"1": "bugs", "2": "performance", "3": "story", "4": None}
    assert evaluate.provenance(pairs).first().asDict() == {"anchors": ["a", "b"], "mixed": True}


def test_counters_and_scores(pairs):
    got = {r.category: r for r in evaluate.category_scores(evaluate.category_counters(pairs)).collect()}
    assert (got["bugs"].ref_primary, got["bugs"].pred_primary, got["bugs"].agreed) == (2, 1, 1)
    assert got["bugs"].precision == 1.0 and got["bugs"].recall == 0.5 and got["bugs"].f1 == pytest.approx(2 / 3)
    assert got["audio"].ref_mentions == 0 and got["audio"].f1 == 0.0 and got["audio"].recall is None
    macro = evaluate.macro_f1(evaluate.category_scores(evaluate.category_counters(pairs))).first()
    assert macro.categories == 3 and macro.macro_f1 == pytest.approx((2 / 3 + 1 + 1) / 3)


def test_slices(pairs):
    got = {(r.subset, r.ambiguous, r.whole): (r.agreed, r.compared) for r in evaluate.slices(pairs).collect()}
    assert got == {("random", None, 1): (1, 2), ("stratified", None, 1): (1, 1), ("random", False, 0): (1, 1), ("random", True, 0): (0, 1), ("stratified", False, 0): (1, 1)}


@pytest.mark.parametrize(("rows", "want"), [([("bugs", 40), ("performance", 7), ("verdict", 3)], ("performance", 7)), ([("verdict", 1)], None), ([(c, 4) for c in ("performance", "gameplay", "genre", "story", "audio")], None)])
def test_mistaken_for(spark, rows, want):
    matrix = spark.createDataFrame([("bugs", p, n) for p, n in rows], "primary string, predicted string, n bigint")
    got = [(r.taken_for, r.n) for r in evaluate.mistaken_for(matrix).collect()]
    assert got == ([want] if want else [])


def test_pooling_adds_counts(spark):
    rows = spark.createDataFrame([("bugs", 10, 9), ("bugs", 90, 1), ("unknown", 5, 5)], "category string, n bigint, hit bigint")
    got = evaluate.pooled(rows).collect()
    assert len(got) == 1 and got[0].hit / got[0].n == pytest.approx(0.1)


def test_paired_verdicts(spark):
    make = lambda rights: spark.createDataFrame([(str(i), r) for i, r in enumerate(rights)], "id string, right boolean")
    got = evaluate.paired(make([True] * 2 + [False] * 12 + [True]), make([False] * 2 + [True] * 12 + [True])).first()
    assert (got.gained, got.lost) == (12, 2) and got.p == pytest.approx(0.012939453125)
    with pytest.raises(Exception, match="different reviews"):
        evaluate.paired(make([True]), make([True, False])).collect()


def test_returned_labels_are_checked(spark, tmp_path):
    drawn = spark.createDataFrame([("1", "random"), ("2", "random"), ("3", "stratified")], "id string, subset string")
    for name, rows in (("a", [{"id": "1", "primary": "bugs", "secondary": ["nonsense"]}, {"id": "8", "primary": "bugs"}]), ("b", [{"id": "1", "primary": "story"}, {"id": "2", "primary": "audio"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    got = evaluate.read_labels(spark, str(tmp_path))
    checks = {k: [r[0] for r in v.collect()] for k, v in evaluate.returned(drawn, got).items()}
    assert checks == {"unknown": ["8"], "missing": ["3"], "duplicate": ["1"], "bad_category": ["nonsense"]}
    assert [(r.id, r.primary, r.subset) for r in evaluate.accepted(drawn, got).collect()] == [("1", "bugs", "random"), ("2", "audio", "random")]


def pool(spark, rows):
    return spark.createDataFrame([(str(i), a, c, [c]) for i, (a, c) in enumerate(rows)], "recommendationid string, appid bigint, primary_category string, mentions array<string>")


def test_round_robin_takes_apps_in_turn(spark):
    got = sampling.stratified(pool(spark, [(1, "bugs")] * 5 + [(2, "bugs")] * 2 + [(3, "bugs")]), 4)
    assert sorted(r.appid for r in got.collect()) == [1, 1, 2, 3]


def test_draws_are_disjoint_and_repeatable(spark):
    rows = pool(spark, [(a, c) for a in (1, 2) for c in ("bugs", "story") for _ in range(20)])
    a, b = (sorted(map(tuple, sampling.drawn(rows.repartition(n), 5, 6).collect())) for n in (1, 7))
    assert a == b and len({r[0] for r in a}) == len(a) == 2 * 5 + 2 * 6
    assert sorted(map(tuple, sampling.drawn(rows, 5, 6, seed=2).collect())) != a


def test_quotes_start_with_two_of_the_top(spark):
    rows = pool(spark, [(1, "bugs")] * 8)
    top = rows.select("recommendationid", "appid", F.col("recommendationid").cast("int").alias("rank"), "mentions").where("rank < 3")
    got = [r.recommendationid for r in sampling.quoted(sampling.shortlist(rows, 5), top, 5).orderBy("quote").collect()]
    assert got[:2] == ["0", "1"] and len(got) == len(set(got)) == 5


def test_sample_files(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), 1, "bugs", "random", f"text {i}") for i in range(5)], "recommendationid string, appid bigint, predicted string, subset string, review string")
    assert sampling.write_sample(rows, str(tmp_path), 2) == 3
    assert json.loads((tmp_path / "batches/batch-000.json").read_text()) == [{"id": "0", "review": "text 0"}, {"id": "1", "review": "text 1"}]
    assert json.loads((tmp_path / "sample.json").read_text())[4]["predicted"] == "bugs"
    assert [r.batch for r in sampling.batches(rows, 2).orderBy("recommendationid").collect()] == [0, 0, 1, 1, 2]
    assert sampling.smallest(rows, "review", 0).count() == 0
