from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lensmill import report
from lensmill.operators import rates, reviews
from lensmill.schema import CAPTURE, CATEGORY_IDS, CLASSIFICATIONS


def parse(spark, *objects):
    rows = spark.createDataFrame([(1, o if isinstance(o, str) else json.dumps(o)) for o in objects], "appid bigint, raw_json string")
    return [r.asDict() for r in reviews.parsed(rows).collect()]


def test_json_is_read_strictly(spark):
    got = parse(spark, {"recommendationid": "1", "votes_up": "7", "votes_funny": 3, "weighted_vote_score": "0.5238095", "voted_up": "yes", "language": 5, "author": {"num_reviews": 4_294_967_296, "steamid": "9"}, "timestamp_created": 1.5})[0]
    assert (got["votes_up"], got["votes_funny"], got["weighted_vote_score"], got["voted_up"], got["language"]) == (None, 3, 0.5238095, None, None)
    assert (got["author_num_reviews"], got["author_steamid"], got["timestamp_created"], got["appid"]) == (None, "9", None, 1)


def test_json_scores_are_numbers_or_strings_and_extra_fields_survive(spark):
    a, b = parse(spark, {"recommendationid": "1", "weighted_vote_score": 0, "more": {"x": [1]}}, {"recommendationid": "2", "weighted_vote_score": "nonsense"})
    assert a["weighted_vote_score"] == 0.0 and json.loads(a["raw_json"])["more"] == {"x": [1]}
    assert b["weighted_vote_score"] is None


def test_rows_without_an_id_or_without_json_are_dropped(spark):
    assert parse(spark, {"recommendationid": 5}, "not json", {}, "[]") == []


def test_capture_round_trip(spark, tmp_path):
    row = [{"recommendationid": "1", "review": "fine", "voted_up": True}, {"recommendationid": "2", "review": " \n "}]
    rows = spark.createDataFrame([(3, json.dumps(o)) for o in row], "appid bigint, raw_json string")
    reviews.write_capture(reviews.parsed(rows).withColumn("snapshot", F.lit(5)), f"{tmp_path}/c")
    back = spark.read.parquet(f"{tmp_path}/c")
    assert set(CAPTURE.names) | {"snapshot"} == set(back.columns) and back.count() == 2
    assert [r.recommendationid for r in reviews.with_defaults(back).collect()] == ["1"]


COPIES = "recommendationid string, timestamp_created bigint, timestamp_updated bigint, snapshot_unix bigint, review string, appid bigint"


def test_latest_copy(spark):
    rows = spark.createDataFrame([("1", 1, 5, 9, "old", 1), ("1", 1, 7, 8, "new", 1), ("2", 3, None, 1, "a", 1), ("2", 3, None, 1, None, 1), (None, 1, 1, 1, "x", 1)], COPIES)
    got = {r.recommendationid: r.review for r in reviews.latest_by_id(rows, ["recommendationid", "review"]).collect()}
    assert got == {"1": "new", "2": "a"}


@pytest.fixture(scope="module")
def six(spark):
    """Six reviews with known counts: five that say something and a blank one."""
    data = [
        ("1", 1, "english", "crashes on launch", 1700000000, False, 900, 900.0), ("2", 1, "english", "crashes on launch", 1700000000, False, 3, 3.0),
        ("3", 1, "english", "runs at four frames", 1700000000, False, 1, 1.0), ("4", 1, "schinese", "great game", 1700000000, True, 0, 0.0),
        ("5", 1, "english", "great game too", 1700000000, True, 0, 0.0), ("6", 1, "english", "   ", 1700000000, True, 0, 0.0),
    ]
    rows = spark.createDataFrame(data, "recommendationid string, appid bigint, language string, review string, timestamp_created bigint, voted_up boolean, votes_up bigint, weighted_vote_score double")
    tags = [("1", "bugs"), ("2", "bugs"), ("3", "performance"), ("4", "verdict"), ("5", "verdict"), ("6", "verdict")]
    classes = spark.createDataFrame([(i, 1, c, 1.0, [c], "core-3", "descriptions") for i, c in tags] + [("1", 1, "story", 2.0, ["story"], "core-2", "old")], CLASSIFICATIONS)
    return reviews.with_defaults(rows), rates.current_assignments(classes)


def test_six_reviews(six):
    rows, tags = six
    got = {r.category: r for r in rates.category_rates(rows, tags, 2).collect()}
    assert len(got) == len(CATEGORY_IDS)
    assert (got["bugs"].mention_count, got["performance"].mention_count, got["verdict"].mention_count, got["story"].mention_count) == (2, 1, 2, 0)
    assert (got["verdict"].positive_mentions, got["bugs"].positive_mentions, got["bugs"].reviews, got["bugs"].top_reviews) == (2, 0, 5, 2)
    assert got["bugs"].bias_factor == pytest.approx(2.5) and got["story"].bias_factor is None and got["story"].positive_share is None
    assert {(r.language, r.reviews) for r in rates.language_histogram(rows).collect()} == {("english", 4), ("schinese", 1)}
    assert [r.recommendationid for r in rates.top_of_pile(rows, 2).orderBy("rank").collect()] == ["1", "2"]
    assert [r.category for r in rates.headline_bias(rates.category_rates(rows, tags, 2)).collect()] == ["bugs"]
    assert [(r.month, r.reviews, r.positive) for r in rates.months(rows).collect()] == [("2023-11", 5, 2)]


def test_stale_classifications_are_refused(spark):
    with pytest.raises(ValueError, match="anchors"):
        rates.current_assignments(spark.createDataFrame([], "recommendationid string, spine_version string"))


def test_the_page_escapes_what_reviews_say(six):
    rows, tags = six
    nasty = rows.withColumn("review", F.when(F.col("recommendationid") == "1", F.lit("<script>alert('x')</script>")).otherwise(F.col("review")))
    page = report.render(report.build(nasty, tags, [1], names={1: "<b>Game</b>"}))
    assert "<script>alert" not in page and "&lt;script&gt;alert(&#39;x&#39;)" in page
    assert "&lt;b&gt;Game&lt;/b&gt;" in page and "Bugs and crashes" in page and "has not been measured" in page


def test_headline_of_the_page_needs_enough_of_the_top():
    cats = [{"category": c, "slot": k, "mention_count": m, "top_mention_count": t, "bias_factor": (t / 50) / (m / 100_000)} for k, (c, m, t) in enumerate([("performance", 20, 1), ("bugs", 3000, 12), ("gameplay", 40000, 20)])]
    assert "bugs and crashes 8.0 times" in report.headline(report.App(1, top_reviews=50, categories=cats))
    assert "same things" in report.headline(report.App(1))


def test_charts_need_enough_points():
    assert report.month_chart([{"month": "2024-01", "reviews": 3}]) == ""
    assert report.sparkline([("a", 0.5), ("b", 0.5)]) == "" and "polyline" in report.sparkline([("a", 0.1), ("b", 0.5), ("c", 0.2)])
    assert report.thin_note({"ref_mentions": 20, "recall": 0.1, "taken_for": "bugs"}).count("Bugs") == 1
    assert report.thin_note({"ref_mentions": 5, "recall": 0.1}) == ""


def test_matrix_has_no_leader_between_equal_prints():
    def app(appid, rate):
        return report.App(appid, reviews=100_000, categories=[{"category": "bugs", "slot": 1, "mention_count": 3, "mention_rate": rate, "primary_share": 0, "positive_share": None, "top_mention_rate": 0, "bias_factor": None, "top_mention_count": 0}])

    assert "class=leads" not in report._matrix([app(1, 0.0401), app(2, 0.0399)])
    assert "class=leads" not in report._matrix([app(1, 3e-5), app(2, 2e-5)])
    assert "class=leads" in report._matrix([app(1, 0.04), app(2, 0.02)])


def test_brief_lists_every_category_once_in_order():
    brief = report.labelling_brief()
    at = [brief.index(f"\n{c}: ") for c in CATEGORY_IDS]
    assert at == sorted(at)


def test_pooled_agreement_sums_counts():
    def app(agreed, compared, ref, pred, hit):
        low, high = report.interval(agreed, compared) or (None, None)
        cats = {"bugs": {"ref_mentions": ref, "pred_mentions": pred, "mention_agreed": hit, "recall": None, "taken_for": None}, "nonsense": {"ref_mentions": 99, "pred_mentions": 0, "mention_agreed": 0, "recall": None}}
        return report.App(1, agreement={"agreed": agreed, "compared": compared, "agreement": agreed / compared if compared else None, "low": low, "high": high, "macro_f1": None, "categories": cats, "slices": []})

    assert report.interval(24, 47) == pytest.approx((0.372, 0.647), abs=0.002) and report.interval(0, 0) is None
    got = report.pooled_agreement([app(9, 10, 4, 4, 4), app(1, 90, 6, 2, 1)])
    assert got["agreement"] == pytest.approx(0.1) and got["macro_f1"] == pytest.approx(2 * 5 / 16)
    assert report.pooled_agreement([app(9, 10, 4, 4, 4)]) is None and report.pooled_agreement([app(9, 10, 4, 4, 4), report.App(2)]) is None
    assert "Over all 2 apps" in report.render([app(9, 10, 4, 4, 4), app(1, 90, 6, 2, 1)])


def test_page_has_its_parts(six):
    rows, tags = six
    app = report.build(rows, tags, [1])[0]
    assert [q.votes for q in app.top][:2] == [900, 3] and app.top[0].mentions == ["bugs"] and app.top[0].positive is False
    app.captured, app.stated = 6, 7
    page = report.render([app])
    for part in ('id="app-1-bugs"', "The top of the pile", "class=\"legend\"", "of 6 captured and 7 stated", "not recommended", 'id="fold"', 'id="theme"', "beforeprint", "hashchange"):
        assert part in page, part
    assert "polyline" in report._categories(report.App(1, categories=app.categories, trends={"bugs": [("a", 0.1), ("b", 0.4), ("c", 0.2)]}))


def test_texts_stay_out_of_the_shuffle(spark, tmp_path):
    spark.createDataFrame([("1", 1, "en", "x", 1, 1, 1), ("1", 1, "en", " ", 1, 9, 1), ("2", 1, "en", None, 1, 1, 1)], "recommendationid string, appid bigint, language string, review string, timestamp_created bigint, timestamp_updated bigint, snapshot_unix bigint").write.parquet(f"{tmp_path}/c")
    copies = spark.read.parquet(f"{tmp_path}/c")
    columns = ["recommendationid", "appid", "language", "review", "timestamp_created"]
    slim = reviews.latest_by_id(copies, columns, text=False)
    assert {(r.recommendationid, r.filled) for r in slim.collect()} == {("1", False), ("2", False)}
    plan = slim._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.split("\n") if "Exchange hash" in line)
    assert "review" not in exchange and reviews.with_defaults(slim).count() == 0
    assert {r.review for r in reviews.latest_by_id(copies, columns).collect()} == {" ", None}


def test_turns_are_cut_before_their_exchange(spark):
    """The window over a category gets at most so many rows of it from each task."""
    from lensmill.operators import sampling

    rows = spark.range(100).selectExpr("cast(id as string) as recommendationid", "id % 9 as appid", "concat('c', id % 3) as primary_category", "array('bugs') as mentions")
    plan = sampling.stratified(rows, 5)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "hashpartitioning(primary_category" in line and "appid" not in line)
    assert "WindowGroupLimit" in plan[at + 1] and "Partial" in plan[at + 1]


def test_small_summaries(spark):
    from lensmill.operators import evaluate, incremental, sampling

    drawn = spark.createDataFrame([("1", 1, "stratified", "bugs"), ("2", 1, "stratified", "bugs"), ("3", 2, "stratified", "bugs"), ("4", 2, "random", "story")], "recommendationid string, appid bigint, subset string, predicted string")
    got = {(r.appid, r.category): (r.drawn, r.thin, r.short) for r in sampling.sample_summary(drawn, 3).collect()}
    assert got[1, "bugs"] == (2, False, False) and got[2, "story"] == (0, True, True) and len(got) == 2 * len(CATEGORY_IDS)
    sources = spark.createDataFrame([(1, "fitted:1", "b"), (2, "descriptions", "a"), (3, "fitted:1", "a")], "appid bigint, anchors string, produced_by string")
    assert tuple(evaluate.pooled_sources(sources).first()) == (3, ["descriptions", "fitted:1"], ["a", "b"])
    months = spark.createDataFrame([(1, "2024-01", 3, 1), (1, "2024-02", 1, 1), (2, "2024-01", 0, 0)], "appid bigint, month string, reviews bigint, positive bigint")
    assert {(r.appid, r.month): (r.positive_share, r.share) for r in rates.month_rates(months).collect()} == {(1, "2024-01"): (1 / 3, 0.75), (1, "2024-02"): (1.0, 0.25), (2, "2024-01"): (None, None)}
    rows = spark.createDataFrame([(1, "gone", 5), (1, "gone", 6), (1, "here", 6), (1, "here", 10), (1, "new", 12), (2, "x", 1), (1, None, 1)], "appid bigint, recommendationid string, snapshot_unix bigint")
    crawls = spark.createDataFrame([(1, 10, 11), (1, 20, None), (1, 3, 4)], "app_id bigint, snapshot_unix bigint, finished_unix bigint")
    assert [tuple(r) for r in incremental.vanished(rows, crawls).collect()] == [(1, "gone", 6)]


def test_shards_are_listed_in_order(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(4).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("recommendationid", "review", "appid", "raw_json") else (F.col("id") if f.name == "appid" else F.col("id").cast("string")).alias(f.name) for f in reviews.CAPTURE.fields])
    reviews.write_capture(rows.withColumn("snapshot", F.lit(7)), f"{tmp_path}/c")
    found = reviews.shards_of(spark, f"{tmp_path}/c")
    assert found == sorted(found) and len(found) >= 4
    assert reviews.capture_scan(spark, f"{tmp_path}/c").count() == 4
