from __future__ import annotations

import json
import urllib.error
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from lensmill.operators import planning
from lensmill.sources import pages
from lensmill.streaming import topup


def test_windows_cover_without_gap():
    got = planning.split_windows(0, 1_000_000, lambda a, b: (b - a) // 10 + 1, 20_000, 1_000)
    assert got[0][0] == 0 and got[-1][1] == 1_000_000
    assert all(x[1] + 1 == y[0] for x, y in zip(got, got[1:])) and all(n <= 20_000 for *_, n in got)
    assert planning.split_windows(0, 9, lambda a, b: 0) == [] and planning.split_windows(5, 4, lambda a, b: 1) == []


def test_plan_of_all_apps_is_the_plan_of_each(spark):
    rows = [(app, (i * i * 977) % 3_000_000) for app in (1, 2) for i in range(300 * app)]
    frame = spark.createDataFrame(rows, "appid bigint, timestamp_created bigint")
    got = planning.shard_plan(frame, F.min("at"), F.max("at"), target=50)
    for app in (1, 2):
        times = sorted(t for a, t in rows if a == app)
        want = planning.split_windows(times[0], times[-1], lambda a, b: sum(a <= t <= b for t in times), 50)
        assert sorted((r.start_date, r.end_date, r.expected) for r in got.where(F.col("appid") == app).collect()) == want
    assert all(r.disjoint for r in planning.disjoint(got).collect())
    overlap = spark.createDataFrame([(1, 0, 10, 1), (1, 10, 20, 1)], "appid bigint, start_date bigint, end_date bigint, expected bigint")
    assert not planning.disjoint(overlap).first().disjoint


@pytest.mark.parametrize(("rows", "expected", "short"), [(12600, 18184, True), (18297, 24340, True), (60, 200, True), (39276, 39278, False), (17, 20, False), (0, 0, False)])
def test_shortfall(spark, rows, expected, short):
    assert spark.range(1).select(planning.fell_short(F.lit(rows), F.lit(expected))).first()[0] is short


def test_state(spark, tmp_path):
    state = planning.CrawlState(spark, f"file://{tmp_path}/state")
    crawl = state.start_crawl(7, 100, "u", 30)
    state.put_shards(crawl, [(0, 9, 10), (10, 19, 20)])
    assert [r.expected for r in state.pending(crawl).collect()] == [20, 10]
    state.mark(crawl, 1, "running")
    assert {r.status for r in state.pending(crawl).collect()} == {"pending"}
    state.mark(crawl, 1, "done", 20, 2, "exhausted", 400)
    assert state.progress(crawl) == (1, 2) and state.watermark(7) is None
    with pytest.raises(RuntimeError):
        state.finish(7, crawl, 500)
    state.mark(crawl, 0, "done", 10, 1, "exhausted", 900)
    state.finish(7, crawl, 500)
    assert state.watermark(7) == 900
    empty = state.start_crawl(7, 200, "u", 0)
    state.finish(7, empty, 600)
    assert state.watermark(7) == 900 and state.read("crawl").where("finished_unix is null").count() == 0
    assert planning.topup_start(900) == 901 and planning.topup_start(None) == planning.EPOCH
    assert planning.crawl_tally(state.read("shard")).first().asDict() == {"crawl_id": 1, "rows": 30, "pages": 3, "short": 0}


def test_url_and_retry():
    url = pages.ReviewQuery(cursor="AoJ+/=&", window=(1, 2)).url("https://store.invalid", 5)
    assert "cursor=AoJ%2B%2F%3D%26" in url and "start_date=1" in url and "language=all" in url and "num_per_page=100" in url
    waits, answers = [], [urllib.error.HTTPError("u", 429, "", {"Retry-After": "7"}, None), urllib.error.HTTPError("u", 503, "", {}, None), ConnectionResetError(), urllib.error.URLError("down"), BytesIO(b'{"success": 1, "reviews": []}')]

    def opened(_, timeout):
        assert timeout == pages.TIMEOUT
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert pages.fetch("u", opened=opened, sleep=waits.append)["reviews"] == [] and waits == [7.0, 4.0, 8.0, 16.0]
    with pytest.raises(pages.NoSuchCorpus):
        pages.fetch("u", opened=lambda _, timeout: BytesIO(b'{"success": 2}'))
    with pytest.raises(urllib.error.HTTPError):
        pages.fetch("u", opened=lambda _, timeout: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "", {}, None)))


def test_walks_end_and_are_repeated():
    assert pages.walk(lambda q: {"reviews": [{"recommendationid": "1"}], "cursor": "same"}, None) == ([{"recommendationid": "1"}], "cursor repeated")
    assert pages.walk(lambda q: {"reviews": [{"recommendationid": "1"}, {"recommendationid": 2}]}, None) == ([{"recommendationid": "1"}], "no cursor")
    tries = []
    assert pages.walk_again(lambda q: tries.append(q) or {"reviews": []}, None, 100)[2] and len(tries) == 3


def test_data_source_reads_all_windows(spark, tmp_path):
    rows = [{"recommendationid": str(i), "timestamp_created": i, "review": f"text {i}"} for i in range(250)]
    (tmp_path / "5.json").write_text(json.dumps(rows + rows[:10]))
    spark.dataSource.register(pages.ReviewPages)
    read = lambda w: spark.read.format("review_pages").option("app", "5").option("folder", str(tmp_path)).option("windows", json.dumps(w)).load()
    got = read([[0, 99, 100], [100, 300, 150]])
    assert got.rdd.getNumPartitions() == 2 and got.count() == 250
    with pytest.raises(Exception, match="short"):
        read([[0, 99, 1000]]).collect()
    assert pages.count(lambda q: pages.stored_pages(str(tmp_path))(5, q)) == 260


def test_tasks_together_keep_one_pace():
    reader = pages._Reader({"app": "5", "windows": json.dumps([[k, k, 10 * k] for k in range(9)]), "pace": "0.5", "concurrency": "3"})
    tasks = reader.partitions()
    assert len(tasks) == 3 and {t.pace for t in tasks} == {1.5} and sorted(w[0] for t in tasks for w in t.windows) == list(range(9))
    assert max(sum(w[2] for w in t.windows) for t in tasks) <= 140
    assert len(pages._Reader({"app": "5", "windows": "[]"}).partitions()) == 1


def test_progress_of_unfinished_crawls(spark):
    crawls = spark.createDataFrame([(1, 7, None), (2, 7, None), (3, 8, 5), (4, 9, None)], "id bigint, app_id bigint, finished_unix bigint")
    shards = spark.createDataFrame([(2, "done"), (2, "running"), (3, "done")], "crawl_id bigint, status string")
    assert sorted(tuple(r) for r in planning.unfinished_progress(crawls, shards).collect()) == [(7, 2, 1, 2), (9, 4, 0, 0)]


def test_streamed_topup_takes_each_review_once(spark, tmp_path):
    schema = topup.T.StructType([*topup.CAPTURE.fields, topup.T.StructField("snapshot_unix", topup.T.LongType())])

    def deliver(n, rows):
        full = [{f: None for f in schema.names} | {"recommendationid": i, "appid": 1, "timestamp_updated": u, "timestamp_created": 1, "snapshot_unix": n, "raw_json": "{}"} for i, u in rows]
        spark.createDataFrame([tuple(r[f] for f in schema.names) for r in full], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    args = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/checkpoint"
    deliver(1, [("a", 1), ("b", 1), ("a", 2)])
    topup.run_topup(spark, *args).awaitTermination()
    deliver(2, [("a", 5), ("b", 1), ("c", 1)])
    topup.run_topup(spark, *args).awaitTermination()
    topup.run_topup(spark, *args).awaitTermination()
    assert sorted((r.recommendationid, r.timestamp_updated) for r in topup.latest(spark, args[1]).collect()) == [("a", 5), ("b", 1), ("c", 1)]
