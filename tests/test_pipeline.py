"""All commands, end to end, over stored pages."""

from __future__ import annotations

import hashlib
import json

import pytest

from lensmill import cli, terminal
from lensmill.operators.vectors import Anchors
from lensmill.sources import files

WORDS = {"bugs": "crash crashes launch error broken", "performance": "frames stutter slow laptop fps", "story": "plot writing ending characters tale"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rows = []
    for i in range(60):
        topic = list(WORDS)[i % 3]
        words = WORDS[topic].split()
        rows.append({"recommendationid": f"{i:03d}", "review": f"{words[i % 5]} {words[(i + 1) % 5]} {words[(i // 3) % 5]}", "language": "english", "timestamp_created": 1_700_000_000 + i * 86_400, "voted_up": i % 2 == 0, "votes_up": i, "weighted_vote_score": str(i / 100), "author": {"steamid": "7"}})
    rows.append({"recommendationid": "900", "review": "   ", "timestamp_created": 1_700_000_000})
    (root / "pages").mkdir()
    (root / "pages/5.json").write_text(json.dumps(rows))
    args = str(root / "out"), 5
    first = cli.crawl(spark, *args, folder=str(root / "pages"), snapshot=1_705_000_000)
    assert first["unique"] == 59 and first["windows"] == 1  # two were written later
    return root, args


def test_pipeline(spark, corpus):
    root, args = corpus
    reference = str(root / "reference")
    assert cli.embed(spark, *args)["reviews"] == 58
    facts = cli.classify(spark, *args, reference=reference)
    assert facts["reviews"] == 58 and facts["unmatched"] == 0 and len(facts["categories"]) == 21
    assert cli.sample(spark, args[0], [5], reference, per_app=20, per_category=10, batch=10) >= 2
    sample = json.loads((root / "reference/5/sample.json").read_text())
    assert {r["subset"] for r in sample} == {"random", "stratified"}
    (root / "returned").mkdir()
    topic = lambda text: next(t for t, w in WORDS.items() if text.split()[0] in w.split())
    labels = [{"id": r["id"], "primary": topic(r["review"]), "secondary": [], "ironic": False, "confidence": "high", "ambiguous": False} for r in sample]
    (root / "returned/a.json").write_text(json.dumps([*labels[1:], {"id": "777", "primary": "bugs"}]))
    assert cli.ingest(spark, reference, 5, str(root / "returned"))["missing"] == [labels[0]["id"]]
    assert not (root / "reference/5/labels.json").exists()
    (root / "returned/a.json").write_text(json.dumps(labels))
    assert not any(cli.ingest(spark, reference, 5, str(root / "returned")).values())
    before = cli.measure(spark, args[0], 5, reference)
    fitted = cli.fit(spark, args[0], [5], reference, folds=3)
    held = sum(r["subset"] == "random" for r in sample)
    assert fitted["examples"] == len(labels) - held and fitted["held_back"] == held and fitted["agreement"] > 0.8
    assert "held back" in terminal.fitted(fitted) and fitted["other"]["objective"] == "mentions"
    assert Anchors.load(f"{reference}/anchors.json").fitted_from in ([5], [])
    cli.classify(spark, *args, reference=reference)
    after = cli.measure(spark, args[0], 5, reference)
    assert after["agreement"] >= max(0.8, before["agreement"]) and after["unmatched"] == 0 and after["compared"] == held
    assert cli.measure(spark, args[0], 5, reference, None)["compared"] == len(labels)
    assert "clear-cut" in terminal.evaluations([after]) and "Bugs and crashes" in terminal.evaluations([after])
    assert "of the top" in terminal.classifications([facts]) and facts["top_reviews"][0]["helpfulness"] >= facts["top_reviews"][-1]["helpfulness"] and facts["months"][0]["categories"]
    # one app has no other to be fitted on; another encoder embeds the labelled reviews again
    wide = cli.transfer(spark, args[0], [5], reference, folds=2, encoder="hashing-wide")
    assert wide.count() == held and "other apps" in terminal.transfers(wide) and f"{held}" in terminal.comparison(wide, wide)
    files.write_json(f"{reference}/5/manifest.json", {"app_id": 5, "produced_by": "x", "spine_version": "core-0", "human_verified": False})
    with pytest.raises(ValueError, match="taxonomy"):
        cli.measure(spark, args[0], 5, reference)
    files.write_json(f"{reference}/5/manifest.json", {"app_id": 5, "produced_by": "x", "spine_version": "core-3", "human_verified": False})
    cli.page(spark, args[0], [5], reference, str(root / "page.html"))
    text = (root / "page.html").read_text()
    assert "App 5" in text and "agrees with the reference labels" in text and "Bugs and crashes" in text


def test_a_topup_adds_to_what_is_there(spark, corpus):
    root, args = corpus
    more = cli.crawl(spark, *args, folder=str(root / "pages"), top_up=True, snapshot=1_706_000_000)
    assert more["unique"] == 2 and cli.corpus(spark, *args).count() == 60
    assert files.read_json(f"{files.snapshot_of(*args)}/crawl.json")["coverage"] is None
    again = cli.crawl(spark, *args, folder=str(root / "pages"), top_up=True, snapshot=1_707_000_000)
    assert again["unique"] == 0 and cli.corpus(spark, *args).count() == 60


def test_brief_and_files(tmp_path, capsys):
    assert cli.main(["brief"]) == 0 and "verdict: " in capsys.readouterr().out
    (tmp_path / "m.bin").write_bytes(b"model")
    assert files.verified(tmp_path / "m.bin", hashlib.sha256(b"model").hexdigest()).exists()
    with pytest.raises(ValueError):
        files.verified(tmp_path / "m.bin", "0")
    assert not (tmp_path / "m.bin").exists()
    (tmp_path / "manifest.json").write_text('{"app_id": 1}')
    with pytest.raises(ValueError, match="produced_by"):
        files.manifest(tmp_path)
    assert files.anchors_for(1, tmp_path) == (None, "")
    with pytest.raises(FileNotFoundError):
        files.anchors_for(1, tmp_path, str(tmp_path / "none.json"))
    assert files.agreement_or_none(lambda: files.read_json(tmp_path / "none")) is None
    for snapshot, content in ((5, b"x"), (9, b"")):
        (tmp_path / f"appid=1/snapshot={snapshot}/capture.parquet").mkdir(parents=True)
        (tmp_path / f"appid=1/snapshot={snapshot}/capture.parquet/part-0.parquet").write_bytes(content)
    assert files.snapshot_of(tmp_path, 1).endswith("/snapshot=5")


def test_a_broken_crawl_is_taken_up_with_what_was_fetched(spark, tmp_path, monkeypatch):
    rows = [{"recommendationid": f"{i:03d}", "review": "x", "timestamp_created": 1_700_000_000 + i} for i in range(130)]
    pages, root = tmp_path / "pages", str(tmp_path / "out")
    pages.mkdir()
    (pages / "5.json").write_text(json.dumps([*rows, {"review": "no id", "timestamp_created": 1_700_000_000}]))
    windows, marked, real = [(1_700_000_000, 1_700_000_099, 101), (1_700_000_100, 1_700_000_200, 30)], [], cli.planning.CrawlState.mark_all
    monkeypatch.setattr(cli.planning, "split_windows", lambda *a: windows)

    def breaks(self, crawl_id, marks):
        marked.append(real(self, crawl_id, marks[:1]))
        raise OSError("broken off")

    monkeypatch.setattr(cli.planning.CrawlState, "mark_all", breaks)
    with pytest.raises(OSError):
        cli.crawl(spark, root, 5, folder=str(pages), snapshot=1_705_000_000)
    monkeypatch.setattr(cli.planning.CrawlState, "mark_all", real)
    assert cli.crawl(spark, root, 5, folder=str(pages))["unique"] == 130
    state = cli.planning.CrawlState(spark, f"file://{root}/state")
    assert [(r.id, r.snapshot_unix, r.finished_unix) for r in state.read("crawl").collect()] == [(1, 1_705_000_000, 1_705_000_000)]
    assert [(r.status, r.expected, r.row_count, r.pages, r.stop_reason, r.max_created) for r in state.shards(1)] == [("done", 101, 100, 3, "exhausted", 1_700_000_099), ("done", 30, 30, 2, "exhausted", 1_700_000_129)]
    cli.crawl(spark, root, 5, folder=str(pages), snapshot=1_706_000_000)
    assert state.read("crawl").count() == 2


def test_a_short_window_is_left_open_and_walked_again(spark, tmp_path, monkeypatch):
    rows = [{"recommendationid": f"{i:03d}", "review": "x", "timestamp_created": 1_700_000_000 + i} for i in range(60)]
    pages, root = tmp_path / "pages", str(tmp_path / "out")
    pages.mkdir()
    (pages / "5.json").write_text(json.dumps(rows))
    monkeypatch.setattr(cli.planning, "split_windows", lambda *a: [(1_700_000_000, 1_700_000_029, 30), (1_700_000_030, 1_700_000_200, 200)])
    first = cli.crawl(spark, root, 5, folder=str(pages), snapshot=1_705_000_000)
    assert first["unique"] == 60 and not first["complete"] and first["shards_short"] == 1 and "left open" in terminal.crawls([first])
    state = cli.planning.CrawlState(spark, f"file://{root}/state")
    assert state.watermark(5) is None and [r.status for r in state.shards(1)] == ["done", "pending"]
    (pages / "5.json").write_text(json.dumps(rows + [{"recommendationid": f"n{i}", "review": "y", "timestamp_created": 1_700_000_100} for i in range(165)]))
    second = cli.crawl(spark, root, 5, folder=str(pages))
    assert second["complete"] and second["resumed"] and second["shards_restarted"] == 1 and second["unique"] == 225 and state.watermark(5) == 1_700_000_100
    facts = files.read_json(f"{root}/appid=5/snapshot=1705000000/crawl.json")
    assert {"tool_version", "request_url_template", "pages", "duplicates_this_run", "elapsed_secs", "review_score_desc", "shards_short"} <= facts.keys()


def test_files_by_uri(spark, tmp_path):
    """What the commands keep beside the tables goes wherever Spark can write."""
    from lensmill import shared

    root = f"file://{tmp_path}/far"
    files.write_json(f"{root}/a/x.json", {"k": "ü"})
    files.write_json(f"{root}/a/x.json", {"k": "ö"})
    assert files.read_json(f"{root}/a/x.json") == {"k": "ö"} and shared.exists(f"{root}/a/x.json") and not shared.exists(f"{root}/b")
    assert [k for k in shared.sizes_below(f"{root}/a") if not k.endswith(".crc")] == ["x.json"] and shared.sizes_below(f"{root}/none") == {}
    with pytest.raises(FileNotFoundError):
        files.read_json(f"{root}/none.json")
    spark.range(1).write.parquet(f"{root}/appid=1/snapshot=7/capture.parquet")
    assert files.snapshot_of(root, 1) == f"{root}/appid=1/snapshot=7" and files.apps_below(root) == [1]
