"""Commands: python -m lensmill.cli COMMAND ... - crawl, embed, classify, report, sample, brief, ingest, fit, transfer, compare, evaluate.

A corpus lies below ``--root`` as ``appid=A/snapshot=T/``; reference sets lie below ``--reference`` as ``A/``.
"""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill import report, terminal
from lensmill.functions import show, stats
from lensmill.functions.text import text_key
from lensmill.operators import evaluate, planning, rates, reviews, sampling, vectors
from lensmill.schema import CATEGORIES, CATEGORY_IDS, DESCRIPTIONS, SPINE_VERSION, TOP_HELPFUL
from lensmill.shared import exists
from lensmill.sources import files, onnx
from lensmill.sources.pages import NoSuchCorpus, ReviewPages, ReviewQuery, count, fetch, stored_pages, summary

VERSION = "0.2"


def session() -> SparkSession:
    return SparkSession.builder.appName("lensmill").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()


def _broken(state: planning.CrawlState, app: int, url_to, snapshot: int | None) -> tuple[int, int, int] | None:
    """Number, snapshot and stated total of the app's latest crawl if that broke off and asked for the same as this one."""
    latest = state.read("crawl").where(F.col("app_id") == app).orderBy(F.desc("id")).first()
    if latest is None or latest.finished_unix is not None or snapshot not in (None, latest.snapshot_unix) or latest.params_url != url_to(latest.snapshot_unix):
        return None
    return latest.id, latest.snapshot_unix, latest.valve_total


def _uri(path: str) -> str:
    """A path as Spark takes it: as it is with a scheme, else on this machine."""
    return path if "://" in path else f"file://{Path(path).absolute()}"


def crawl(spark: SparkSession, root: str, app: int, folder: str | None = None, base: str | None = None, top_up: bool = False, snapshot: int | None = None, name: str | None = None) -> dict:
    """Plan windows by counting, walk them, write the shards and advance the watermark once all are in.

    A crawl that broke off is taken up again with its snapshot and its windows that are not done. A
    window that stays short of what the store states is left open, and so is the crawl; what was
    fetched of it is kept.
    """
    began = time.monotonic()
    spark.dataSource.register(ReviewPages)
    page_of = (lambda q: stored_pages(folder)(app, q)) if folder else (lambda q: fetch(q.url(base or "", app)))
    state = planning.CrawlState(spark, f"{_uri(root)}/state")
    mark = state.watermark(app) if top_up else None
    start = planning.topup_start(mark)
    url_to = lambda end: ReviewQuery(window=(start, end)).url(base or "https://store.invalid", app)
    broken, says = _broken(state, app, url_to, snapshot), summary(page_of)
    if broken:
        crawl_id, end, stated = broken
    else:
        end, stated = snapshot or int(time.time()), int(says.get("total_reviews", 0))
        crawl_id = state.start_crawl(app, end, url_to(end), stated)
    windows = [(r.start_date, r.end_date, r.expected) for r in state.shards(crawl_id)]
    if not windows:
        windows = planning.split_windows(start, end, lambda a, b: count(page_of, (a, b)))
        state.put_shards(crawl_id, windows)
    target, staged = f"{root}/appid={app}/snapshot={end}", f"{_uri(root)}/state/pages/crawl-{crawl_id}"
    pending, unique, fetched = [], 0, 0
    if windows:
        pending = [(r.idx, r.start_date, r.end_date, r.expected) for r in state.pending(crawl_id).collect()]
        if pending:
            source = spark.read.format("review_pages").option("app", str(app)).option("tally", "true").option("windows", json.dumps([w[1:] for w in pending]))
            (source.option("folder", folder) if folder else source.option("base", base)).load().write.mode("append").parquet(staged)
        pages = spark.read.parquet(staged)
        # of a window that was walked again, the walk that brought most
        walked = {(r.window_start, r.window_end): r for r in pages.where("raw_json is null").orderBy("row_count").collect()}
        full = [(i, a, b) for i, a, b, _ in pending if not walked[a, b].short]
        state.mark_all(crawl_id, [(i, "done", (t := walked[a, b]).row_count, t.pages, t.stop_reason, t.max_created) for i, a, b in full])
        fetched = sum(walked[a, b].row_count for _, a, b, _ in pending)
        parsed = reviews.parsed(pages.where("raw_json is not null").select("appid", "raw_json")).dropDuplicates(["recommendationid"])
        parsed.drop("appid").write.option("compression", "zstd").option("parquet.block.size", 32 << 20).mode("overwrite").parquet(f"{target}/capture.parquet")
        unique = spark.read.parquet(f"{target}/capture.parquet").count()
    complete = state.all_done(crawl_id)
    tally = {r.crawl_id: r for r in planning.crawl_tally(state.read("shard")).collect()}.get(crawl_id)
    short = len(windows) - (state.progress(crawl_id)[0] if windows else 0)
    facts = {
        "name": name, "tool_version": VERSION, "request_url_template": url_to(end), "shards": len(windows), "pages": tally.pages if tally else 0, "duplicates_this_run": max(0, fetched - unique),
        "valve_total_positive": says.get("total_positive"), "valve_total_negative": says.get("total_negative"), "review_score_desc": says.get("review_score_desc"), "complete": complete,
        "resumed": broken is not None, "shards_restarted": len(pending) if broken else 0, "shards_short": short, "elapsed_secs": int(time.monotonic() - began),
    }
    files.write_crawl(f"{target}/crawl.json", app, end, unique, stated, mark, **facts)
    if complete:
        state.finish(app, crawl_id, end)
        _drop(spark, staged)
    return {"app_id": app, "unique": unique, "windows": len(windows), "coverage": show.coverage(unique / stated if stated and not mark else None), "stated": stated, "top_up_from": mark, **facts}


def _drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def corpus(spark: SparkSession, root: str, app: int) -> DataFrame:
    """The latest copy of each review over all snapshots of an app, so that a top-up adds to what was there."""
    taken = F.regexp_extract(F.input_file_name(), r"snapshot=(\d+)", 1).cast("bigint")
    whole = spark.read.parquet(f"{root}/appid={app}/snapshot=*/capture.parquet").withColumn("snapshot_unix", taken)
    columns = ["recommendationid", "appid", "author_steamid", "language", "review", "timestamp_created", "voted_up", "votes_up", "weighted_vote_score"]
    return reviews.with_defaults(reviews.latest_by_id(whole.withColumn("appid", F.lit(app).cast("bigint")), columns))


#: Every encoder that can be named: the stand-ins, and those whose files lie below ``--models``.
ENCODERS = vectors.ENCODERS | onnx.ENCODERS


def _forward(encoder: str, models: str | None, precision: str):
    """What runs an encoder: hashing, or a graph whose files are checked first."""
    if encoder in vectors.ENCODERS:
        return vectors.hashing_forward
    if not models:
        raise ValueError(f"{encoder} needs the folder of its files (--models)")
    onnx.check(models, encoder, precision)
    return onnx.forward(models, precision)


def embed(spark: SparkSession, root: str, app: int, encoder: str = "hashing", batch: int = 64, models: str | None = None, precision: str = "fp16") -> dict:
    began = time.monotonic()
    at, enc = files.snapshot_of(root, app), ENCODERS[encoder]
    rows, hashing = corpus(spark, root, app), encoder in vectors.ENCODERS
    files.write_vectors(vectors.embedded(rows, enc, _forward(encoder, models, precision), batch), f"{at}/embeddings.parquet", enc.dimensions)
    n, texts = rows.count(), spark.read.parquet(f"{at}/embeddings.parquet").count()
    facts = {"model": encoder, "precision": "fp64" if hashing else precision, "dimensions": enc.dimensions, "batch_size": batch, "device": "cpu" if hashing else "best available", "reviews": n, "unique_texts": texts, "dedupe_rate": 1 - texts / n if n else None,
             "texts_per_second": round(texts / max(time.monotonic() - began, 1e-3), 1), "note": "vectors of a hashing stand-in, which makes no claim to quality" if hashing else ""}
    files.write_json(f"{at}/embeddings.json", facts)
    return facts


def description_anchors(encoder: str = "hashing", models: str | None = None, precision: str = "fp16") -> vectors.Anchors:
    """Anchors from the labels and descriptions of the categories, without any labelled review."""
    forward = _forward(encoder, models, precision)(ENCODERS[encoder])
    return vectors.Anchors(forward([f"{label}. {DESCRIPTIONS[c]}" for c, label in CATEGORIES]).astype(np.float64), model=encoder)


def classify(spark: SparkSession, root: str, app: int, reference: str = "reference", anchors: str | None = None, margin: float | None = None, models: str | None = None, precision: str = "fp16") -> dict:
    at = files.snapshot_of(root, app)
    found, note = files.anchors_for(app, reference, anchors)
    used = found or description_anchors(files.encoder_of(root, app), models, precision)
    vectors.refuse_foreign(used, files.encoder_of(root, app))
    used.margin = margin or used.margin
    vecs = spark.read.parquet(f"{at}/embeddings.parquet")
    if used.scoring != "raw":
        used = used.prepare(used.scoring, vectors.collect_vector(vectors.centroid(vecs)))
    rows = corpus(spark, root, app)
    files.write_classifications(vectors.classified(rows, vecs, used), f"{at}/classifications.parquet", show.provenance(used.fitted_from))
    tags = rates.current_assignments(files.read_classifications(spark, f"{at}/classifications.parquet"))
    table = rates.category_rates(rows, tags)
    counts = [r.asDict() for r in table.orderBy("slot").collect()]
    total, positive = rows.agg(F.count("*"), F.count_if("voted_up")).first()
    by_month: dict[str, list] = {}
    joined = rows.join(tags, "recommendationid")
    for r in rates.month_categories(joined).orderBy("month", "category").collect():
        by_month.setdefault(r.month, []).append([r.category, r.mentions])
    top = rates.top_of_pile(rows).join(tags, "recommendationid").orderBy("rank").select("recommendationid", "weighted_vote_score", "votes_up", "primary_category", "mentions")
    facts = {
        "app_id": app, "reviews": total, "positive": positive, "unmatched": vectors.unmatched(rows, vecs).count(), "top_helpful": TOP_HELPFUL, "mention_margin": used.margin, "spine_version": SPINE_VERSION,
        "model": used.model, "anchors_fitted_from": used.fitted_from, "note": note, "categories": counts,
        "languages": [list(r) for r in rates.language_histogram(rows).orderBy(F.desc("reviews"), "language").collect()],
        "months": [r.asDict() | {"categories": by_month.get(r.month, [])} for r in rates.months(rows).orderBy("month").collect()],
        "top_reviews": [{"id": r[0], "helpfulness": r[1], "votes_up": r[2], "primary": r[3], "mentions": r[4]} for r in top.collect()],
    }
    files.write_json(f"{at}/classification.json", facts)
    return facts


def _tags(spark: SparkSession, root: str, app: int) -> DataFrame:
    return rates.current_assignments(files.read_classifications(spark, f"{files.snapshot_of(root, app)}/classifications.parquet"))


def sample(spark: SparkSession, root: str, apps: list[int], reference: str, per_app: int = 100, per_category: int = 40, batch: int = 35, seed: int = 1) -> int:
    rows = [corpus(spark, root, a) for a in apps]
    tags = [_tags(spark, root, a) for a in apps]
    whole, assigned = rows[0], tags[0]
    for r, t in zip(rows[1:], tags[1:]):
        whole, assigned = whole.unionByName(r), assigned.unionByName(t)
    drawn = sampling.with_texts(sampling.drawn(whole.join(assigned, "recommendationid"), per_app, per_category, seed), whole)
    return sum(sampling.write_sample(drawn.where(F.col("appid") == a), f"{reference}/{a}", batch) for a in apps)


def ingest(spark: SparkSession, reference: str, app: int, returned: str, force: bool = False, produced_by: str = "unknown") -> dict:
    """Check labels that came back; write ``labels.json`` if they are clean or it is insisted on."""
    drawn = spark.read.option("multiLine", "true").json(f"{reference}/{app}/sample.json")
    labels = evaluate.read_labels(spark, returned)
    checks = {k: sorted(r[0] for r in v.collect()) for k, v in evaluate.returned(drawn, labels).items()}
    if force or not any(checks.values()):
        rows = [r.asDict() for r in evaluate.accepted(drawn, labels).collect()]
        files.write_json(f"{reference}/{app}/labels.json", rows)
        if not exists(f"{reference}/{app}/manifest.json"):
            files.write_json(f"{reference}/{app}/manifest.json", {"app_id": app, "produced_by": produced_by, "spine_version": SPINE_VERSION, "human_verified": False})
    return checks


def _labels(spark: SparkSession, reference: str, app: int) -> DataFrame:
    """The labels of a reference set, refused if they are of another taxonomy."""
    return files.reference_set(spark, f"{reference}/{app}")[1].drop("source")


def labelled_under(spark: SparkSession, root: str, apps: list[int], reference: str, encoder: str, models: str | None = None, precision: str = "fp16") -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Labels of several apps with vectors of one encoder (``id, slot, secondary, embedding, app, subset, ambiguous``), and the centroids of the apps.

    If any app was embedded with another encoder, the labelled reviews of all of them are embedded
    again, and there are no centroids: labels are not what an average review looks like.
    """
    foreign = [a for a in apps if files.encoder_of(root, a) != encoder]
    slots = F.create_map(*[F.lit(x) for k, c in enumerate(CATEGORY_IDS) for x in (c, k)])
    whole, centroids = None, {}
    for a in apps:
        rows, labels = corpus(spark, root, a), _labels(spark, reference, a)
        if foreign:
            vecs = vectors.embed_reviews(rows, labels, ENCODERS[encoder], _forward(encoder, models, precision))
        else:
            stored = spark.read.parquet(f"{files.snapshot_of(root, a)}/embeddings.parquet")
            texts = rows.join(labels.select(F.col("id").alias("recommendationid")).distinct(), "recommendationid", "left_semi").select(F.col("recommendationid").alias("id"), text_key("review").alias("text_sha256"))
            vecs = texts.join(stored.select("text_sha256", "embedding"), "text_sha256").select("id", "embedding")
            centroids[a] = vectors.collect_vector(vectors.centroid(stored))
        known = F.filter(F.coalesce("secondary", F.array().cast("array<string>")), lambda c: c.isin(*CATEGORY_IDS))
        part = labels.join(vecs, "id").select("id", slots[F.col("primary")].alias("slot"), F.transform(known, lambda c: slots[c]).alias("secondary"), "embedding", F.lit(a).cast("bigint").alias("app"), "subset", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
        part = part.where("slot is not null")
        whole = part if whole is None else whole.unionByName(part)
    return whole, centroids


def fit(spark: SparkSession, root: str, apps: list[int], reference: str, folds: int = 5, objective: str = "primary", holdout: str = vectors.HOLDOUT, encoder: str | None = None, models: str | None = None, precision: str = "fp16") -> dict:
    """Search the parameters by cross-validation on the labels that are not held back, refit on all of these and save the anchors.

    What is held back only says how good they are, and what the other objective would have given.
    """
    encoder = encoder or files.encoder_of(root, apps[0])
    labelled, centroids = labelled_under(spark, root, apps, reference, encoder, models, precision)
    training, held = (vectors.examples_of(x) for x in vectors.split_labels(labelled, holdout))
    if not len(training.slot):
        raise ValueError(f"no label outside the subset {holdout} to fit on")
    base, centre = description_anchors(encoder, models, precision), np.mean(list(centroids.values()), axis=0) if centroids else np.zeros(0)
    scorings = vectors.SCORING if centroids else ("raw",)
    smoothing, secondary, scoring, _ = vectors.best_params(vectors.searched(vectors.split_labels(labelled, holdout)[0], base, centre, folds, objective, scorings))
    fitted = base if np.isinf(smoothing) else vectors.fit(base, training, smoothing, secondary, apps)
    fitted = fitted.prepare(scoring, centre)
    fitted.margin = max(vectors.MARGINS, key=lambda m: vectors.score(fitted, training, m)[1])
    fitted.save(f"{reference}/anchors.json")
    agreement, f1 = vectors.score(fitted, held, fitted.margin) if len(held.slot) else (None, None)
    evidence = [] if fitted.evidence is None else sorted(({"category": c, "evidence": float(e), "learned": float(x)} for c, e, x in zip(CATEGORY_IDS, fitted.evidence, fitted.share)), key=lambda r: -r["evidence"])
    return {"smoothing": smoothing, "secondary": secondary, "scoring": scoring, "margin": fitted.margin, "examples": len(training.slot), "held_back": len(held.slot), "agreement": agreement, "macro_f1": f1,
            "anchors": evidence, "other": vectors.other_choice(base, training, held, centre, fitted, objective, folds, scorings)}


def transfer(spark: SparkSession, root: str, apps: list[int], reference: str, folds: int = 5, objective: str = "primary", holdout: str = vectors.HOLDOUT, encoder: str | None = None, models: str | None = None, precision: str = "fp16") -> DataFrame:
    """Verdicts of leaving each app out, on what is held back of it (see ``vectors.transfer``)."""
    encoder = encoder or files.encoder_of(root, apps[0])
    labelled, centroids = labelled_under(spark, root, apps, reference, encoder, models, precision)
    return vectors.transfer(labelled, description_anchors(encoder, models, precision), "app", holdout, centroids, None, folds, objective, vectors.SCORING if centroids else ("raw",))


def measure(spark: SparkSession, root: str, app: int, reference: str, holdout: str | None = vectors.HOLDOUT) -> dict:
    """Agreement of an app's classifications with the labels held back (None: with all), overall and by category; by slice over all labels."""
    everything = evaluate.compared(_labels(spark, reference, app), _tags(spark, root, app)).cache()
    pairs = everything if holdout is None else everything.where(F.col("subset") == holdout)
    low, high = stats.wilson(F.col("agreed"), F.col("compared"))
    overall = pairs.where("predicted is not null").agg(F.count_if(F.col("primary") == F.col("predicted")).alias("agreed"), F.count("*").alias("compared"))
    overall = overall.select("agreed", "compared", stats.rate(F.col("agreed"), F.col("compared")).alias("agreement"), low.alias("low"), high.alias("high"))
    scores = evaluate.category_scores(evaluate.category_counters(pairs)).join(evaluate.mistaken_for(evaluate.confusion(pairs)).select(F.col("primary").alias("category"), "taken_for"), "category", "left")
    out = overall.first().asDict() | {
        "app_id": app, "unmatched": pairs.where("predicted is null").count(), "macro_f1": evaluate.macro_f1(scores).first()[0], "anchors": evaluate.provenance(pairs).first()["anchors"],
        "categories": {r.category: r.asDict() for r in scores.orderBy(F.desc("ref_mentions"), "category").collect()}, "slices": [r.asDict() for r in evaluate.slices(everything).orderBy("subset", F.desc("whole"), "ambiguous").collect()],
    }
    everything.unpersist()
    return out


def page(spark: SparkSession, root: str, apps: list[int], reference: str, out: str, quotes: int = 4) -> None:
    content = []
    for a in apps:
        rows = corpus(spark, root, a)
        app = report.build(rows, _tags(spark, root, a), [a], quotes)[0]
        facts = files.read_json(f"{files.snapshot_of(root, a)}/crawl.json")
        app.captured_share, app.name = facts.get("coverage"), facts.get("name")
        app.captured, app.stated = facts.get("rows_unique"), facts.get("valve_total_reviews")
        app.agreement = files.agreement_or_none(lambda a=a: measure(spark, root, a, reference) if exists(f"{reference}/{a}/labels.json") else None)
        content.append(app)
    report.save(content, out)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lensmill")
    p.add_argument("command", choices=["crawl", "embed", "classify", "report", "sample", "brief", "ingest", "fit", "transfer", "compare", "evaluate"])
    p.add_argument("apps", nargs="*", type=int)
    p.add_argument("--root", default="corpus")
    p.add_argument("--reference", default="reference")
    p.add_argument("--pages", help="folder of stored pages")
    p.add_argument("--base", help="address of the store")
    p.add_argument("--top-up", action="store_true")
    p.add_argument("--encoder", choices=sorted(ENCODERS), help="what to embed, fit or compare with")
    p.add_argument("--against", choices=sorted(ENCODERS), help="compare: the other encoder")
    p.add_argument("--models", help="folder with the files of encoders that have weights")
    p.add_argument("--precision", default="fp16", choices=["fp16", "fp32"])
    p.add_argument("--batch", type=int, default=64)
    p.add_argument("--name", help="crawl: the app's name")
    p.add_argument("--holdout", default=vectors.HOLDOUT, help="subset of labels that is never fitted on")
    p.add_argument("--all-labels", action="store_true", help="evaluate: also on labels that were fitted on")
    p.add_argument("--produced-by", default="unknown")
    p.add_argument("--json", action="store_true", help="print facts as JSON instead of tables")
    p.add_argument("--anchors")
    p.add_argument("--margin", type=float)
    p.add_argument("--per-app", type=int, default=100)
    p.add_argument("--per-category", type=int, default=40)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--objective", default="mentions", choices=["primary", "mentions"])
    p.add_argument("--returned")
    p.add_argument("--force", action="store_true")
    p.add_argument("--out", default="report.html")
    a = p.parse_args(argv)
    if a.command == "brief":
        print(report.labelling_brief(), end="")
        return 0
    spark = session()
    try:
        call = lambda f, encoder: f(spark, a.root, a.apps, a.reference, a.folds, a.objective, a.holdout, encoder, a.models, a.precision)
        done = {
            "crawl": lambda: [crawl(spark, a.root, x, a.pages, a.base, a.top_up, name=a.name) for x in a.apps],
            "embed": lambda: [embed(spark, a.root, x, a.encoder or "hashing", a.batch, a.models, a.precision) for x in a.apps],
            "classify": lambda: [classify(spark, a.root, x, a.reference, a.anchors, a.margin, a.models, a.precision) for x in a.apps],
            "sample": lambda: sample(spark, a.root, a.apps, a.reference, a.per_app, a.per_category, seed=a.seed),
            "ingest": lambda: [ingest(spark, a.reference, x, a.returned, a.force, a.produced_by) for x in a.apps],
            "fit": lambda: call(fit, a.encoder),
            "transfer": lambda: call(transfer, a.encoder),
            "compare": lambda: (call(transfer, a.encoder), call(transfer, a.against)),
            "evaluate": lambda: [measure(spark, a.root, x, a.reference, None if a.all_labels else a.holdout) for x in a.apps],
            "report": lambda: page(spark, a.root, a.apps or files.apps_below(a.root), a.reference, a.out),
        }[a.command]()
        tables = {"crawl": terminal.crawls, "classify": terminal.classifications, "fit": terminal.fitted, "evaluate": terminal.evaluations, "transfer": terminal.transfers, "compare": lambda d: terminal.comparison(*d)}
        if a.command in tables and (not a.json or isinstance(done, (tuple, DataFrame))):
            print(tables[a.command](done))
        else:
            print(json.dumps(done, indent=1, ensure_ascii=False, default=str))
    except NoSuchCorpus as error:
        print(f"no such app: {error}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
