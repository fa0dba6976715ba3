"""Small files beside the tables: provenance, counts, manifests, anchors; written whole or not at all."""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.operators.evaluate import read_labels
from lensmill.operators.vectors import Anchors
from lensmill.schema import CLASSIFICATIONS, SPINE_VERSION
from lensmill.shared import exists, read_text, sizes_below, write_text


def write_json(path: str | Path, what: object) -> None:
    """Whole or not at all; on this machine, or anywhere by URI."""
    write_text(path, json.dumps(what, ensure_ascii=False, indent=1))


def read_json(path: str | Path) -> dict:
    return json.loads(read_text(path))


def write_crawl(path: str | Path, app_id: int, snapshot: int, unique: int, stated: int | None, top_up_from: int | None = None, **facts: object) -> None:
    """``crawl.json``. Coverage is null for a top-up and where the store states nothing, and readers must allow that."""
    share = unique / stated if stated and not top_up_from else None
    write_json(path, {"app_id": app_id, "snapshot_unix": snapshot, "rows_unique": unique, "valve_total_reviews": stated, "coverage": share, "top_up_from": top_up_from, **facts})


def snapshot_of(root: str | Path, app_id: int) -> str:
    """The newest snapshot of an app that holds a shard of any size; an empty or broken newer one does not count."""
    below = f"{str(root).rstrip('/')}/appid={app_id}"
    found = {name.split("/")[0] for name, size in sizes_below(below).items() if size and re.fullmatch(r"snapshot=\d+/capture\.parquet/[^/]*\.parquet", name)}
    if not found:
        raise FileNotFoundError(f"no capture of app {app_id} below {root}")
    return f"{below}/{max(found, key=lambda name: int(name.partition('=')[2]))}"


def apps_below(root: str | Path) -> list[int]:
    """Every app of which something was captured below ``root``, in order."""
    return sorted({int(m[1]) for name, size in sizes_below(root).items() if size and (m := re.match(r"appid=(\d+)/snapshot=\d+/capture\.parquet/[^/]*\.parquet$", name))})


def encoder_of(root: str | Path, app_id: int) -> str:
    """The encoder that a corpus was embedded with."""
    return read_json(f"{snapshot_of(root, app_id)}/embeddings.json")["model"]


def manifest(folder: str | Path) -> dict:
    """Who labelled a reference set, of which app and under which taxonomy; other keys are notes."""
    m = read_json(f"{folder}/manifest.json")
    missing = {"app_id", "produced_by", "spine_version", "human_verified"} - m.keys()
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(sorted(missing))}")
    return m


def reference_set(spark: SparkSession, folder: str | Path, version: str = SPINE_VERSION) -> tuple[dict, DataFrame]:
    """Manifest and labels of a reference set; one of another taxonomy is refused."""
    facts = manifest(folder)
    if facts["spine_version"] != version:
        raise ValueError(f"app {facts['app_id']} was labelled under taxonomy {facts['spine_version']}, not {version}")
    return facts, read_labels(spark, f"{folder}/labels.json")


def anchors_for(app_id: int, reference: str | Path, explicit: str | None = None) -> tuple[Anchors | None, str]:
    """Anchors by explicit path, the app's own, or the pooled ones; None means the descriptions. And a note if they were not fitted on this app."""
    for path in [explicit] if explicit else [f"{reference}/{app_id}/anchors.json", f"{reference}/anchors.json"]:
        if exists(path):
            a = Anchors.load(path)
            return a, "" if app_id in a.fitted_from or not a.fitted_from else "these anchors were not fitted on this app"
    if explicit:
        raise FileNotFoundError(explicit)
    return None, ""


def verified(path: str | Path, sha256: str) -> Path:
    """A model file whose digest is pinned; a file with another digest is deleted."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    if digest.hexdigest() != sha256:
        os.remove(path)
        raise ValueError(f"{path} is not the pinned file and was deleted")
    return Path(path)


def write_vectors(vectors: DataFrame, path: str, dimensions: int) -> None:
    """Vectors in row groups of 64 MiB."""
    vectors.write.option("compression", "zstd").option("parquet.block.size", max(64 * dimensions * 4, 64 << 20)).mode("overwrite").parquet(path)


def write_classifications(rows: DataFrame, path: str, anchors: str) -> None:
    tagged = rows.withColumn("spine_version", F.lit(SPINE_VERSION)).withColumn("anchors", F.lit(anchors))
    names = [c.split()[0] for c in CLASSIFICATIONS.split(", ")]
    # row groups of about 262,144 rows, some 60 bytes each
    tagged.select(*names).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).mode("overwrite").parquet(path)


def read_classifications(spark: SparkSession, path: str) -> DataFrame:
    """Refuses, by name, files without the column that says what the anchors were."""
    rows = spark.read.parquet(path)
    if "anchors" not in rows.columns:
        raise ValueError("stale classifications: the column 'anchors' is missing; classify again")
    return rows


def agreement_or_none(load) -> dict | None:
    """Agreement for a page, if there is any; a page does not fail for want of it."""
    try:
        return load()
    except (OSError, ValueError, KeyError):
        return None
