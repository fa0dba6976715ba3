"""Reproducible draws: hash-ranked random samples, stratified round-robin, shortlists of evidence."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensmill.functions.text import not_blank, rank_key
from lensmill.schema import CATEGORY_IDS
from lensmill.shared import write_text


def smallest(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the smallest ``key``, ties by all columns."""
    return rows.orderBy(key, *rows.columns).limit(k)


def random_sample(assigned: DataFrame, per_app: int, seed: int = 1) -> DataFrame:
    """Per app the ``per_app`` reviews of the smallest rank for the purpose ``random``."""
    ranked = assigned.withColumn("rank_key", rank_key(seed, "random", "recommendationid"))
    order = Window.partitionBy("appid").orderBy("rank_key", "recommendationid")
    return ranked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_app).drop("k")


def stratified(assigned: DataFrame, per_category: int, seed: int = 1) -> DataFrame:
    """Per category ``per_category`` reviews, taken in turn from the apps in ascending order, by rank within an app.

    Each (category, app) first keeps what it could contribute at most, so the second window is small.
    """
    ranked = assigned.withColumn("rank_key", rank_key(seed, "stratified", "recommendationid"))
    own = Window.partitionBy("primary_category", "appid").orderBy("rank_key", "recommendationid")
    rounds = ranked.withColumn("round", F.row_number().over(own)).where(F.col("round") <= per_category)
    turn = Window.partitionBy("primary_category").orderBy("round", "appid")
    return rounds.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_category).drop("turn")


def drawn(assigned: DataFrame, per_app: int, per_category: int, seed: int = 1) -> DataFrame:
    """The random sample and, from what it left, the stratified one: ``recommendationid, appid, subset, predicted``."""
    columns = ["recommendationid", "appid", F.col("primary_category").alias("predicted")]
    random = random_sample(assigned, per_app, seed)
    pool = assigned.join(random.select("recommendationid"), "recommendationid", "left_anti")
    one = random.select(*columns, F.lit("random").alias("subset"))
    return one.unionByName(stratified(pool, per_category, seed).select(*columns, F.lit("stratified").alias("subset")))


def sample_summary(sample: DataFrame, per_category: int) -> DataFrame:
    """Per app and category of the taxonomy the stratified rows ``drawn`` (0 where an app supplies nothing: ``thin``), and whether all apps together stay ``short`` of ``per_category``."""
    grid = sample.select("appid").distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in CATEGORY_IDS])))
    got = sample.where("subset = 'stratified'").groupBy("appid", F.col("predicted").alias("category")).agg(F.count("*").alias("drawn"))
    full = grid.join(got, ["appid", "category"], "left").na.fill(0, ["drawn"])
    total = full.groupBy("category").agg((F.sum("drawn") < per_category).alias("short"))
    return full.withColumn("thin", F.col("drawn") == 0).join(F.broadcast(total), "category").select("appid", "category", "drawn", "thin", "short")


def with_texts(sample: DataFrame, reviews: DataFrame) -> DataFrame:
    """The sample with its texts; blank ones drop out."""
    return sample.join(reviews.select("recommendationid", "review"), "recommendationid", "left").where(not_blank("review"))


def shortlist(joined: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Per app and mentioned category the ``k`` reviews of the smallest rank for the purpose ``report``."""
    each = joined.select("recommendationid", "appid", F.explode("mentions").alias("category")).withColumn("rank_key", rank_key(seed, "report", "recommendationid"))
    order = Window.partitionBy("appid", "category").orderBy("rank_key", "recommendationid")
    return each.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


def quoted(short: DataFrame, top: DataFrame, k: int, most_top: int = 2) -> DataFrame:
    """Per app and category up to ``k`` quotes: at most ``most_top`` of the top of the pile in its order, then the shortlist without repeats.

    ``top`` has ``recommendationid, appid, rank, mentions``.
    """
    heads = top.select("recommendationid", "appid", F.explode("mentions").alias("category"), "rank")
    order = Window.partitionBy("appid", "category").orderBy("rank")
    heads = heads.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_top).select("recommendationid", "appid", "category", "place")
    rest = short.select("recommendationid", "appid", "category", (F.col("k") + most_top).alias("place"))
    both = heads.unionByName(rest).groupBy("recommendationid", "appid", "category").agg(F.min("place").alias("place"))
    final = Window.partitionBy("appid", "category").orderBy("place", "recommendationid")
    return both.withColumn("quote", F.row_number().over(final)).where(F.col("quote") <= k).select("appid", "category", "quote", "recommendationid")


def batches(sample: DataFrame, size: int) -> DataFrame:
    """Numbers the rows of each app's sample in batches of ``size``, in id order."""
    order = Window.partitionBy("appid").orderBy("recommendationid")
    return sample.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def write_sample(sample: DataFrame, folder: str, size: int = 50) -> int:
    """Write ``sample.json`` and ``batches/batch-NNN.json`` of one app; batches withhold the prediction. A sample is a bounded draw."""
    rows = [r.asDict() for r in sample.orderBy("recommendationid").collect()]
    whole = [{"id": r["recommendationid"], "app_id": r["appid"], "subset": r["subset"], "predicted": r["predicted"], "review": r["review"]} for r in rows]
    write_text(f"{folder}/sample.json", json.dumps(whole, ensure_ascii=False, indent=1))
    count = -(-len(rows) // size)
    for b in range(count):
        part = [{"id": r["id"], "review": r["review"]} for r in whole[b * size : (b + 1) * size]]
        write_text(f"{folder}/batches/batch-{b:03d}.json", json.dumps(part, ensure_ascii=False, indent=1))
    return count
