"""Counts and rates of categories, languages and months, and the bias of the top of the pile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensmill.functions.stats import rate, ratio
from lensmill.functions.text import year_month
from lensmill.schema import CATEGORIES, SPINE_VERSION, TOP_HELPFUL


def taxonomy(spark: SparkSession) -> DataFrame:
    """``slot, category, label``: 21 rows."""
    return spark.createDataFrame([(k, c, label) for k, (c, label) in enumerate(CATEGORIES)], "slot int, category string, label string")


def current_assignments(classifications: DataFrame, version: str = SPINE_VERSION) -> DataFrame:
    """One assignment per review of the wanted taxonomy version: the surest, then the greatest by value."""
    if "anchors" not in classifications.columns:
        raise ValueError("stale classifications: the column 'anchors' is missing; classify again")
    row = F.struct("primary_score", "primary_category", "mentions", "anchors")
    wanted = classifications.where((F.col("spine_version") == version) & F.col("recommendationid").isNotNull())
    best = wanted.groupBy("recommendationid").agg(F.max(row).alias("r"))
    return best.select("recommendationid", "r.*")


def top_of_pile(reviews: DataFrame, n: int = TOP_HELPFUL) -> DataFrame:
    """The ``n`` reviews of each app with the greatest helpfulness, ties by id."""
    order = Window.partitionBy("appid").orderBy(F.desc("weighted_vote_score"), F.asc("recommendationid"))
    return reviews.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def category_counts(assigned: DataFrame, by: list[str]) -> DataFrame:
    """``by, category, primary_count, mention_count, positive_mentions`` of assigned reviews, in one shuffle."""
    tagged = F.transform("mentions", lambda m: F.struct(m.alias("category"), (m == F.col("primary_category")).alias("primary")))
    each = assigned.select(*by, F.coalesce("voted_up", F.lit(False)).alias("voted_up"), F.explode(tagged).alias("m"))
    return each.groupBy(*by, F.col("m.category").alias("category")).agg(
        F.count_if("m.primary").alias("primary_count"), F.count("*").alias("mention_count"), F.count_if("voted_up").alias("positive_mentions")
    )


def category_rates(reviews: DataFrame, assigned: DataFrame, top_n: int = TOP_HELPFUL) -> DataFrame:
    """Counts and rates per app and category, zero rows kept.

    ``mention_rate`` and ``primary_share`` are of all non-blank reviews of the app, ``positive_share``
    of the category's mentions; ``bias_factor`` is how much more often the top of the pile mentions it.
    """
    totals = reviews.groupBy("appid").agg(F.count("*").alias("reviews"))
    joined = reviews.join(assigned, "recommendationid")
    counts = category_counts(joined, ["appid"])
    # only the ids of the top are joined, not the reviews
    top = top_of_pile(reviews.select("appid", "recommendationid", "weighted_vote_score"), top_n).select("appid", "recommendationid")
    size = top.groupBy("appid").agg(F.count("*").alias("top_reviews"))
    in_top = top.join(assigned.select("recommendationid", "mentions"), "recommendationid").select("appid", F.explode("mentions").alias("category"))
    top_counts = in_top.groupBy("appid", "category").agg(F.count("*").alias("top_mention_count"))
    # every app with every category: 21 rows each, by exploding the bounded taxonomy
    grid = totals.join(size, "appid", "left").withColumn("t", F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(c).alias("category")) for k, (c, _) in enumerate(CATEGORIES)])))
    grid = grid.select("appid", "reviews", F.coalesce("top_reviews", F.lit(0)).alias("top_reviews"), "t.slot", "t.category")
    full = grid.join(counts, ["appid", "category"], "left").join(top_counts, ["appid", "category"], "left").na.fill(0)
    mention, top_rate = ratio(F.col("mention_count"), F.col("reviews")), ratio(F.col("top_mention_count"), F.col("top_reviews"))
    return full.withColumns({
        "mention_rate": mention,
        "primary_share": ratio(F.col("primary_count"), F.col("reviews")),
        "positive_share": rate(F.col("positive_mentions"), F.col("mention_count")),
        "top_mention_rate": top_rate,
        "bias_factor": F.when(F.col("mention_count") > 0, top_rate / mention),
    })


def headline_bias(rates: DataFrame, top_n: int = TOP_HELPFUL) -> DataFrame:
    """Per app the category the top exaggerates most, of those it mentions often enough; the last slot on ties."""
    enough = rates.where((F.col("mention_count") > 0) & (F.col("top_mention_count") >= F.greatest(F.lit(2), F.ceil(F.col("top_reviews") / 10))))
    return enough.groupBy("appid").agg(F.max_by("category", F.struct("bias_factor", "slot")).alias("category"), F.max("bias_factor").alias("bias_factor"))


def language_histogram(reviews: DataFrame) -> DataFrame:
    """Reviews by language; none is ``unknown``."""
    named = F.when(F.coalesce("language", F.lit("")) == "", "unknown").otherwise(F.col("language"))
    return reviews.groupBy(named.alias("language")).agg(F.count("*").alias("reviews"))


def months(reviews: DataFrame) -> DataFrame:
    """``appid, month, reviews, positive``; months without a review stay out."""
    return reviews.groupBy("appid", year_month("timestamp_created").alias("month")).agg(F.count("*").alias("reviews"), F.count_if("voted_up").alias("positive"))


def month_categories(joined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., month, category, mentions`` in long form."""
    each = joined.select(*by, year_month("timestamp_created").alias("month"), F.explode("mentions").alias("category"))
    return each.groupBy(*by, "month", "category").agg(F.count("*").alias("mentions"))


def month_rates(by_month: DataFrame) -> DataFrame:
    """``months`` with the share of reviews that are positive and the month's share of all of its app's; null without reviews."""
    whole = by_month.groupBy("appid").agg(F.sum("reviews").alias("__all"))
    out = by_month.join(whole, "appid").withColumn("positive_share", rate(F.col("positive"), F.col("reviews")))
    return out.withColumn("share", rate(F.col("reviews"), F.col("__all"))).drop("__all")


def month_extremes(by_month: DataFrame, least: int = 30) -> DataFrame:
    """Per app its busiest month (the last on ties) and its coldest of at least ``least`` reviews (the first on ties)."""
    share = F.col("positive") / F.col("reviews")
    cold = F.when(F.col("reviews") >= least, F.struct(share.alias("share"), F.col("month")))
    return by_month.groupBy("appid").agg(F.max(F.struct("reviews", "month"))["month"].alias("busiest"), F.min(cold)["month"].alias("coldest"))


def matrix(rates: DataFrame) -> DataFrame:
    """One row per category with its pooled mentions and, over apps, the greatest and least mention rate and who has them."""
    pooled = rates.groupBy("category", "slot").agg(
        F.sum("mention_count").alias("mentions"), F.max("mention_rate").alias("highest"), F.min("mention_rate").alias("lowest"),
        F.max_by("appid", F.struct("mention_rate", "appid")).alias("leader"), F.min_by("appid", F.struct("mention_rate", "appid")).alias("trailer"),
    )
    return pooled.where("mentions > 0").withColumn("spread", F.col("highest") - F.col("lowest"))


def leaders(rates: DataFrame, least: float = 0.001) -> DataFrame:
    """Per category the app that leads it, if its rate is worth printing and no other app prints the same tenth of a percent."""
    printed = rates.withColumn("tenths", F.floor(F.col("mention_rate") * 1000 + 0.5))
    best = printed.groupBy("category").agg(F.max("tenths").alias("tenths"))
    tied = printed.join(best, ["category", "tenths"]).groupBy("category").agg(F.count("*").alias("n"), F.max("appid").alias("appid"), F.max("mention_rate").alias("mention_rate"))
    return tied.where((F.col("n") == 1) & (F.col("mention_rate") >= least)).select("category", "appid")


def coverage(unique: DataFrame, crawls: DataFrame) -> DataFrame:
    """Per app the share of the reviews the store states that were captured; null if it states none."""
    stated = crawls.groupBy("app_id").agg(F.max_by("valve_total", F.struct("snapshot_unix", "id")).alias("stated"))
    got = unique.groupBy("appid").agg(F.count("*").alias("captured"))
    return got.join(stated, got.appid == stated.app_id, "left").select("appid", "captured", "stated", rate(F.col("captured"), F.coalesce("stated", F.lit(0))).alias("coverage"))
