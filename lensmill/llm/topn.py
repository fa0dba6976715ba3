"""The N best items of every group, with the same answer on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmill.shared import partitions

#: Rows from which a group is heavy, and how many of the largest are treated so at most.
HEAVY_ROWS = 100_000
MOST_HEAVY = 1_000
#: Salts over which a heavy group is spread.
SALTS = 32


def heavy_groups(rows: DataFrame, group: str, heavy_rows: int = HEAVY_ROWS) -> list:
    """The groups that one task should not hold, by exact counts: the ``MOST_HEAVY`` largest of at least ``heavy_rows``.

    Any other group has under ``heavy_rows`` rows or under 1/``MOST_HEAVY`` of all.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= heavy_rows)
    return [r[0] for r in counts.orderBy(F.desc("n")).limit(MOST_HEAVY).collect()]


def _hot(column: str, heavy: list) -> Column:
    """Whether a row is of one of the ``heavy`` groups, of which one may be null."""
    named = F.coalesce(F.col(column).isin([h for h in heavy if h is not None]), F.lit(False))
    return named | F.col(column).isNull() if None in heavy else named


def top_n(items: DataFrame, group: str, order: Sequence[Column], n: int, heavy: list, keyed: str | None = None) -> DataFrame:
    """The first ``n`` rows of each ``group`` by ``order`` (a total order), with their ``rank`` from 1.

    Light groups go through an ordinary window. A heavy group is split by salt and range sorted, so
    that no task sorts it whole: each range partition keeps its first ``n`` rows of a group where
    they lie, and only these meet for the ranking. A null group is a group like any other. Groups
    with fewer than ``n`` items come out whole; columns beside the group and the order are carried
    along. ``keyed`` names a column that is never null, if there is one: with it the two branches
    read the same exchange of ``items`` instead of scanning twice.
    """
    is_hot = _hot(group, heavy)
    if keyed:  # tied to a column made by the last aggregation, so that the split stays above it
        is_hot = is_hot == F.col(keyed).isNotNull()
    within = Window.partitionBy(group).orderBy(*order)
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= n)
    if not heavy:
        return ranked(items)
    salt = F.pmod(F.xxhash64(*items.columns), F.lit(SALTS)).alias("__salt")
    salted = items.where(is_hot).select("*", salt).repartitionByRange(partitions(items.sparkSession), F.col(group), F.col("__salt"), *order)
    return ranked(items.where(~is_hot)).unionByName(ranked(salted).drop("__salt"))


def best_reviews(copies: DataFrame, n: int = 5, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``appid, recommendationid, score, votes, rank`` of each app's ``n`` best reviews.

    A review's score and votes are the greatest of its copies, null as 0; ties go to the smaller id.
    Rows with a null id are no review.
    """
    rows = copies.where("recommendationid is not null").select("appid", "recommendationid", "weighted_vote_score", "votes_up")
    reviews = rows.groupBy("appid", "recommendationid").agg(
        F.max(F.coalesce("weighted_vote_score", F.lit(0.0))).alias("score"), F.max(F.coalesce("votes_up", F.lit(0))).alias("votes")
    )
    order = [F.desc("score"), F.desc("votes"), F.asc("recommendationid")]
    return top_n(reviews, "appid", order, n, heavy_groups(copies.select("appid"), "appid", heavy_rows), "score")
