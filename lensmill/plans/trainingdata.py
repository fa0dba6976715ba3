"""Queries of the general training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.operators import incremental, redelivery


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.last_runs(_table(spark, sf_dir, "crawl_watermark"), _table(spark, sf_dir, "crawl"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pending_keys(_table(spark, sf_dir, "capture"), _runs(spark, sf_dir))


def p1_pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a top-up takes in per app: pending reviews, and of these the ones with a time above the mark."""
    pending = incremental.pending_reviews(_table(spark, sf_dir, "capture"), _runs(spark, sf_dir))
    return pending.groupBy("appid").agg(F.count("*").alias("pending"), F.max("timestamp_updated").alias("newest"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivery.repeated_ids(_table(spark, sf_dir, "capture"), "recommendationid", "snapshot_unix").select(F.col("id").alias("recommendationid"))


def p6_one_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = redelivery.exactly_once(_table(spark, sf_dir, "capture"), "recommendationid", "snapshot_unix")
    return kept.select("recommendationid", "appid", "snapshot_unix")


QUERIES = {q.__name__: q for q in (p1_found, p1_pending_reviews, p6_found, p6_one_copy)}

_MARKS = """marks AS (
  SELECT app_id, max(CASE WHEN max_created > 0 THEN max_created END) AS mark, max(updated_unix) AS run_end
  FROM crawl_watermark GROUP BY app_id),
pending AS (
  SELECT appid, recommendationid FROM capture LEFT JOIN marks ON app_id = appid
  GROUP BY appid, recommendationid
  HAVING max(mark) IS NULL
    OR bool_or(coalesce(timestamp_created > mark, FALSE) OR coalesce(timestamp_updated > mark, FALSE))
    OR NOT bool_or(coalesce(snapshot_unix <= run_end, FALSE)))"""

SQL = {
    "p1_found": f"WITH {_MARKS} SELECT appid, recommendationid FROM pending",
    "p1_pending_reviews": f"""WITH {_MARKS},
latest AS (
  SELECT appid, recommendationid, max(coalesce(timestamp_updated, timestamp_created, 0)) AS t FROM capture GROUP BY ALL),
newest AS (
  SELECT c.appid, c.recommendationid, max(c.timestamp_updated) AS u FROM capture c JOIN latest l
  ON c.appid = l.appid AND c.recommendationid = l.recommendationid AND coalesce(c.timestamp_updated, c.timestamp_created, 0) = l.t GROUP BY ALL)
SELECT p.appid, count(*) AS pending, max(n.u) AS newest FROM pending p JOIN newest n
ON n.appid = p.appid AND n.recommendationid = p.recommendationid GROUP BY p.appid""",
    "p6_found": "SELECT recommendationid FROM capture WHERE recommendationid IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "p6_one_copy": "SELECT recommendationid, any_value(appid) AS appid, min(snapshot_unix) AS snapshot_unix FROM capture GROUP BY 1",
}
