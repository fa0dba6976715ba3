"""Queries of the text problems, each over its whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.llm import bpe, calibrate, foldhash, langid, packing, repetition, spam, topn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(_table(spark, sf_dir, "capture"), "recommendationid", "review").withColumnRenamed("id", "recommendationid")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of reviews by tenths of repeated text, null for short ones."""
    shares = repetition.repetition(_table(spark, sf_dir, "capture"), "recommendationid", "review")
    return shares.groupBy(F.floor(F.col("share") * 10).alias("tenth")).agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_reviews(_table(spark, sf_dir, "capture")).select("appid", "recommendationid")


def p3_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best review of each app with its score and votes."""
    return topn.best_reviews(_table(spark, sf_dir, "capture"), 1).select("appid", "recommendationid", "score", "votes")


def _sampling(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _table(spark, sf_dir, "sampled_review"), _table(spark, sf_dir, "sample_target")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the calibrated draw left short of what is wanted, and that hold too few items for it."""
    return calibrate.draw_report(*_sampling(spark, sf_dir)).where("drawn < wanted and gap > 0").select("app_id", "predicted")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.sampled(*_sampling(spark, sf_dir))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and drawn share of each cell, and how many it holds and wants."""
    report = calibrate.draw_report(*_sampling(spark, sf_dir))
    return report.select("app_id", "predicted", "target_share", "drawn_share", "wanted", "drawn", "gap")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.cell_report(*_sampling(spark, sf_dir)).select("app_id", "predicted", "wanted", "available", "gap")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codes = _table(spark, sf_dir, "capture"), _table(spark, sf_dir, "language_code")
    return langid.unlabelled(rows, "recommendationid", "language", "review", codes).withColumnRenamed("id", "recommendationid")


def p5_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every review copy with its language and confidence."""
    rows, codes = _table(spark, sf_dir, "capture"), _table(spark, sf_dir, "language_code")
    return langid.languages_of(rows, "recommendationid", "language", "review", codes).withColumnRenamed("id", "recommendationid")


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review copy with its main language and confidence."""
    rows, codes = _table(spark, sf_dir, "capture"), _table(spark, sf_dir, "language_code")
    return langid.documents_of(langid.languages_of(rows, "recommendationid", "language", "review", codes)).withColumnRenamed("id", "recommendationid")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = foldhash.formatting_pairs(_table(spark, sf_dir, "capture"), "recommendationid", "review")
    return pairs.select(F.col("first_id").alias("recommendationid_a"), F.col("id").alias("recommendationid_b"))


def p7_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the reviews once, with its smallest id and its numbers of ids and of copies."""
    return foldhash.records(_table(spark, sf_dir, "capture"), "recommendationid", "review")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's containers, of the sizes of token_budget."""
    sizes = [int(r[0]) for r in _table(spark, sf_dir, "token_budget").where("capacity_tokens > 0").select("capacity_tokens").distinct().collect()]
    return packing.packed(bpe.token_counts(_table(spark, sf_dir, "documents")), sizes)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(_table(spark, sf_dir, "documents"))


def p10_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.scored(_table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (p2_found, p2_shares, p3_found, p3_ranked, p4_found, p4_sample, p4_shares, p4_report, p5_found, p5_parts, p5_documents, p7_found, p7_collapsed, p8_ids, p9_packed, p10_found, p10_scored)}

_RANKED = """ranked AS (
  SELECT appid, recommendationid, score, votes, row_number() OVER (PARTITION BY appid ORDER BY score DESC, votes DESC, recommendationid) AS k
  FROM (SELECT appid, recommendationid, max(coalesce(weighted_vote_score, 0)) AS score, max(coalesce(votes_up, 0)) AS votes
        FROM capture WHERE recommendationid IS NOT NULL GROUP BY 1, 2))"""

_CELLS = r"""cells AS (
  SELECT t.app_id, t.predicted, greatest(coalesce(min_rows, 0), CAST(round(coalesce(target_share, 0) * coalesce(sample_size, 0)) AS BIGINT)) AS wanted,
         coalesce(available, 0) AS available
  FROM sample_target t LEFT JOIN (
    SELECT app_id, lower(regexp_replace(predicted, '^[\s\p{Z}\x{85}\x{0B}]+|[\s\p{Z}\x{85}\x{0B}]+$', '', 'g')) AS category, count(DISTINCT id) AS available
    FROM sampled_review WHERE regexp_matches(review, '[^\s\p{Z}\x{85}\x{0B}]') GROUP BY 1, 2) p
  ON p.app_id = t.app_id AND p.category = lower(trim(t.predicted)))"""

SQL = {
    "p4_found": f"WITH {_CELLS} SELECT app_id, predicted FROM cells WHERE available < wanted",
    "p4_report": f"WITH {_CELLS} SELECT app_id, predicted, wanted, available, greatest(wanted - available, 0) AS gap FROM cells",
    "p3_found": f"WITH {_RANKED} SELECT appid, recommendationid FROM ranked WHERE k <= 5",
    "p3_ranked": f"WITH {_RANKED} SELECT appid, recommendationid, score, votes FROM ranked WHERE k = 1",
}
