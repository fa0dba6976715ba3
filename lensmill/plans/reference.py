"""Queries over captured reviews, their classifications, samples and vectors, each over its whole tables, with its SQL."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensmill.functions import stats, text
from lensmill.operators import evaluate, planning, rates, reviews, sampling, vectors
from lensmill.schema import CATEGORY_IDS
from lensmill.shared import numbered

_REVIEW_COLUMNS = ["recommendationid", "appid", "language", "review", "timestamp_created", "voted_up", "votes_up", "weighted_vote_score"]
_MARGIN = 0.05
QUERIES: dict = {}
SQL: dict[str, str] = {}

_TAXONOMY = "tax(slot, category) AS (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(CATEGORY_IDS)) + ")"
_BLANK = r"[^\s\p{Z}\x{85}\x{0B}]"
_REVIEWS = rf"""latest AS (
  SELECT *, row_number() OVER (PARTITION BY recommendationid ORDER BY coalesce(timestamp_updated, timestamp_created, 0) DESC, coalesce(snapshot_unix, 0) DESC,
    appid DESC NULLS LAST, language DESC NULLS LAST, CAST('0x' || substr(md5(review), 1, 15) AS BIGINT) DESC NULLS LAST, timestamp_created DESC NULLS LAST, voted_up DESC NULLS LAST,
    votes_up DESC NULLS LAST, weighted_vote_score DESC NULLS LAST) AS copy
  FROM capture WHERE recommendationid IS NOT NULL),
reviews AS (
  SELECT recommendationid, appid, coalesce(language, '') AS language, review, coalesce(timestamp_created, 0) AS timestamp_created,
    coalesce(voted_up, FALSE) AS voted_up, coalesce(votes_up, 0) AS votes_up, coalesce(weighted_vote_score, 0) AS weighted_vote_score
  FROM latest WHERE copy = 1 AND regexp_matches(review, '{_BLANK}'))"""
_ASSIGNED = """ranked_classes AS (
  SELECT *, row_number() OVER (PARTITION BY recommendationid ORDER BY primary_score DESC NULLS LAST, primary_category DESC NULLS LAST, mentions DESC NULLS LAST, anchors DESC NULLS LAST) AS copy
  FROM classifications WHERE spine_version = 'core-3' AND recommendationid IS NOT NULL),
assigned AS (SELECT recommendationid, primary_category, primary_score, mentions, anchors FROM ranked_classes WHERE copy = 1)"""
_JOINED = "joined AS (SELECT r.*, a.primary_category, a.primary_score, a.mentions, a.anchors FROM reviews r JOIN assigned a USING (recommendationid))"
_BASE = f"WITH {_TAXONOMY}, {_REVIEWS}, {_ASSIGNED}, {_JOINED}"
_TRIM = r"[\s\p{Z}\x{85}\x{0B}]+"
_LABELS = f"""tags AS (
  SELECT id, lower(regexp_replace(predicted, '^{_TRIM}|{_TRIM}$', '', 'g')) AS category, subset, length(coalesce(review, '')) AS size
  FROM sampled_review WHERE id IS NOT NULL AND predicted IS NOT NULL),
labels AS (
  SELECT id, min(category) AS "primary", list_sort(list(DISTINCT category)) AS reference, min(subset) AS subset, max(size) < 60 AS ambiguous
  FROM tags WHERE category <> '' GROUP BY id),
pairs AS (
  SELECT l.*, a.primary_category AS predicted, a.mentions, a.anchors FROM labels l LEFT JOIN assigned a ON a.recommendationid = l.id)"""
_PAIRS = f"WITH {_TAXONOMY}, {_ASSIGNED}, {_LABELS}"
_COUNTERS = """tagged AS (
  SELECT "primary" AS category, 'ref_primary' AS what FROM pairs WHERE predicted IS NOT NULL
  UNION ALL SELECT predicted, 'pred_primary' FROM pairs WHERE predicted IS NOT NULL
  UNION ALL SELECT "primary", 'agreed' FROM pairs WHERE predicted = "primary"
  UNION ALL SELECT unnest(reference), 'ref_mentions' FROM pairs WHERE predicted IS NOT NULL
  UNION ALL SELECT unnest(mentions), 'pred_mentions' FROM pairs WHERE predicted IS NOT NULL
  UNION ALL SELECT unnest(list_intersect(list_distinct(reference), list_distinct(mentions))), 'mention_agreed' FROM pairs WHERE predicted IS NOT NULL),
counters AS (
  SELECT category, count(*) FILTER (what = 'ref_primary') AS ref_primary, count(*) FILTER (what = 'pred_primary') AS pred_primary,
    count(*) FILTER (what = 'agreed') AS agreed, count(*) FILTER (what = 'ref_mentions') AS ref_mentions,
    count(*) FILTER (what = 'pred_mentions') AS pred_mentions, count(*) FILTER (what = 'mention_agreed') AS mention_agreed
  FROM tagged GROUP BY category)"""
_F1 = """CASE WHEN ref_mentions > 0 OR pred_mentions > 0 THEN CASE WHEN mention_agreed > 0
  THEN 2 * (mention_agreed / pred_mentions) * (mention_agreed / ref_mentions) / (mention_agreed / pred_mentions + mention_agreed / ref_mentions) ELSE 0 END END"""
_Z = "1.959963985"
_WILSON = """greatest(0, (agreed / compared + Z2 / (2 * compared) - Z * sqrt(agreed / compared * (1 - agreed / compared) / compared + Z2 / (4 * compared * compared))) / (1 + Z2 / compared)) AS low,
least(1, (agreed / compared + Z2 / (2 * compared) + Z * sqrt(agreed / compared * (1 - agreed / compared) / compared + Z2 / (4 * compared * compared))) / (1 + Z2 / compared)) AS high""".replace("Z2", f"({_Z} * {_Z})").replace("Z *", f"{_Z} *")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reviews(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """The latest copy of each review that is not blank; its text travels only where it is asked for."""
    return reviews.with_defaults(reviews.latest_by_id(_t(spark, sf_dir, "capture"), _REVIEW_COLUMNS, text))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.current_assignments(_t(spark, sf_dir, "classifications"))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).join(_assigned(spark, sf_dir), "recommendationid")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled reviews as reference labels: the first of an id's categories is its primary, the others are secondary."""
    rows = _t(spark, sf_dir, "sampled_review").where("id is not null and predicted is not null")
    tags = rows.select("id", F.lower(F.regexp_replace("predicted", r"(?U)^\s+|\s+$", "")).alias("category"), "subset", F.char_length(F.coalesce("review", F.lit(""))).alias("size"))
    grouped = tags.where("category <> ''").groupBy("id").agg(F.array_sort(F.collect_set("category")).alias("all"), F.min("subset").alias("subset"), (F.max("size") < 60).alias("ambiguous"))
    return grouped.select("id", F.col("all")[0].alias("primary"), F.slice("all", 2, 100).alias("secondary"), "subset", "ambiguous")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compared(_labels(spark, sf_dir), _assigned(spark, sf_dir))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.category_rates(_reviews(spark, sf_dir), _assigned(spark, sf_dir))


def _round(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# captured reviews


@query(f"WITH {_REVIEWS} SELECT recommendationid, appid, language, timestamp_created, voted_up, votes_up, weighted_vote_score FROM reviews")
def latest_by_id(spark, sf_dir):
    return _reviews(spark, sf_dir)


@query("SELECT appid, max(snapshot_unix) AS snapshot_unix FROM capture GROUP BY appid")
def newest_snapshot(spark, sf_dir):
    return reviews.newest_snapshot(_t(spark, sf_dir, "capture"))


def _json(path: str, kind: str, sql: str) -> str:
    return f"CASE WHEN json_type(raw_json, '{path}') IN ({kind}) THEN {sql} END"


_WHOLE = "'BIGINT', 'UBIGINT'"


@query(
    "SELECT recommendationid, snapshot_unix, "
    + _json("$.language", "'VARCHAR'", "json_extract_string(raw_json, '$.language')") + " AS language, "
    + _json("$.votes_up", _WHOLE, "CAST(json_extract_string(raw_json, '$.votes_up') AS BIGINT)") + " AS votes_up, "
    + _json("$.author.num_reviews", _WHOLE, "CAST(json_extract_string(raw_json, '$.author.num_reviews') AS BIGINT)") + " AS author_num_reviews, "
    + _json("$.timestamp_created", _WHOLE, "CAST(json_extract_string(raw_json, '$.timestamp_created') AS BIGINT)") + " AS timestamp_created, "
    + _json("$.voted_up", "'BOOLEAN'", "CAST(json_extract_string(raw_json, '$.voted_up') AS BOOLEAN)") + " AS voted_up, "
    + _json("$.weighted_vote_score", "'VARCHAR', 'DOUBLE', 'BIGINT', 'UBIGINT'", "TRY_CAST(json_extract_string(raw_json, '$.weighted_vote_score') AS DOUBLE)") + " AS weighted_vote_score "
    "FROM (SELECT json_extract_string(raw_json, '$.recommendationid') AS recommendationid, snapshot_unix, raw_json FROM capture WHERE json_valid(raw_json)) WHERE recommendationid IS NOT NULL"
)
def json_extract_strict(spark, sf_dir):
    read = reviews.parsed(_t(spark, sf_dir, "capture"), keep=["snapshot_unix"])
    return read.select("recommendationid", "snapshot_unix", "language", "votes_up", "author_num_reviews", "timestamp_created", "voted_up", "weighted_vote_score")


@query(f"WITH {_REVIEWS} SELECT appid, count(*) AS reviews, count(DISTINCT sha256(review)) AS texts, round(1 - count(DISTINCT sha256(review)) / count(*), 9) AS dedupe_rate FROM reviews GROUP BY appid")
def text_dedupe(spark, sf_dir):
    per_text = _reviews(spark, sf_dir, text=True).groupBy("appid", text.text_key("review").alias("text_sha256")).agg(F.count("*").alias("n"))
    out = per_text.groupBy("appid").agg(F.sum("n").alias("reviews"), F.count("*").alias("texts"))
    return out.withColumn("dedupe_rate", F.round(1 - F.col("texts") / F.col("reviews"), 9))


@query("SELECT DISTINCT c.recommendationid, c.appid FROM capture c WHERE c.recommendationid IN (SELECT id FROM sampled_review)")
def id_semi_join(spark, sf_dir):
    ids = _t(spark, sf_dir, "sampled_review").select(F.col("id").alias("recommendationid"))
    return reviews.semi_by_id(_t(spark, sf_dir, "capture").select("recommendationid", "appid"), ids).distinct()


@query(f"{_BASE} SELECT appid, count(*) AS unmatched FROM reviews WHERE recommendationid NOT IN (SELECT recommendationid FROM assigned) GROUP BY appid")
def unmatched_reviews(spark, sf_dir):
    return _reviews(spark, sf_dir).join(_assigned(spark, sf_dir), "recommendationid", "left_anti").groupBy("appid").agg(F.count("*").alias("unmatched"))


# counts and rates

_RATES_SQL = f"""{_BASE},
totals AS (SELECT appid, count(*) AS reviews FROM reviews GROUP BY appid),
counts AS (
  SELECT appid, category, count(*) FILTER (category = primary_category) AS primary_count, count(*) AS mention_count, count(*) FILTER (voted_up) AS positive_mentions
  FROM (SELECT appid, primary_category, voted_up, unnest(mentions) AS category FROM joined) GROUP BY ALL),
pile AS (SELECT * FROM (SELECT recommendationid, appid, row_number() OVER (PARTITION BY appid ORDER BY weighted_vote_score DESC, recommendationid) AS rank FROM reviews) WHERE rank <= 50),
sizes AS (SELECT appid, count(*) AS top_reviews FROM pile GROUP BY appid),
tops AS (SELECT appid, category, count(*) AS top_mention_count FROM (SELECT p.appid, unnest(a.mentions) AS category FROM pile p JOIN assigned a USING (recommendationid)) GROUP BY ALL),
rates AS (
  SELECT t.appid, t.reviews, s.top_reviews, x.slot, x.category, coalesce(c.primary_count, 0) AS primary_count, coalesce(c.mention_count, 0) AS mention_count,
    coalesce(c.positive_mentions, 0) AS positive_mentions, coalesce(o.top_mention_count, 0) AS top_mention_count,
    coalesce(c.mention_count, 0) / t.reviews AS mention_rate, coalesce(c.primary_count, 0) / t.reviews AS primary_share,
    CASE WHEN c.mention_count > 0 THEN c.positive_mentions / c.mention_count END AS positive_share,
    coalesce(o.top_mention_count, 0) / s.top_reviews AS top_mention_rate,
    CASE WHEN c.mention_count > 0 THEN (coalesce(o.top_mention_count, 0) / s.top_reviews) / (c.mention_count / t.reviews) END AS bias_factor
  FROM totals t JOIN sizes s USING (appid) CROSS JOIN tax x LEFT JOIN counts c ON c.appid = t.appid AND c.category = x.category LEFT JOIN tops o ON o.appid = t.appid AND o.category = x.category)"""


@query(f"""{_RATES_SQL} SELECT appid, reviews, top_reviews, slot, category, primary_count, mention_count, positive_mentions, top_mention_count, round(mention_rate, 9) AS mention_rate,
round(primary_share, 9) AS primary_share, round(positive_share, 9) AS positive_share, round(top_mention_rate, 9) AS top_mention_rate, round(bias_factor, 9) AS bias_factor FROM rates""")
def category_rates(spark, sf_dir):
    return _round(_rates(spark, sf_dir), "mention_rate", "primary_share", "positive_share", "top_mention_rate", "bias_factor")


@query(f"{_BASE} SELECT slot, x.category, coalesce(n, 0) AS primary_count FROM tax x LEFT JOIN (SELECT primary_category, count(*) AS n FROM joined GROUP BY 1) c ON c.primary_category = x.category")
def primary_counts(spark, sf_dir):
    counts = _joined(spark, sf_dir).groupBy(F.col("primary_category").alias("category")).agg(F.count("*").alias("primary_count"))
    return rates.taxonomy(spark).select("slot", "category").join(counts, "category", "left").na.fill(0, ["primary_count"])


@query(f"{_BASE} SELECT category, count(*) AS mention_count, count(*) FILTER (voted_up) AS positive_mentions FROM (SELECT voted_up, unnest(mentions) AS category FROM joined) GROUP BY category")
def mention_counts(spark, sf_dir):
    return rates.category_counts(_joined(spark, sf_dir), []).select("category", "mention_count", "positive_mentions")


@query(f"WITH {_REVIEWS} SELECT * FROM (SELECT appid, recommendationid, weighted_vote_score, CAST(row_number() OVER (PARTITION BY appid ORDER BY weighted_vote_score DESC, recommendationid) AS INTEGER) AS rank FROM reviews) WHERE rank <= 50")
def top_of_pile(spark, sf_dir):
    return rates.top_of_pile(_reviews(spark, sf_dir)).select("appid", "recommendationid", "weighted_vote_score", "rank")


@query(f"""{_RATES_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY bias_factor DESC, slot DESC) AS k FROM rates WHERE mention_count > 0 AND top_mention_count >= greatest(2, ceil(top_reviews / 10)))
SELECT appid, category, round(bias_factor, 9) AS bias_factor FROM best WHERE k = 1""")
def headline_bias(spark, sf_dir):
    return _round(rates.headline_bias(_rates(spark, sf_dir)), "bias_factor")


@query(f"WITH {_REVIEWS} SELECT CASE WHEN language = '' THEN 'unknown' ELSE language END AS language, count(*) AS reviews FROM reviews GROUP BY 1")
def language_histogram(spark, sf_dir):
    return rates.language_histogram(_reviews(spark, sf_dir))


@query(f"""WITH {_REVIEWS} SELECT appid, count(*) FILTER (lower(trim(language)) NOT IN ('english', 'en')) AS others, round(count(*) FILTER (lower(trim(language)) NOT IN ('english', 'en')) / count(*), 9) AS share FROM reviews GROUP BY appid""")
def non_english_share(spark, sf_dir):
    other = F.count_if(~F.lower(F.trim("language")).isin("english", "en"))
    return _reviews(spark, sf_dir).groupBy("appid").agg(other.alias("others"), F.round(other / F.count("*"), 9).alias("share"))


_MONTH = "strftime(make_timestamp(timestamp_created * 1000000), '%Y-%m')"


@query(f"WITH {_REVIEWS} SELECT appid, {_MONTH} AS month, count(*) AS reviews, count(*) FILTER (voted_up) AS positive FROM reviews GROUP BY ALL")
def month_calendar(spark, sf_dir):
    return rates.months(_reviews(spark, sf_dir))


@query(f"{_BASE} SELECT month, category, count(*) AS mentions FROM (SELECT {_MONTH} AS month, unnest(mentions) AS category FROM joined) GROUP BY ALL")
def month_category_rates(spark, sf_dir):
    return rates.month_categories(_joined(spark, sf_dir))


@query(f"""WITH {_REVIEWS}, m AS (SELECT appid, {_MONTH} AS month, count(*) AS reviews, count(*) FILTER (voted_up) AS positive FROM reviews GROUP BY ALL),
busy AS (SELECT appid, month FROM (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY reviews DESC, month DESC) AS k FROM m) WHERE k = 1),
cold AS (SELECT appid, month FROM (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY positive / reviews, month) AS k FROM m WHERE reviews >= 30) WHERE k = 1)
SELECT b.appid, b.month AS busiest, c.month AS coldest FROM busy b LEFT JOIN cold c USING (appid)""")
def month_extremes(spark, sf_dir):
    return rates.month_extremes(rates.months(_reviews(spark, sf_dir)))


@query(f"WITH {_REVIEWS} SELECT appid, count(*) AS reviews, round(count(*) FILTER (voted_up) / count(*), 9) AS baseline FROM reviews GROUP BY appid")
def positive_baseline(spark, sf_dir):
    n = F.count("*")
    return _reviews(spark, sf_dir).groupBy("appid").agg(n.alias("reviews"), F.round(stats.ratio(F.count_if("voted_up"), n), 9).alias("baseline"))


@query(f"""{_RATES_SQL} SELECT category, slot, CAST(sum(mention_count) AS BIGINT) AS mentions, round(max(mention_rate), 9) AS highest, round(min(mention_rate), 9) AS lowest,
arg_max(appid, (mention_rate, appid)) AS leader, arg_min(appid, (mention_rate, appid)) AS trailer, round(max(mention_rate) - min(mention_rate), 9) AS spread FROM rates GROUP BY ALL HAVING sum(mention_count) > 0""")
def category_app_matrix(spark, sf_dir):
    return _round(rates.matrix(_rates(spark, sf_dir)), "highest", "lowest", "spread")


@query(f"""{_RATES_SQL}, p AS (SELECT *, floor(mention_rate * 1000 + 0.5) AS tenths FROM rates), b AS (SELECT category, max(tenths) AS tenths FROM p GROUP BY 1)
SELECT p.category, max(appid) AS appid FROM p JOIN b ON p.category = b.category AND p.tenths = b.tenths GROUP BY p.category HAVING count(*) = 1 AND max(mention_rate) >= 0.001""")
def leading_app(spark, sf_dir):
    return rates.leaders(_rates(spark, sf_dir))


@query(f"""{_RATES_SQL}, m AS (SELECT slot, category, max(mention_rate) - min(mention_rate) AS spread FROM rates GROUP BY ALL HAVING sum(mention_count) > 0)
SELECT category, round(spread, 9) AS spread FROM m WHERE spread >= 0.001 ORDER BY m.spread DESC, slot LIMIT 1""")
def widest_apart(spark, sf_dir):
    wide = rates.matrix(_rates(spark, sf_dir)).where("spread >= 0.001").orderBy(F.desc("spread"), "slot").limit(1)
    return _round(wide.select("category", "spread"), "spread")


@query(f"""WITH {_REVIEWS}, stated AS (SELECT app_id, arg_max(valve_total, (snapshot_unix, id)) AS stated FROM crawl GROUP BY app_id)
SELECT appid, count(*) AS captured, any_value(stated) AS stated, round(CASE WHEN any_value(stated) > 0 THEN count(*) / any_value(stated) END, 9) AS coverage FROM reviews LEFT JOIN stated ON app_id = appid GROUP BY appid""")
def coverage(spark, sf_dir):
    return _round(rates.coverage(_reviews(spark, sf_dir), _t(spark, sf_dir, "crawl")), "coverage")


@query(f"""{_RATES_SQL}, b AS (SELECT appid, count(*) FILTER (voted_up) / count(*) AS baseline FROM reviews GROUP BY appid),
w AS (SELECT r.appid, category, baseline, positive_mentions AS agreed, mention_count AS compared FROM rates r JOIN b USING (appid) WHERE mention_count > 0),
i AS (SELECT *, {_WILSON} FROM w)
SELECT appid, category, CASE WHEN low > baseline THEN 'warmer' WHEN high < baseline THEN 'colder' ELSE 'neutral' END AS tone FROM i""")
def warm_cold_tone(spark, sf_dir):
    base = _reviews(spark, sf_dir).groupBy("appid").agg((F.count_if("voted_up") / F.count("*")).alias("baseline"))
    rows = _rates(spark, sf_dir).where("mention_count > 0").join(base, "appid")
    return rows.select("appid", "category", stats.tone(F.col("positive_mentions"), F.col("mention_count"), F.col("baseline")).alias("tone"))


@query(f"{_RATES_SQL} SELECT appid, category, round(least(1, sqrt(2 * mention_rate)), 9) AS heat, round(CASE WHEN bias_factor <= 0 THEN -1 ELSE greatest(-1, least(1, log2(bias_factor) / 3)) END, 9) AS gauge FROM rates WHERE mention_count > 0")
def heat_and_gauge(spark, sf_dir):
    rows = _rates(spark, sf_dir).where("mention_count > 0")
    return rows.select("appid", "category", F.round(stats.heat(F.col("mention_rate")), 9).alias("heat"), F.round(stats.gauge(F.col("bias_factor")), 9).alias("gauge"))


# samples and shortlists


def _rank_sql(purpose: str) -> str:
    return rf"sha256('\x01\x00\x00\x00\x00\x00\x00\x00'::BLOB || '{purpose}'::BLOB || recommendationid::BLOB)"


_RANDOM_SQL = f"""pool AS (SELECT recommendationid, appid, primary_category, mentions FROM joined),
random_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY appid ORDER BY {_rank_sql('random')}, recommendationid) AS k FROM pool) WHERE k <= 5)"""
_STRATIFIED_SQL = f"""left_over AS (SELECT * FROM pool WHERE recommendationid NOT IN (SELECT recommendationid FROM random_rows)),
rounds AS (SELECT *, row_number() OVER (PARTITION BY primary_category, appid ORDER BY {_rank_sql('stratified')}, recommendationid) AS round FROM left_over),
turns AS (SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY round, appid) AS turn FROM rounds)"""


@query(f"{_BASE}, {_RANDOM_SQL} SELECT appid, recommendationid, lower({_rank_sql('random')}) AS rank_key FROM random_rows")
def rank_random_sample(spark, sf_dir):
    return sampling.random_sample(_joined(spark, sf_dir), 5).select("appid", "recommendationid", "rank_key")


@query(f"""{_BASE}, {_RANDOM_SQL}, {_STRATIFIED_SQL}
SELECT recommendationid, appid, primary_category AS predicted, 'random' AS subset FROM random_rows UNION ALL SELECT recommendationid, appid, primary_category, 'stratified' FROM turns WHERE turn <= 30""")
def stratified_round_robin(spark, sf_dir):
    return sampling.drawn(_joined(spark, sf_dir), 5, 30)


@query(f"""{_BASE}, {_RANDOM_SQL}, {_STRATIFIED_SQL}, drawn AS (SELECT primary_category, 'random' AS subset FROM random_rows UNION ALL SELECT primary_category, 'stratified' FROM turns WHERE turn <= 30)
SELECT x.category, count(d.subset) AS drawn, count(d.subset) FILTER (d.subset = 'stratified') AS stratified FROM tax x LEFT JOIN drawn d ON d.primary_category = x.category GROUP BY x.category""")
def sample_counts(spark, sf_dir):
    drawn = sampling.drawn(_joined(spark, sf_dir), 5, 30).groupBy(F.col("predicted").alias("category")).agg(F.count("*").alias("drawn"), F.count_if(F.col("subset") == "stratified").alias("stratified"))
    return rates.taxonomy(spark).select("category").join(drawn, "category", "left").na.fill(0)


_SHORT_SQL = f"short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY appid, category ORDER BY {_rank_sql('report')}, recommendationid) AS k FROM (SELECT recommendationid, appid, unnest(mentions) AS category FROM joined)) WHERE k <= 6)"


@query(f"{_BASE}, {_SHORT_SQL} SELECT appid, category, CAST(k AS INTEGER) AS k, recommendationid FROM short")
def evidence_shortlist(spark, sf_dir):
    return sampling.shortlist(_joined(spark, sf_dir), 6).select("appid", "category", "k", "recommendationid")


@query(f"""{_BASE}, {_SHORT_SQL},
pile AS (SELECT * FROM (SELECT recommendationid, appid, row_number() OVER (PARTITION BY appid ORDER BY weighted_vote_score DESC, recommendationid) AS rank FROM reviews) WHERE rank <= 50),
heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY appid, category ORDER BY rank) AS place FROM (SELECT p.recommendationid, p.appid, p.rank, unnest(a.mentions) AS category FROM pile p JOIN assigned a USING (recommendationid))) WHERE place <= 2),
both_ AS (SELECT recommendationid, appid, category, min(place) AS place FROM (SELECT recommendationid, appid, category, place FROM heads UNION ALL SELECT recommendationid, appid, category, k + 2 FROM short) GROUP BY ALL)
SELECT appid, category, CAST(quote AS INTEGER) AS quote, recommendationid FROM (SELECT *, row_number() OVER (PARTITION BY appid, category ORDER BY place, recommendationid) AS quote FROM both_) WHERE quote <= 6""")
def quoted_evidence(spark, sf_dir):
    top = rates.top_of_pile(_reviews(spark, sf_dir)).select("recommendationid", "appid", "rank").join(_assigned(spark, sf_dir).select("recommendationid", "mentions"), "recommendationid")
    return sampling.quoted(sampling.shortlist(_joined(spark, sf_dir), 6), top, 6)


@query(f"WITH {_ASSIGNED} SELECT recommendationid, CAST((row_number() OVER (ORDER BY recommendationid) - 1) % 5 AS INTEGER) AS fold FROM assigned WHERE recommendationid IN (SELECT id FROM sampled_review)")
def kfold_assignment(spark, sf_dir):
    ids = _t(spark, sf_dir, "sampled_review").select(F.col("id").alias("recommendationid")).distinct()
    wanted = _assigned(spark, sf_dir).join(ids, "recommendationid", "left_semi").select("recommendationid")
    return numbered(wanted, "recommendationid", "place").select("recommendationid", F.pmod("place", F.lit(5)).cast("int").alias("fold"))


# agreement with reference labels


@query(f'{_PAIRS} SELECT id, "primary", predicted, subset, ambiguous FROM pairs')
def label_prediction_join(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", "primary", "predicted", "subset", "ambiguous")


@query(f'{_PAIRS} SELECT "primary", predicted, count(*) AS n FROM pairs WHERE predicted IS NOT NULL GROUP BY ALL')
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_pairs(spark, sf_dir))


@query(f"""{_PAIRS}, said AS (SELECT "primary", CASE WHEN ambiguous THEN 'verdict' ELSE predicted END AS predicted FROM pairs WHERE predicted IS NOT NULL),
off AS (SELECT "primary", predicted, count(*) AS n FROM said WHERE predicted <> "primary" GROUP BY ALL),
r AS (SELECT o.*, sum(n) OVER (PARTITION BY "primary") AS misses, row_number() OVER (PARTITION BY "primary" ORDER BY n DESC, slot DESC) AS k FROM off o LEFT JOIN tax ON category = predicted)
SELECT "primary", predicted AS taken_for, n FROM r WHERE k = 1 AND n >= 3 AND n * 4 >= misses""")
def mistaken_for(spark, sf_dir):
    """What each category is taken for by a classifier that answers ``verdict`` to every contested review."""
    pairs = _pairs(spark, sf_dir)
    said = pairs.withColumn("predicted", F.when(F.col("predicted").isNotNull() & F.col("ambiguous"), "verdict").otherwise(F.col("predicted")))
    return evaluate.mistaken_for(evaluate.confusion(said))


@query(f"""{_PAIRS}, {_COUNTERS} SELECT *, round(CASE WHEN pred_mentions > 0 THEN mention_agreed / pred_mentions END, 9) AS precision,
round(CASE WHEN ref_mentions > 0 THEN mention_agreed / ref_mentions END, 9) AS recall, round({_F1}, 9) AS f1 FROM counters""")
def precision_recall_f1(spark, sf_dir):
    return _round(evaluate.category_scores(evaluate.category_counters(_pairs(spark, sf_dir))), "precision", "recall", "f1")


@query(f"{_PAIRS}, {_COUNTERS} SELECT round(avg({_F1}), 9) AS macro_f1, count(*) AS categories FROM counters WHERE ref_mentions > 0")
def macro_f1(spark, sf_dir):
    return _round(evaluate.macro_f1(evaluate.category_scores(evaluate.category_counters(_pairs(spark, sf_dir)))), "macro_f1")


@query(f"""{_PAIRS}, s AS (SELECT subset, ambiguous, CAST(grouping(ambiguous) AS INTEGER) AS whole, count(*) FILTER ("primary" = predicted) AS agreed, count(*) AS compared
FROM pairs WHERE predicted IS NOT NULL GROUP BY GROUPING SETS ((subset), (subset, ambiguous))), i AS (SELECT *, {_WILSON} FROM s)
SELECT subset, ambiguous, whole, agreed, compared, round(agreed / compared, 9) AS agreement, round(low, 9) AS low, round(high, 9) AS high FROM i""")
def agreement_slices(spark, sf_dir):
    return _round(evaluate.slices(_pairs(spark, sf_dir)), "agreement", "low", "high")


@query(f"{_PAIRS}, {_COUNTERS} SELECT c.* FROM counters c JOIN tax USING (category)")
def pooled_agreement(spark, sf_dir):
    """Counters by subset, pooled again: counts are summed."""
    return evaluate.pooled(evaluate.category_counters(_pairs(spark, sf_dir), ["subset"]))


@query(f"""{_PAIRS}, v AS (SELECT id, predicted = "primary" AS a, list_contains(mentions, "primary") AS b FROM pairs WHERE predicted IS NOT NULL),
c AS (SELECT count(*) FILTER (NOT a AND b) AS gained, count(*) FILTER (a AND NOT b) AS lost FROM v) SELECT gained, lost, round(CASE WHEN gained + lost > 0 THEN
least(1, 2 * (SELECT sum(exp(lgamma(gained + lost + 1) - lgamma(k + 1) - lgamma(gained + lost - k + 1) + (gained + lost) * ln(0.5))) FROM range(0, 100000) t(k) WHERE k <= least(gained, lost))) END, 9) AS p FROM c""")
def mcnemar_exact(spark, sf_dir):
    """Whether counting any mention as right instead of the primary alone changes the verdicts."""
    pairs = _pairs(spark, sf_dir).where("predicted is not null")
    first = pairs.select("id", (F.col("predicted") == F.col("primary")).alias("right"))
    second = pairs.select("id", F.array_contains("mentions", F.col("primary")).alias("right"))
    return _round(evaluate.paired(first, second), "p")


@query(f"{_PAIRS} SELECT list_sort(list(DISTINCT anchors)) AS anchors, count(DISTINCT anchors) > 1 AS mixed FROM pairs WHERE anchors IS NOT NULL")
def anchor_provenance(spark, sf_dir):
    return evaluate.provenance(_pairs(spark, sf_dir))


@query("SELECT DISTINCT recommendationid AS id FROM classifications WHERE recommendationid NOT IN (SELECT id FROM sampled_review WHERE id IS NOT NULL)")
def missing_labels_anti(spark, sf_dir):
    drawn = _t(spark, sf_dir, "classifications").select(F.col("recommendationid").alias("id"))
    return evaluate.returned(drawn, _labels_as_returned(spark, sf_dir))["missing"]


def _labels_as_returned(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    return _t(spark, sf_dir, "sampled_review").select("id", F.lower(F.col("predicted")).alias("primary"), none.alias("secondary"))


@query(f"SELECT DISTINCT lower(predicted) AS category FROM sampled_review WHERE predicted IS NOT NULL AND lower(predicted) NOT IN ({', '.join(repr(c) for c in CATEGORY_IDS)})")
def unknown_categories_anti(spark, sf_dir):
    return evaluate.returned(_t(spark, sf_dir, "sampled_review").select("id"), _labels_as_returned(spark, sf_dir))["bad_category"]


@query("SELECT id FROM sampled_review WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def duplicate_labels(spark, sf_dir):
    return evaluate.returned(_t(spark, sf_dir, "sampled_review").select("id"), _labels_as_returned(spark, sf_dir))["duplicate"]


# crawls


@query("SELECT app_id, max(id) AS id FROM crawl WHERE finished_unix IS NULL GROUP BY app_id")
def unfinished_crawls(spark, sf_dir):
    return planning.unfinished(_t(spark, sf_dir, "crawl"))


@query("SELECT app_id, max(max_created) AS max_created FROM crawl_watermark WHERE max_created > 0 GROUP BY app_id")
def watermark_lookup(spark, sf_dir):
    return planning.watermarks(_t(spark, sf_dir, "crawl"), _t(spark, sf_dir, "crawl_watermark"))


@query("""SELECT appid, snapshot_unix, count(DISTINCT recommendationid) AS "rows", any_value(valve_total) AS expected,
any_value(valve_total) > 0 AND any_value(valve_total) - count(DISTINCT recommendationid) > 20 AND count(DISTINCT recommendationid) < any_value(valve_total) * 0.95 AS short
FROM capture JOIN (SELECT app_id, snapshot_unix AS s, max(valve_total) AS valve_total FROM crawl GROUP BY ALL) ON app_id = appid AND s = snapshot_unix GROUP BY ALL""")
def shortfall(spark, sf_dir):
    crawls = _t(spark, sf_dir, "crawl").groupBy(F.col("app_id").alias("appid"), "snapshot_unix").agg(F.max("valve_total").alias("expected"))
    got = _t(spark, sf_dir, "capture").groupBy("appid", "snapshot_unix").agg(F.countDistinct("recommendationid").alias("rows"))
    return got.join(crawls, ["appid", "snapshot_unix"]).withColumn("short", planning.fell_short(F.col("rows"), F.col("expected")))


_PLAN_SQL = """WITH RECURSIVE h AS (SELECT appid, timestamp_created AS ts, count(*) AS n FROM capture WHERE timestamp_created IS NOT NULL GROUP BY ALL),
w AS (
  SELECT appid, a, b, CAST(sum(n) AS BIGINT) AS held FROM (SELECT appid, min(ts) AS a, max(ts) AS b FROM h GROUP BY appid) JOIN h USING (appid) GROUP BY ALL
  UNION ALL
  SELECT appid, a, b, CAST(sum(n) AS BIGINT) AS held FROM (
    SELECT appid, unnest([a, a + (b - a) // 2 + 1]) AS a, unnest([a + (b - a) // 2, b]) AS b FROM w WHERE held > 40 AND b - a > 86400) x
  JOIN h USING (appid) WHERE h.ts BETWEEN x.a AND x.b GROUP BY ALL),
plan AS (SELECT appid, a AS start_date, b AS end_date, held AS expected FROM w WHERE NOT (held > 40 AND b - a > 86400))"""


def _plan(spark, sf_dir):
    return planning.shard_plan(_t(spark, sf_dir, "capture"), F.min("at"), F.max("at"), target=40)


@query(f"{_PLAN_SQL} SELECT * FROM plan")
def shard_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"""{_PLAN_SQL} SELECT appid, count(*) AS windows, CAST(sum(expected) AS BIGINT) AS expected, NOT EXISTS (
SELECT 1 FROM plan x JOIN plan y ON x.appid = y.appid AND (x.start_date, x.end_date) <> (y.start_date, y.end_date) AND x.start_date <= y.end_date AND y.start_date <= x.end_date WHERE x.appid = p.appid) AS disjoint FROM plan p GROUP BY appid""")
def shard_disjoint(spark, sf_dir):
    return planning.disjoint(_plan(spark, sf_dir))


# vectors


def _anchors(spark, sf_dir) -> vectors.Anchors:
    """Anchor k: the vector of the smallest id with label k; a bounded set of rows."""
    rows = _t(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).orderBy("label").collect()
    return vectors.Anchors(np.array([r.v for r in rows], dtype=np.float64), margin=_MARGIN)


_SIMS = f"""anchors AS (SELECT label AS slot, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
sims AS (SELECT e.vec_id, a.slot, list_dot_product(e.embedding::DOUBLE[], a.v) AS sim FROM embeddings e CROSS JOIN anchors a),
best AS (SELECT vec_id, max(sim) AS top, arg_max(slot, (sim, slot)) AS slot FROM sims GROUP BY vec_id),
near AS (SELECT s.vec_id, b.slot, list_sort(list(s.slot) FILTER (s.slot = b.slot OR (s.sim >= b.top - {_MARGIN} AND s.slot NOT IN (4, 5)))) AS m FROM sims s JOIN best b USING (vec_id) GROUP BY ALL),
tags AS (SELECT vec_id, slot, CASE WHEN slot IN (4, 5) OR len(m) > 4 THEN [slot] ELSE m END AS mentions FROM near)"""
_DOC_TAGS = f"""{_SIMS}, texts AS (SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE regexp_matches(text, '{_BLANK}')),
text_tags AS (SELECT text_sha256, arg_min(slot, doc_id) AS slot, arg_min(mentions, doc_id) AS mentions FROM texts JOIN tags ON vec_id = doc_id GROUP BY 1),
doc_tags AS (SELECT t.doc_id, g.slot, g.mentions FROM texts t JOIN text_tags g USING (text_sha256))"""


def _doc_tags(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents with their text's key, and the assignment of each distinct text that has a vector."""
    docs = _t(spark, sf_dir, "documents").where(text.not_blank("text")).select("doc_id", text.text_key("text").alias("text_sha256"))
    own = docs.join(_t(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    distinct = own.groupBy("text_sha256").agg(F.min_by("embedding", "doc_id").alias("embedding"))
    return docs, vectors.assigned(distinct, _anchors(spark, sf_dir))


@query(f"WITH {_SIMS} SELECT vec_id, CAST(slot AS INTEGER) AS slot, mentions FROM tags")
def assign_vectors(spark, sf_dir):
    return vectors.assigned(_t(spark, sf_dir, "embeddings"), _anchors(spark, sf_dir), keep=["vec_id"]).drop("score")


@query(f"WITH {_DOC_TAGS} SELECT doc_id, CAST(slot AS INTEGER) AS slot, mentions FROM doc_tags")
def text_sha_join(spark, sf_dir):
    docs, tags = _doc_tags(spark, sf_dir)
    return docs.join(tags, "text_sha256").select("doc_id", "slot", "mentions")


@query(f"""WITH {_DOC_TAGS}, n AS (SELECT count(*) AS reviews FROM texts), m AS (SELECT s, count(*) AS mention_count FROM (SELECT unnest(mentions) AS s FROM doc_tags) GROUP BY 1),
p AS (SELECT slot, count(*) AS primary_count FROM doc_tags GROUP BY 1)
SELECT CAST(s AS INTEGER) AS slot, mention_count, coalesce(primary_count, 0) AS primary_count, round(mention_count / reviews, 9) AS mention_rate, round(coalesce(primary_count, 0) / reviews, 9) AS primary_share FROM m LEFT JOIN p ON p.slot = s CROSS JOIN n""")
def mention_rates(spark, sf_dir):
    docs, tags = _doc_tags(spark, sf_dir)
    # every document also counts for slot -1, so that their number comes out of the same aggregation
    joined = docs.join(tags, "text_sha256", "left")
    each = joined.select(F.col("slot").alias("p"), F.explode(F.concat(F.array(F.lit(-1)), F.coalesce("mentions", F.array().cast("array<int>")))).alias("slot"))
    counts = each.groupBy("slot").agg(F.count("*").alias("mention_count"), F.count_if(F.col("p") == F.col("slot")).alias("primary_count"))
    total = F.max(F.when(F.col("slot") == -1, F.col("mention_count"))).over(Window.partitionBy())  # over one row a slot
    out = counts.withColumns({"mention_rate": F.round(stats.ratio(F.col("mention_count"), total), 9), "primary_share": F.round(stats.ratio(F.col("primary_count"), total), 9)})
    return out.where("slot >= 0")


_EACH = "SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings"


@query(f"SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 9) AS value FROM ({_EACH}) GROUP BY pos")
def corpus_centroid(spark, sf_dir):
    return _round(vectors.centroid(_t(spark, sf_dir, "embeddings")), "value")


@query(f"SELECT CAST(pos AS INTEGER) AS pos, round(avg(m), 9) AS value FROM (SELECT label, pos, avg(x) AS m FROM ({_EACH}) GROUP BY ALL) GROUP BY pos")
def pooled_centroid(spark, sf_dir):
    return _round(vectors.pooled_centroid(_t(spark, sf_dir, "embeddings"), "label"), "value")


@query(f"""WITH each AS ({_EACH}), parts AS (SELECT label AS slot, pos, x, 1.0::DOUBLE AS w FROM each UNION ALL SELECT (label + 1) % 10, pos, x, 0.5::DOUBLE FROM each WHERE vec_id % 3 = 0)
SELECT CAST(slot AS INTEGER) AS slot, CAST(pos AS INTEGER) AS pos, round(sum(x * w), 6) AS total, round(sum(w), 6) AS evidence FROM parts GROUP BY ALL""")
def fit_sums(spark, sf_dir):
    """Weighted sums per category: every third vector also counts half for the next category."""
    e = _t(spark, sf_dir, "embeddings").select("embedding", F.col("label").alias("slot"), F.when(F.col("vec_id") % 3 == 0, F.array(((F.col("label") + 1) % 10).cast("int"))).alias("secondary"))
    return _round(vectors.weighted_sums(e, 0.5), "total", "evidence", digits=6)


@query(f"WITH {_SIMS}, middle AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM ({_EACH}) GROUP BY pos)) SELECT CAST(slot AS INTEGER) AS slot, round(list_dot_product(v, c), 9) AS bias FROM anchors CROSS JOIN middle")
def calibrated_bias(spark, sf_dir):
    middle = vectors.collect_vector(vectors.centroid(_t(spark, sf_dir, "embeddings")))
    bias = _anchors(spark, sf_dir).prepare("bias", middle).bias
    return spark.createDataFrame([(k, round(float(b), 9)) for k, b in enumerate(bias)], "slot int, bias double")


@query(f"""WITH {_SIMS}, middle AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM ({_EACH}) GROUP BY pos)),
moved AS (SELECT slot, [p[1] - p[2] FOR p IN list_zip(v, c)] AS d FROM anchors CROSS JOIN middle), centred AS (SELECT slot, [x / sqrt(list_dot_product(d, d)) FOR x IN d] AS v FROM moved),
texts AS (SELECT vec_id, [p[1] - p[2] FOR p IN list_zip(embedding::DOUBLE[], c)] AS d FROM embeddings CROSS JOIN middle)
SELECT vec_id, CAST(slot AS INTEGER) AS slot, round(list_dot_product([x / sqrt(list_dot_product(d, d)) FOR x IN d], v), 6) AS sim FROM texts CROSS JOIN centred""")
def centred_similarity(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    middle = vectors.collect_vector(vectors.centroid(e))
    anchors = _anchors(spark, sf_dir).prepare("centred", middle)

    def run(frames):
        for frame in frames:
            sims = anchors.similarities(np.stack(frame["embedding"].to_numpy()))
            yield frame[["vec_id"]].assign(sims=list(sims))

    sims = e.select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, sims array<double>")
    return sims.select("vec_id", F.posexplode("sims").alias("slot", "sim")).withColumn("sim", F.round("sim", 6))


@query()
def embed_texts(spark, sf_dir):
    return vectors.embedded(_reviews(spark, sf_dir, text=True), vectors.ENCODERS["hashing"])


def _labelled(spark, sf_dir, width: int = 64) -> DataFrame:
    """Vectors as labels: every fifth is held back, every seventh contested, and each belongs to one of three apps."""
    e = _t(spark, sf_dir, "embeddings")
    return e.select(
        F.format_string("%09d", "vec_id").alias("id"), F.col("label").alias("slot"), F.when(F.col("vec_id") % 4 == 0, F.array(((F.col("label") + 1) % 10).cast("int"))).alias("secondary"),
        F.slice("embedding", 1, width).alias("embedding"), (F.col("vec_id") % 3).alias("app"), F.when(F.col("vec_id") % 5 == 0, "random").otherwise("stratified").alias("subset"), (F.col("vec_id") % 7 == 0).alias("ambiguous"),
    )


@query()
def grid_search(spark, sf_dir):
    middle = vectors.collect_vector(vectors.centroid(_t(spark, sf_dir, "embeddings")))
    return vectors.searched(vectors.split_labels(_labelled(spark, sf_dir))[0], _anchors(spark, sf_dir), middle)


#: Parameters of the fits that are held against SQL: smoothing, secondary weight, scoring.
_PARAMS = (8.0, 0.5, "raw")


def _verdicts_sql(name: str, width: int) -> str:
    """Whether descriptions, a fit on all training labels and one on the other apps' get each held-back label right, as CTE ``name``."""
    return f"""{name}_x AS (SELECT vec_id, label, vec_id % 3 AS app, vec_id % 5 = 0 AS held, unnest(embedding::DOUBLE[])  AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
{name}_e AS (SELECT * FROM {name}_x WHERE pos <= {width}),
{name}_d AS (SELECT label AS slot, pos, arg_min(x, vec_id) AS v FROM {name}_e GROUP BY ALL),
{name}_t AS (SELECT label AS slot, app, pos, x, 1.0::DOUBLE AS w FROM {name}_e WHERE NOT held UNION ALL SELECT (label + 1) % 10, app, pos, x, 0.5::DOUBLE FROM {name}_e WHERE NOT held AND vec_id % 4 = 0),
{name}_s AS (SELECT target, fit, slot, pos, sum(x * w) AS total, sum(w) AS evidence FROM {name}_t, (SELECT unnest([0, 1, 2]) AS target), (SELECT unnest(['same', 'unseen']) AS fit) WHERE fit = 'same' OR app <> target GROUP BY ALL),
{name}_u AS (SELECT *, sqrt(sum(total * total) OVER (PARTITION BY target, fit, slot)) AS norm FROM {name}_s),
{name}_b AS (SELECT target, fit, slot, pos, 8.0 / (evidence + 8) * v + evidence / (evidence + 8) * total / norm AS y FROM {name}_u JOIN {name}_d USING (slot, pos)),
{name}_a AS (SELECT target, fit, slot, pos, y / sqrt(sum(y * y) OVER (PARTITION BY target, fit, slot)) AS v FROM {name}_b UNION ALL SELECT target, 'written', slot, pos, v FROM {name}_d, (SELECT unnest([0, 1, 2]) AS target)),
{name}_m AS (SELECT vec_id, label, app, fit, slot, sum(x * v) AS sim FROM {name}_e JOIN {name}_a USING (pos) WHERE held AND target = app GROUP BY ALL),
{name}_h AS (SELECT vec_id, app, fit, arg_max(slot, (sim, slot)) = any_value(label) AS hit FROM {name}_m GROUP BY ALL),
{name} AS (SELECT app, printf('%09d', vec_id) AS id, vec_id % 7 = 0 AS contested, bool_or(hit) FILTER (fit = 'written') AS written, bool_or(hit) FILTER (fit = 'same') AS same, bool_or(hit) FILTER (fit = 'unseen') AS unseen FROM {name}_h GROUP BY ALL)"""


_P_SQL = """round(CASE WHEN gained + lost > 0 THEN least(1, 2 * (SELECT sum(exp(lgamma(gained + lost + 1) - lgamma(k + 1) - lgamma(gained + lost - k + 1) + (gained + lost) * ln(0.5)))
FROM range(0, 100000) t(k) WHERE k <= least(gained, lost))) END, 9) AS p"""


def _verdicts(spark, sf_dir, width: int = 64) -> DataFrame:
    rows = _labelled(spark, sf_dir, width)
    base = _anchors(spark, sf_dir)
    return vectors.transfer(rows, replace(base, vectors=base.vectors[:, :width]), "app", params=_PARAMS)


@query(f"WITH {_verdicts_sql('v', 64)} SELECT * FROM v")
def leave_one_out(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(f"""WITH {_verdicts_sql('v', 64)}, c AS (SELECT app, count(*) AS n, count(*) FILTER (written) AS written, count(*) FILTER (same) AS same, count(*) FILTER (unseen) AS unseen,
count(*) FILTER (NOT written AND unseen) AS gained, count(*) FILTER (written AND NOT unseen) AS lost FROM v WHERE NOT contested GROUP BY ROLLUP (app))
SELECT *, {_P_SQL} FROM c""")
def transfer_table(spark, sf_dir):
    """The transfer table over the labels that are not contested; a null app is all apps."""
    return _round(vectors.transfer_table(_verdicts(spark, sf_dir), contested=False), "p")


@query(f"""WITH {_verdicts_sql('v', 64)}, {_verdicts_sql('h', 24)}, c AS (SELECT v.app, count(*) AS n, count(*) FILTER (v.unseen) AS first, count(*) FILTER (h.unseen) AS second,
count(*) FILTER (NOT v.unseen AND h.unseen) AS gained, count(*) FILTER (v.unseen AND NOT h.unseen) AS lost FROM v JOIN h ON v.id = h.id GROUP BY ROLLUP (v.app))
SELECT *, {_P_SQL} FROM c""")
def encoder_comparison(spark, sf_dir):
    """Whole vectors against an encoder that gives their first 24 values, both on the same labels held back."""
    return _round(vectors.compare_encoders(_verdicts(spark, sf_dir), _verdicts(spark, sf_dir, 24)), "p")


@query()
def report_page(spark, sf_dir):
    """The page over the three apps with most reviews, as one row."""
    from lensmill import report

    columns = [*_REVIEW_COLUMNS, "author_steamid"]
    whole = reviews.with_defaults(reviews.latest_by_id(_t(spark, sf_dir, "capture"), columns))
    apps = [r[0] for r in whole.groupBy("appid").count().orderBy(F.desc("count"), "appid").limit(3).collect()]
    page = report.render(report.build(whole, _assigned(spark, sf_dir), apps, covered=rates.coverage(whole, _t(spark, sf_dir, "crawl"))))
    return spark.createDataFrame([(len(apps), page)], "apps int, html string")
