"""From captured JSON to one row per review: strict parsing, scans, latest copies, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.functions.text import not_blank
from lensmill.schema import CAPTURE

_MOST = 4_294_967_295
_AUTHOR = {"author_steamid": "steamid", "author_num_games_owned": "num_games_owned", "author_num_reviews": "num_reviews", "author_playtime_forever": "playtime_forever",
           "author_playtime_at_review": "playtime_at_review", "author_playtime_last_two_weeks": "playtime_last_two_weeks", "author_last_played": "last_played"}
_TIMES = ("author_last_played", "timestamp_created", "timestamp_updated")


def _strict(json: Column, name: str, kind: str) -> Column:
    """One field of a JSON object by its column name; null if it is absent or of another type.

    Counts beyond 32 bits are null. A decimal may come as a number or as a string of one.
    """
    path = f"$.author.{_AUTHOR[name]}" if name in _AUTHOR else f"$.{name}"
    value = F.try_variant_get(json, path, "variant")
    of = F.schema_of_variant(value)
    text = F.try_variant_get(json, path, "string")
    if kind == "string":
        return F.when(of == "STRING", text)
    if kind == "boolean":
        return F.when(of == "BOOLEAN", F.try_variant_get(json, path, "boolean"))
    if kind == "double":
        return F.when((of == "STRING") | (of == "BIGINT") | (of == "DOUBLE") | of.startswith("DECIMAL"), text.try_cast("double"))
    whole = F.when(of == "BIGINT", F.try_variant_get(json, path, "bigint"))
    return whole if name in _TIMES else F.when(whole.between(0, _MOST), whole)


def parsed(rows: DataFrame, json_col: str = "raw_json", appid_col: str = "appid", keep: Sequence[str] = ()) -> DataFrame:
    """Capture columns from the JSON objects in ``json_col``; the app comes from the caller, not from the JSON.

    Rows that are no JSON object or lack a string ``recommendationid`` are dropped.
    """
    json = F.try_parse_json(F.col(json_col))
    fields = [_strict(F.col("__json"), f.name, f.dataType.simpleString()).alias(f.name) for f in CAPTURE.fields if f.name not in ("appid", "raw_json")]
    read = rows.withColumn("__json", json).where(F.col("__json").isNotNull())
    out = read.select(*fields, F.col(appid_col).cast("bigint").alias("appid"), F.col(json_col).alias("raw_json"), *[F.col(k) for k in keep])
    return out.select(*CAPTURE.names, *keep).where("recommendationid is not null")


def capture_scan(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of capture shards below ``path``, by column name, null defaults applied and blank texts left out.

    Shards are what ``write_capture`` writes (``part-``) or ``shard-`` files of other writers.
    """
    files = shards_of(spark, path)
    return with_defaults(spark.read.schema(CAPTURE).parquet(*files) if files else spark.createDataFrame([], CAPTURE))


def shards_of(spark: SparkSession, path: str) -> list[str]:
    """The shard files below ``path`` in a fixed order: by name."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, walk = [], fs.listFiles(where, True)
    while walk.hasNext():
        file = walk.next().getPath()
        if file.getName().startswith(("shard-", "part-")) and file.getName().endswith(".parquet"):
            found.append(file.toString())
    return sorted(found)


def with_defaults(reviews: DataFrame) -> DataFrame:
    """Null helpfulness as 0.0, votes and times as 0, verdict as false, language as ''; blank texts (by ``filled`` where there is one) are left out."""
    zero = {"weighted_vote_score": 0.0, "votes_up": 0, "voted_up": False, "language": "", "timestamp_created": 0}
    kept = reviews.where("filled").drop("filled") if "filled" in reviews.columns else reviews.where(not_blank("review"))
    return kept.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zero.items() if c in reviews.columns})


def write_capture(reviews: DataFrame, path: str) -> None:
    """Capture shards as zstd Parquet, partitioned by app and snapshot, in row groups of 32 MB (65,536 reviews of some 500 bytes)."""
    reviews.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).partitionBy("appid", "snapshot").mode("append").parquet(path)


def latest_by_id(copies: DataFrame, columns: Sequence[str], text: bool = True) -> DataFrame:
    """One row per ``recommendationid``: the copy updated last, then of the newest snapshot, then the greatest values.

    Only the needed ``columns`` are shuffled. Texts are compared by 60 bits of their digest; without
    ``text`` the review itself stays where it is read, and ``filled`` says whether it is not blank.
    Rows with a null id are left out.
    """
    order = [F.coalesce("timestamp_updated", "timestamp_created", F.lit(0)).alias("__updated"), F.coalesce("snapshot_unix", F.lit(0)).alias("__snapshot")]
    carried = [c for c in columns if c != "recommendationid"]
    tie = F.conv(F.substring(F.md5("review"), 1, 15), 16, 10).cast("bigint").alias("__text")
    compared = [tie if c == "review" else F.col(c) for c in carried]
    behind = ([F.col("review")] if text else [not_blank("review").alias("filled")]) if "review" in carried else []
    best = copies.where("recommendationid is not null").groupBy("recommendationid").agg(F.max(F.struct(*order, *compared, *behind)).alias("__row"))
    out = [c if c != "review" or text else "filled" for c in carried]
    return best.select("recommendationid", *[F.col(f"__row.{c}").alias(c) for c in out])


def newest_snapshot(copies: DataFrame) -> DataFrame:
    """Per app its newest snapshot that holds a row: an empty or broken newer one never shadows it."""
    return copies.groupBy("appid").agg(F.max("snapshot_unix").alias("snapshot_unix"))


def semi_by_id(rows: DataFrame, ids: DataFrame, key: str = "recommendationid") -> DataFrame:
    """Rows of wanted ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")
