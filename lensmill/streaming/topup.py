"""Top-ups as a stream: new capture files come in, each pending review goes out once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lensmill.schema import CAPTURE

_SNAPSHOT = "snapshot_unix"


def capture_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The capture files below ``path`` as they arrive; the checkpoint remembers which were read."""
    schema = T.StructType([*CAPTURE.fields, T.StructField(_SNAPSHOT, T.LongType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").parquet(path)


def newest_first(batch: DataFrame) -> DataFrame:
    """The latest copy of each review in a batch."""
    order = Window.partitionBy("recommendationid").orderBy(F.desc(F.coalesce("timestamp_updated", "timestamp_created", F.lit(0))), F.desc_nulls_last(_SNAPSHOT), F.desc(F.xxhash64(*batch.columns)))
    return batch.where("recommendationid is not null").withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def take_in(batch: DataFrame, epoch: int, table: str) -> None:
    """Write a batch's latest copies as epoch ``epoch`` of a table.

    A batch that is replayed after a failure overwrites what it wrote before, so nothing counts
    twice. Epochs are merged when read; nothing old is rewritten.
    """
    newest_first(batch).write.mode("overwrite").parquet(f"{table}/epoch={epoch:08d}")


def run_topup(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Take in everything that is there and stop; run it again to take in what came since."""
    stream = capture_stream(spark, source)
    return stream.writeStream.foreachBatch(lambda df, n: take_in(df, n, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The latest copy of each review over all epochs."""
    return newest_first(spark.read.option("basePath", table).parquet(f"{table}/epoch=*").drop("epoch"))


def once_within(stream: DataFrame, key: str, event_time: str, delay: str = "7 days") -> DataFrame:
    """Drop redeliveries that come within ``delay`` of each other, with state bounded by the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def by_month(stream: DataFrame) -> DataFrame:
    """Running counts of reviews by app and calendar month."""
    month = F.date_trunc("month", F.timestamp_seconds("timestamp_created"))
    return stream.groupBy("appid", month.alias("month")).agg(F.count("*").alias("reviews"), F.count_if("voted_up").alias("positive"))
