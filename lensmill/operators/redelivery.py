"""Keeping one copy of messages that were delivered at least once.

Identifiers are brought together by hash shard, once. Within a shard they are read in time order,
with one Bloom filter per time bucket: an identifier that no filter knows is definitely new and
needs no lookup. Only the possible repeats are verified, against the shard's stored identifiers of
just the buckets whose filters matched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.arrays import hash_spans
from lensmill.bloom import Bloom, screened_join, split
from lensmill.operators.commits import Commits
from lensmill.shared import cut, partitions

#: Width of a time bucket in seconds.
BUCKET_SECONDS = 90 * 86_400
#: Identifiers of a shard, about: a task holds one shard at a time. And shards a shuffle partition holds at least.
SHARD_IDS, SHARDS_PER_PARTITION = 500_000, 4
#: Bits an identifier has in the stored filters, and probes: so few foreign ones pass that a batch asks for few buckets.
STORED_BITS, STORED_PROBES = 24, 10
#: Identifiers of one stored filter at most.
FILTER_IDS = 1 << 16


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse equal (id, bucket) rows inside each batch, so that a hot identifier is not shuffled row by row."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        yield from table.group_by(["id", "bucket"]).aggregate([("n", "sum")]).rename_columns(["id", "bucket", "n"]).combine_chunks().to_batches()


def _hashes(ids: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings of an array without nulls."""
    ids = ids.cast(pa.large_string())
    offsets = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
    data = np.frombuffer(ids.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return hash_spans(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def repeats_of_shard(ids: pa.Array, buckets: np.ndarray, n: np.ndarray) -> pa.Table:
    """``id, copies`` of the identifiers of one shard, in bucket order, that have more than one row.

    The filters of older buckets screen each bucket; what they may know is looked up in those
    buckets only, by hash, and told apart by the identifiers themselves.
    """
    hashes = _hashes(ids)
    suspect = n > 1
    bounds = np.append(np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]), len(buckets)) if len(buckets) else np.zeros(1, dtype=np.int64)
    older: list[tuple[int, int, Bloom]] = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        fresh, inverse, counts = np.unique(hashes[lo:hi], return_inverse=True, return_counts=True)
        again = counts > 1
        for a, b, known in older:
            maybe = known.might_contain(fresh)
            if maybe.any():
                found = np.isin(hashes[a:b], fresh[maybe])
                suspect[a:b] |= found
                again |= maybe & np.isin(fresh, hashes[a:b][found])
        suspect[lo:hi] |= again[inverse]
        older.append((lo, hi, Bloom.of(fresh)))
    at = pa.array(np.flatnonzero(suspect))
    counted = pa.table({"id": ids.take(at), "n": n[suspect]}).group_by("id").aggregate([("n", "sum")])
    return counted.filter(pa.compute.greater(counted["n_sum"], 1)).select(["id", "n_sum"]).rename_columns(["id", "copies"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``repeats_of_shard`` for each shard of a partition that is sorted by shard and bucket."""
    held: list[pa.RecordBatch] = []
    shard = None

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            n = table["n"].to_numpy().astype(np.int64)
            yield from repeats_of_shard(table["id"].combine_chunks(), table["bucket"].to_numpy(), n).combine_chunks().to_batches()
            held.clear()

    for batch in batches:
        shards = batch["shard"].to_numpy()
        bounds = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi > lo:
                if shards[lo] != shard:
                    yield from done()
                    shard = shards[lo]
                held.append(batch.slice(lo, hi - lo))
    yield from done()


def sharded(rows: DataFrame, key: str, time: str, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The stored identifiers, ``id, bucket, n, shard``, brought together by hash shard and sorted by shard and bucket.

    A null time falls into bucket -1. Rows with a null identifier are no messages and are left out.
    """
    count = partitions(rows.sparkSession)
    shards = max(count * SHARDS_PER_PARTITION, -(-rows.count() // SHARD_IDS))
    keyed = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.coalesce(F.floor(F.col(time) / bucket_seconds), F.lit(-1)).cast("int").alias("bucket"), F.lit(1).alias("n")
    )
    shard = F.pmod(F.xxhash64("id"), F.lit(shards))
    combined = keyed.mapInArrow(_combine, "id string, bucket int, n bigint").repartition(count, shard)
    return combined.withColumn("shard", shard.cast("int")).sortWithinPartitions("shard", "bucket")


def repeated_ids(rows: DataFrame, key: str, time: str, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``id, copies`` of every identifier with more than one row; exact.

    All rows of an identifier lie in one shard, so one shuffle of identifiers does; a task holds the
    identifiers of one shard, whose number follows from the number of rows.
    """
    return sharded(rows, key, time, bucket_seconds).mapInArrow(_repeats, "id string, copies bigint")


def exactly_once(rows: DataFrame, key: str, time: str, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One copy of each message with all its columns: the earliest by ``time``, ties by the row's hash.

    Messages proven new pass without a lookup and without a shuffle; only those that may be repeated
    are grouped. Rows with a null identifier cannot be told apart and all pass.
    """
    repeated = cut(repeated_ids(rows, key, time, bucket_seconds).select(F.col("id").cast(rows.schema[key].dataType).alias(key)))
    single, several = split(rows.where(F.col(key).isNotNull()), repeated, [key])
    order = F.struct(F.col(time).isNull(), F.col(time), F.xxhash64(*rows.columns))
    kept = several.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")
    return single.unionByName(kept).unionByName(rows.where(F.col(key).isNull()))


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bloom filters of identifiers that come by shard and bucket: ``shard, bucket, bits``, packed, of at most ``FILTER_IDS`` each."""
    for batch in batches:
        shards, buckets, hashes = batch["shard"].to_numpy(), batch["bucket"].to_numpy(), batch["h"].to_numpy().view(np.uint64)
        for s, b in sorted(set(zip(shards.tolist(), buckets.tolist()))):
            own = hashes[(shards == s) & (buckets == b)]
            for lo in range(0, len(own), FILTER_IDS):
                bits = Bloom.of(own[lo : lo + FILTER_IDS], STORED_BITS, STORED_PROBES).packed.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([b], pa.int32()), pa.array([bits], pa.binary())], names=["shard", "bucket", "bits"])


def _probe(ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Which stored buckets may know each identifier of a shard."""
    hashes = ids["h"].to_numpy().astype(np.int64).view(np.uint64)
    found = [pd.DataFrame({"id": np.zeros(0, dtype=object), "shard": np.zeros(0, dtype=np.int32), "bucket": np.zeros(0, dtype=np.int32)})]
    for bucket, own in filters.groupby("bucket")["bits"]:
        maybe = np.zeros(len(hashes), dtype=bool)
        for bits in own:
            maybe |= Bloom(len(bits) * 8, 1, STORED_PROBES, np.frombuffer(bits, dtype=np.uint8)).might_contain(hashes)
        found.append(pd.DataFrame({"id": ids["id"].to_numpy(dtype=object)[maybe], "shard": ids["shard"].to_numpy()[maybe], "bucket": np.int32(bucket)}))
    return pd.concat(found)


class Deliveries:
    """Takes in batches of messages and lets each identifier through once, over all batches ever.

    Kept in one folder: identifiers in Parquet, partitioned by time bucket and shard, and their Bloom
    filters by shard and bucket. A batch reads all filters but only those (bucket, shard) partitions
    of identifiers that a filter points to. Like any run, a batch counts once its marker is there; a
    batch that failed is taken in again whole. ``shards`` is fixed when the folder is made, such that
    the identifiers of a batch fit a task when divided by it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, time: str, shards: int = 256, bucket_seconds: int = BUCKET_SECONDS):
        self.spark, self.path, self.markers = spark, path.rstrip("/"), Commits(spark, path)
        self.key, self.time, self.shards, self.bucket_seconds = key, time, shards, bucket_seconds

    def _stored(self, what: str, schema: str) -> DataFrame:
        runs = [f"{self.path}/{what}/run={c['run']}" for c in self.markers.all() if c["rows"]]
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/{what}").schema(f"{schema}, run string").parquet(*runs).drop("run")

    def matching(self, asked: list[tuple[int, int]]) -> DataFrame:
        """The stored identifiers of the given (bucket, shard) partitions; no other partition is read."""
        stored = self._stored("ids", "id string, bucket int, shard int")
        shards: dict[int, list[int]] = {}
        for bucket, shard in asked:
            shards.setdefault(bucket, []).append(shard)
        wanted = F.lit(False)
        for bucket, own in shards.items():
            wanted = wanted | ((F.col("bucket") == bucket) & F.col("shard").isin(own))
        return stored.where(wanted)

    def accept(self, batch: DataFrame) -> DataFrame:
        """The messages of ``batch`` whose identifier is new, one copy each; they are known from now on."""
        first = exactly_once(batch.where(F.col(self.key).isNotNull()), self.key, self.time, self.bucket_seconds)
        bucket = F.coalesce(F.floor(F.col(self.time) / self.bucket_seconds), F.lit(-1)).cast("int")
        h = F.xxhash64(F.col(self.key).cast("string"))
        ids = cut(first.select(F.col(self.key).alias("key"), F.col(self.key).cast("string").alias("id"), h.alias("h"), bucket.alias("bucket"), F.pmod(h, F.lit(self.shards)).cast("int").alias("shard")))
        filters = self._stored("filters", "shard int, bucket int, bits binary")
        maybe = cut(ids.select("id", "h", "shard").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_probe, "id string, shard int, bucket int"))
        asked = [(r[0], r[1]) for r in maybe.select("bucket", "shard").distinct().collect()]  # at most shards x buckets
        known = cut(maybe.join(self.matching(asked), ["id", "bucket", "shard"], "left_semi").select("id").distinct())
        fresh = cut(ids.join(known, "id", "left_anti"))
        run = uuid.uuid4().hex
        rows = fresh.count()
        if rows:
            ordered = fresh.repartition(partitions(self.spark), "shard").sortWithinPartitions("bucket", "shard")
            ordered.select("id", "bucket", "shard").write.partitionBy("bucket", "shard").parquet(f"{self.path}/ids/run={run}")
            ordered.mapInArrow(_filters, "shard int, bucket int, bits binary").write.parquet(f"{self.path}/filters/run={run}")
        taken = ids.join(known, "id", "left_semi").select(F.col("key").alias(self.key))
        screened_join(first, cut(taken), [self.key], "left_anti").write.parquet(f"{self.path}/accepted/run={run}")
        self.markers.add({"run": run, "number": len(self.markers.all()), "rows": rows})
        return self.spark.read.schema(batch.schema).parquet(f"{self.path}/accepted/run={run}")
