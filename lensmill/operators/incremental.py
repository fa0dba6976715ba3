"""Taking in only records that are new or changed since the last successful run.

The last run leaves, per partition of the source (an app), a mark (the greatest version taken in)
and a run end. A run may have overlapped with transactions (crawls) that were still open, so rows
can appear behind the mark later. A top-up therefore rereads from the oldest transaction that was
open at the last run's end, and removes the overlap by an anti-join of (key, version) pairs with
the ledger of what has been processed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.bloom import screened_join
from lensmill.operators.commits import Commits
from lensmill.shared import checked_join, cut

_KEY = ["__part", "__key", "__version"]


def last_runs(watermark: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """Per app: ``app_id, mark, run_end, low_water``.

    ``mark`` is the greatest ``max_created`` above 0 (null: no mark), ``run_end`` the greatest
    ``updated_unix``. ``low_water`` is where rereading starts: the start of the oldest transaction
    that began by the run's end and had not finished by then, else just after the run's end. Rows
    with a null ``app_id`` are ignored; an app without a row here has no mark at all.
    """
    runs = (
        watermark.where("app_id is not null")
        .groupBy("app_id")
        .agg(F.max(F.when(F.col("max_created") > 0, F.col("max_created"))).alias("mark"), F.max("updated_unix").alias("run_end"))
    )
    if transactions is None:
        return runs.withColumn("low_water", F.col("run_end") + 1)
    began = transactions.where("app_id is not null and snapshot_unix is not null").select("app_id", "snapshot_unix", "finished_unix")
    oldest = (
        began.join(runs.select("app_id", "run_end"), "app_id")
        .where("snapshot_unix <= run_end and (finished_unix is null or finished_unix > run_end)")
        .groupBy("app_id")
        .agg(F.min("snapshot_unix").alias("__open"))
    )
    return runs.join(oldest, "app_id", "left").withColumn("low_water", F.coalesce("__open", F.col("run_end") + 1)).drop("__open")


def _versioned(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` with ``__part, __key, __mark, __end, __low`` and ``__version``: the row's own version if above the mark, else the mark."""
    marks = runs.select(F.col("app_id").alias("appid"), F.col("mark").alias("__mark"), F.col("run_end").alias("__end"), F.col("low_water").alias("__low"))
    with_marks = checked_join(rows, marks, ["appid"])
    return with_marks.select(
        "*",
        F.col("appid").alias("__part"),
        F.col("recommendationid").alias("__key"),
        F.greatest("__mark", "timestamp_created", "timestamp_updated").alias("__version"),
    )


def ledger_of_past_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The (key, version) pairs that the last run must have processed, for a source without a stored ledger.

    What was delivered by the run's end is processed up to the mark, so its version is the mark.
    """
    return _processed(_versioned(rows.select("appid", "recommendationid", "timestamp_created", "timestamp_updated", "snapshot_unix"), runs))


def _processed(seen: DataFrame) -> DataFrame:
    by_then = seen.where("__mark is not null and snapshot_unix <= __end")
    return by_then.select("__part", "__key", F.col("__mark").alias("__version")).distinct()


#: The part of the source that a top-up reads again: apps without a mark or without a run's end whole,
#: else whatever lies above the mark or was delivered since the oldest open transaction began.
_REREAD = "__mark is null or __low is null or __version > __mark or snapshot_unix >= __low or snapshot_unix is null"


def _without(pairs: DataFrame, ledger: DataFrame) -> DataFrame:
    """``pairs`` whose (key, version) is not in the ledger, nor older than what it has of the key; a null app or id matches itself."""
    done = ledger.select(*[F.col(k).alias(f"{k}_done") for k in _KEY])
    same = [F.col(k).eqNullSafe(F.col(f"{k}_done")) for k in _KEY[:2]]
    return pairs.join(done, [*same, F.col("__version") <= F.col("__version_done")], "left_anti")


def pending_keys(rows: DataFrame, runs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``appid, recommendationid`` of every review with a pending version, once each.

    ``ledger`` has ``__part, __key, __version``. Without one it is derived from the source (see
    ``ledger_of_past_runs``): all its pairs of a key have the mark as their version, so the anti-join
    of pairs is done in the one aggregation that brings the pairs of a key together, and the source
    is read once: a key is pending if a version read again lies above the mark, or if the ledger side
    has no pair of it. Null times are not above a mark; a null ``snapshot_unix`` never counts as
    delivered before the run's end; rows with a null id or app are kept under that null and come out once.
    """
    keys = rows.select("appid", "recommendationid", "timestamp_created", "timestamp_updated", "snapshot_unix")
    seen = _versioned(keys, runs)
    if ledger is not None:
        return _without(seen.where(_REREAD).select("appid", "recommendationid", *_KEY).distinct(), ledger).select("appid", "recommendationid").distinct()
    again, done = F.coalesce(F.expr(_REREAD), F.lit(False)), F.coalesce(F.expr("__mark is not null and snapshot_unix <= __end"), F.lit(False))
    met = seen.where(again | done).groupBy("appid", "recommendationid").agg(
        F.max(again).alias("again"), F.max(again & F.coalesce(F.expr("__mark is null or __version > __mark"), F.lit(False))).alias("above"), F.max(done).alias("done")
    )
    return met.where("above or (again and not done)").select("appid", "recommendationid")


def pending_reviews(rows: DataFrame, runs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The pending reviews themselves, each once: its latest copy by update time, then snapshot, with all columns.

    Only rows that may be pending, by a filter over the pending keys, are shuffled whole.
    """
    order = F.struct(F.coalesce("timestamp_updated", "timestamp_created", F.lit(0)), F.coalesce("snapshot_unix", F.lit(0)), F.hash(*rows.columns))
    wanted = screened_join(rows, cut(pending_keys(rows, runs, ledger)), ["appid", "recommendationid"])
    return wanted.groupBy("appid", "recommendationid").agg(F.max_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")


def vanished(rows: DataFrame, full_crawls: DataFrame) -> DataFrame:
    """``appid, recommendationid, last_seen`` of reviews that the newest finished full crawl of their app no longer delivered.

    ``full_crawls`` has ``app_id, snapshot_unix, finished_unix`` of crawls that asked for everything; a
    top-up says nothing about what is gone. Reviews first seen later than that crawl are not gone.
    """
    newest = full_crawls.where("finished_unix is not null").groupBy(F.col("app_id").alias("appid")).agg(F.max("snapshot_unix").alias("__full"))
    seen = rows.where("recommendationid is not null").groupBy("appid", "recommendationid").agg(F.max("snapshot_unix").alias("last_seen"))
    return checked_join(seen, newest, ["appid"], "inner").where("last_seen < __full").drop("__full")


class TopUp:
    """Exactly-once incremental runs over a growing source, kept in one folder.

    A run writes its output under a new run id, its ledger entries from what it wrote, and only then
    a commit marker of a few bytes. Runs without a marker count as never made: a run that failed is
    repeated whole, and nothing it wrote is read. A committed (key, version) pair is never given out
    again, nor is a version older than the key's newest one. Every ``compact_every`` runs the ledger
    is written anew with one pair a key. A transaction that never finishes keeps the rereading where
    it began (the ledger removes the overlap) unless it has been open for longer than ``open_for``.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 16, open_for: int | None = None):
        self.spark, self.path, self.markers = spark, path.rstrip("/"), Commits(spark, path)
        self.compact_every, self.open_for = compact_every, open_for

    def commits(self) -> list[dict]:
        return self.markers.all()

    def ledger(self) -> DataFrame:
        """Pairs of committed runs: ``__part, __key, __version``, the newest of each key since the last compaction and all since."""
        done = self.commits()
        bases = [c["run"] for c in done if c.get("base")]
        since = done[[c["run"] for c in done].index(bases[-1]) + 1 :] if bases else done
        paths = [f"{self.path}/ledger-base/run={r}" for r in bases[-1:]] + [f"{self.path}/ledger/run={c['run']}" for c in since]
        schema = "__part bigint, __key string, __version bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def low_water(self) -> int | None:
        """Oldest transaction open at the last committed run; rows before it need no rereading."""
        done = self.commits()
        return done[-1]["low_water"] if done else None

    def run(self, rows: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
        """Take in what is pending in ``rows``, commit it and return it: one row per pending review."""
        done = self.commits()
        version = F.greatest(F.coalesce("timestamp_created", F.lit(0)), F.coalesce("timestamp_updated", F.lit(0))).cast("bigint")
        keys = (F.col("appid").cast("bigint").alias("__part"), F.col("recommendationid").alias("__key"), version.alias("__version"))
        source = rows if not done else rows.where((F.col("snapshot_unix") >= done[-1]["low_water"]) | F.col("snapshot_unix").isNull())
        fresh = _without(source.select("*", *keys), self.ledger())
        order = F.struct("__version", F.coalesce("snapshot_unix", F.lit(0)), F.hash(*rows.columns))
        latest = fresh.groupBy("__part", "__key").agg(F.max_by(F.struct(*rows.columns), order).alias("__row"))
        run = uuid.uuid4().hex
        latest.select("__row.*").write.parquet(f"{self.path}/output/run={run}")
        # the source is evaluated once: the ledger is made from what was written
        taken = self.spark.read.schema(rows.schema).parquet(f"{self.path}/output/run={run}")
        taken.select(*keys).write.parquet(f"{self.path}/ledger/run={run}")
        base = len(done) % self.compact_every == self.compact_every - 1
        if base:
            whole = self.ledger().unionByName(taken.select(*keys))
            whole.groupBy("__part", "__key").agg(F.max("__version").alias("__version")).write.parquet(f"{self.path}/ledger-base/run={run}")
        end = rows.agg(F.max("snapshot_unix")).first()[0] or 0
        low = end
        if transactions is not None:
            open_ = F.col("finished_unix").isNull() if self.open_for is None else F.col("finished_unix").isNull() & (F.col("snapshot_unix") >= end - self.open_for)
            low = transactions.where(open_ | (F.col("finished_unix") > end)).agg(F.min("snapshot_unix")).first()[0]
            low = end if low is None else min(low, end)
        self._commit({"run": run, "number": len(done), "low_water": low, "base": base})
        return taken

    def _commit(self, what: dict) -> None:
        self.markers.add(what)
