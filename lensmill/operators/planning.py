"""Planning a crawl: windows of bounded size, and checks of what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensmill.shared import checked_join

#: Reviews a window aims at, the shortest span that is still halved, the first second worth asking for.
TARGET, LEAST_SPAN, EPOCH = 40_000, 86_400, 1_356_998_400


def histogram(reviews: DataFrame, time: str = "timestamp_created") -> DataFrame:
    """Rows by second of creation, the input of a plan: ``appid, at, n``."""
    return reviews.where(F.col(time).isNotNull()).groupBy("appid", F.col(time).alias("at")).agg(F.count("*").alias("n"))


def split_windows(start: int, end: int, count, target: int = TARGET, least_span: int = LEAST_SPAN) -> list[tuple[int, int, int]]:
    """Closed windows that cover [start, end] and hold at most ``target`` each, as far as halving can.

    ``count(a, b)`` tells how many reviews a window holds. Empty windows are dropped; a window of
    more than ``target`` is halved into [a, middle] and [middle + 1, b] while it spans more than
    ``least_span`` seconds.

    >>> split_windows(0, 10, lambda a, b: b - a + 1, 6, 1)
    [(0, 5, 6), (6, 10, 5)]
    """
    out, todo = [], [(start, end)]
    while todo:
        a, b = todo.pop()
        n = count(a, b) if a <= b else 0
        if not n:
            continue
        if n > target and b - a > least_span:
            middle = a + (b - a) // 2
            todo += [(middle + 1, b), (a, middle)]
        else:
            out.append((a, b, n))
    return out


def shard_plan(reviews: DataFrame, start: Column, end: Column, target: int = TARGET, least_span: int = LEAST_SPAN, time: str = "timestamp_created") -> DataFrame:
    """``appid, start_date, end_date, expected``: the windows of every app at once.

    Where halving leads is known beforehand: every second has one window a level, down to those that
    are not halved any more. Seconds are first added up to these smallest windows, of which an app has
    a bounded number, and these to the windows of all levels. A window is in the plan if it need not
    or cannot be halved and its parent had to be. Two aggregations do, whatever an app holds.
    """
    rows = histogram(reviews, time)
    bounds = rows.groupBy("appid").agg(start.alias("a"), end.alias("b"))
    inside = checked_join(rows, bounds, ["appid"], "inner").where("at >= a and at <= b")

    def halved(path: Column, _: Column) -> Column:
        last = F.element_at(path, -1)
        a, b = last["a"], last["b"]
        middle = a + F.floor((b - a) / 2).cast("bigint")
        low = F.col("at") <= middle
        below = F.struct(F.when(low, a).otherwise(middle + 1).alias("a"), F.when(low, middle).otherwise(b).alias("b"))
        return F.when(b - a > least_span, F.concat(path, F.array(below))).otherwise(path)

    levels = F.greatest(F.lit(1), F.ceil(F.log2((F.col("b") - F.col("a") + 1) / float(least_span))) + 1).cast("int")
    path = F.aggregate(F.sequence(F.lit(1), levels), F.array(F.struct("a", "b")), halved)
    smallest = inside.withColumn("path", path).groupBy("appid", "path").agg(F.sum("n").alias("n"))
    level = smallest.select("appid", "path", "n", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k"))
    own, above = F.element_at("path", F.col("k")), F.try_element_at("path", F.when(F.col("k") > 1, F.col("k") - 1))
    held = level.groupBy("appid", own["a"].alias("start_date"), own["b"].alias("end_date"), above["a"].alias("pa"), above["b"].alias("pb")).agg(F.sum("n").alias("expected"), F.max(F.col("k") == F.size("path")).alias("smallest"))
    parents = held.select("appid", F.col("start_date").alias("pa"), F.col("end_date").alias("pb"), F.col("expected").alias("parent"))
    final = held.join(parents, ["appid", "pa", "pb"], "left").where((F.col("expected") <= target) | F.col("smallest"))
    return final.where(F.col("pa").isNull() | (F.col("parent") > target)).select("appid", "start_date", "end_date", "expected")


def disjoint(plan: DataFrame) -> DataFrame:
    """Per app its number of windows, their total and whether none overlaps the next."""
    order = Window.partitionBy("appid").orderBy("start_date", "end_date")
    after = plan.withColumn("next", F.lead("start_date").over(order))
    return after.groupBy("appid").agg(F.count("*").alias("windows"), F.sum("expected").alias("expected"), F.bool_and(F.coalesce(F.col("next") > F.col("end_date"), F.lit(True))).alias("disjoint"))


def fell_short(rows: Column, expected: Column) -> Column:
    """Whether a window came back with suspiciously little: over 20 and over 5 % missing; never if nothing was expected."""
    return (expected > 0) & (expected - rows > 20) & (rows < expected * 0.95)


def crawl_tally(shards: DataFrame) -> DataFrame:
    """Rows and pages of the windows of each crawl that are done, rows before duplicates between windows are dropped, and those that came back short."""
    return shards.groupBy("crawl_id").agg(
        F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("row_count"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("pages"))), F.lit(0)).alias("pages"),
        F.count_if(fell_short(F.coalesce("row_count", F.lit(0)), F.col("expected")) & (F.col("status") == "done")).alias("short"),
    )


def topup_start(watermark: int | None) -> int:
    """First second a top-up asks for."""
    return watermark + 1 if watermark else EPOCH


def unfinished(crawls: DataFrame) -> DataFrame:
    """Per app its latest crawl that has no end."""
    return crawls.where("finished_unix is null").groupBy("app_id").agg(F.max("id").alias("id"))


def unfinished_progress(crawls: DataFrame, shards: DataFrame) -> DataFrame:
    """``unfinished`` with the windows of each such crawl that are ``done`` and its ``total``."""
    counts = shards.groupBy(F.col("crawl_id").alias("id")).agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"))
    return unfinished(crawls).join(counts, "id", "left").na.fill(0, ["done", "total"]).select("app_id", "id", "done", "total")


def watermarks(crawls: DataFrame, old: DataFrame) -> DataFrame:
    """Per app the greatest mark above 0."""
    return old.where("max_created > 0").groupBy("app_id").agg(F.max("max_created").alias("max_created"))


class CrawlState:
    """Crawls, their shards and watermarks as small Parquet tables that are rewritten whole, each version under its own name."""

    def __init__(self, spark: SparkSession, path: str):
        from lensmill.schema import CRAWL, SHARD, WATERMARK

        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = {"crawl": CRAWL, "shard": SHARD, "watermark": WATERMARK}

    def _versions(self, table: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self, table: str) -> DataFrame:
        have = self._versions(table)
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self.path}/{table}/{have[-1]}") if have else self.spark.createDataFrame([], self.schemas[table])

    def _write(self, table: str, rows: DataFrame) -> None:
        have = self._versions(table)
        number = int(have[-1][1:]) + 1 if have else 0
        rows.select(*self.read(table).columns).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{table}/v{number:08d}")

    def start_crawl(self, app_id: int, snapshot: int, url: str, total: int) -> int:
        crawls = self.read("crawl")
        new = (crawls.agg(F.max("id")).first()[0] or 0) + 1
        self._write("crawl", crawls.unionByName(self.spark.createDataFrame([(new, app_id, snapshot, url, total, None)], self.schemas["crawl"])))
        return new

    def put_shards(self, crawl_id: int, windows: list[tuple[int, int, int]]) -> None:
        """Insert or replace the windows of a crawl, all pending."""
        rows = [(crawl_id, i, a, b, n, "pending", None, None, None, None) for i, (a, b, n) in enumerate(windows)]
        fresh = self.spark.createDataFrame(rows, self.schemas["shard"])
        old = self.read("shard")
        self._write("shard", old.join(fresh.select("crawl_id", "idx"), ["crawl_id", "idx"], "left_anti").unionByName(fresh))

    def shards(self, crawl_id: int) -> list:
        """All windows of a crawl in order."""
        return self.read("shard").where(F.col("crawl_id") == crawl_id).orderBy("idx").collect()

    def pending(self, crawl_id: int) -> DataFrame:
        """Windows not done, the fullest first; what was running when a run died is pending again."""
        mine = self.read("shard").where((F.col("crawl_id") == crawl_id) & (F.col("status") != "done"))
        return mine.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status"))).orderBy(F.desc("expected"), "idx")

    def mark(self, crawl_id: int, idx: int, status: str, rows: int | None = None, pages: int | None = None, stop: str | None = None, max_created: int | None = None) -> None:
        self.mark_all(crawl_id, [(idx, status, rows, pages, stop, max_created)])

    def mark_all(self, crawl_id: int, marks: list[tuple]) -> None:
        """Set ``status, row_count, pages, stop_reason, max_created`` of windows by their number, in one write."""
        new = self.spark.createDataFrame(marks, "idx bigint, __status string, __row_count bigint, __pages bigint, __stop_reason string, __max_created bigint").withColumn("crawl_id", F.lit(crawl_id).cast("bigint"))
        old = self.read("shard").join(F.broadcast(new), ["crawl_id", "idx"], "left")
        hit = F.col("__status").isNotNull()
        self._write("shard", old.withColumns({k: F.when(hit, F.col(f"__{k}")).otherwise(F.col(k)) for k in ("status", "row_count", "pages", "stop_reason", "max_created")}))

    def progress(self, crawl_id: int) -> tuple[int, int]:
        """Windows done and in all."""
        r = self.read("shard").where(F.col("crawl_id") == crawl_id).agg(F.count_if(F.col("status") == "done"), F.count("*")).first()
        return r[0], r[1]

    def all_done(self, crawl_id: int) -> bool:
        done, total = self.progress(crawl_id)
        return done == total

    def finish(self, app_id: int, crawl_id: int, now: int) -> None:
        """End a crawl and advance its app's watermark, which never falls; only once every window is done."""
        if not self.all_done(crawl_id):
            raise RuntimeError("a crawl with open windows cannot be finished")
        reached = self.read("shard").where(F.col("crawl_id") == crawl_id).agg(F.coalesce(F.max("max_created"), F.lit(0))).first()[0]
        marks = self.read("watermark")
        old = marks.where(F.col("app_id") == app_id).agg(F.coalesce(F.max("max_created"), F.lit(0))).first()[0]
        new = self.spark.createDataFrame([(app_id, max(reached, old), now)], self.schemas["watermark"])
        self._write("watermark", marks.where(F.col("app_id") != app_id).unionByName(new))
        crawls = self.read("crawl")
        self._write("crawl", crawls.withColumn("finished_unix", F.when(F.col("id") == crawl_id, F.lit(now).cast("bigint")).otherwise(F.col("finished_unix"))))

    def watermark(self, app_id: int) -> int | None:
        r = self.read("watermark").where((F.col("app_id") == app_id) & (F.col("max_created") > 0)).agg(F.max("max_created")).first()
        return r[0]
