"""Helpers every operator shares: lineage cuts, checked broadcasts, salted joins."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a side may have to be broadcast; at 64 bytes a row this is about 6 MB.
BROADCAST_ROWS = 100_000
#: Copies a joined-in row gets when a join is salted.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where that is unset, a local one on a single machine; on a cluster an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + os.path.join(tempfile.gettempdir(), "lensmill-checkpoints")
        spark.conf.set("spark.checkpoint.dir", known)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows, found without counting past them."""
    return df.limit(rows + 1).count() <= rows


def checked_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``small`` only when it has at most ``rows`` rows.

    Beyond the bound the join is salted: ``small`` is repeated ``SALTS`` times, so that a key that
    holds a third of ``big`` is spread over ``SALTS`` tasks. ``small`` must be unique in ``on``;
    ``how`` is one of ``left``, ``inner``, ``left_semi`` and ``left_anti``.
    """
    if at_most(small, rows):
        return big.join(F.broadcast(small), list(on), how)
    salt = "__salt"
    # by the row itself: a task that is run again gives every row the same salt
    plain = [f.name for f in big.schema.fields if isinstance(f.dataType, T.AtomicType)]
    spread = big.withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [*on, salt], how).drop(salt)


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with their place from 0 in the order of a unique column, without bringing them into one task.

    Rows are range partitioned and sorted; only the number of rows of each partition goes to the
    driver. The sorted rows are cut, so that places and counts come from the same partitions.
    """
    spark = rows.sparkSession
    ranged = cut(rows.repartitionByRange(partitions(spark), order).sortWithinPartitions(order))
    placed = ranged.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__i"))
    counts = sorted((r[0], r[1]) for r in placed.groupBy("__p").agg(F.count("*")).collect())
    before, total = {}, 0
    for p, n in counts:
        before[p], total = total, total + n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__p")) if before else F.lit(0)
    return placed.withColumn(name, F.col("__i") + offset).drop("__p", "__i")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over enough tasks for work that is heavy per row.

    A scan of a few files gives fewer tasks than there are cores; such an input is small and is
    dealt out at random. A large scan, or whatever has been shuffled already, is left as it is, so
    no large table moves.
    """
    execution = rows._jdf.queryExecution()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in execution.executedPlan().toString() or execution.toRdd().getNumPartitions() >= 2 * cores:
        return rows
    return rows.repartition(3 * cores, F.rand(11))


def _file_system(path: str):
    """Hadoop's file system and path of a URI, by the session that is there."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs a Spark session")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(path: str | os.PathLike, text: str) -> None:
    """Write a small file aside and rename it, so that a reader never sees half of it; on this machine, or anywhere by URI."""
    path = os.fspath(path)
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/.{name}.part" if folder else f".{name}.part"
    if "://" in path:
        fs, final = _file_system(path)
        _, part = _file_system(aside)
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(final, False)
        if not fs.rename(part, final):
            raise OSError(f"{path} could not be written")
        return
    os.makedirs(folder or ".", exist_ok=True)
    with open(aside, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(aside, path)


def read_text(path: str | os.PathLike) -> str:
    path = os.fspath(path)
    if "://" not in path:
        with open(path, encoding="utf-8") as f:
            return f.read()
    fs, where = _file_system(path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def exists(path: str | os.PathLike) -> bool:
    path = os.fspath(path)
    if "://" not in path:
        return os.path.exists(path)
    fs, where = _file_system(path)
    return fs.exists(where)


def sizes_below(path: str | os.PathLike) -> dict[str, int]:
    """Bytes of every file below a folder, by its path within it; none if the folder is not there."""
    path = os.fspath(path).rstrip("/")
    if "://" not in path:
        return {os.path.relpath(os.path.join(at, f), path): os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(path) for f in names}
    fs, where = _file_system(path)
    out: dict[str, int] = {}
    if fs.exists(where):
        whole, files = fs.makeQualified(where).toString().rstrip("/"), fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            out[f.getPath().toString()[len(whole) + 1 :]] = f.getLen()
    return out
