"""Turning batches of strings into flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmill.arrays import mix64, powers, segment_sums  # noqa: F401  (used with these everywhere here)

#: Characters handled at once, such that arrays over them stay in a cache; a longer text is handled alone, still whole.
CHUNK_CHARS = 200_000


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``most`` characters each, or of one text."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts`` end to end, and the offset at which each text starts (plus the end)."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def hash_sample(rows: DataFrame, most: int, by: str | None = None, only: Column | None = None) -> list:
    """At most ``most`` different rows of ``rows``, by the hash of the whole row: the same on every run.

    Rows are kept by a threshold on their hash that lets about ``most`` through, and equal ones are
    merged where they are read, so neither the driver nor a task ever holds much more than that. With
    ``by`` every value of that column (there are few) gets an equal part of the sample, as far as it has rows.
    ``only`` is a condition on the rows of the sample; it does not make the count read texts.
    """
    h = F.xxhash64(*rows.columns)
    keep = lambda total, most: min(2**63 - 1, -(2**63) + 2**64 * 6 * most // (5 * max(total, most)))
    if by is None:
        kept = rows.withColumn("__h", h).where(F.col("__h") <= keep(rows.count(), most))
        kept = kept if only is None else kept.where(only)
        return kept.dropDuplicates(["__h"]).orderBy("__h").limit(most).drop("__h").collect()
    sizes = {r[0]: r[1] for r in rows.groupBy(by).count().collect() if r[0] is not None}  # narrow: only this column is read
    each = max(1, most // max(1, len(sizes)))
    limits = F.create_map(*[F.lit(x) for v, n in sizes.items() for x in (v, keep(n, 2 * each))]) if sizes else F.lit(None)
    kept = rows.where(F.col(by).isNotNull()).withColumn("__h", h).where(F.col("__h") <= limits[F.col(by)]) if sizes else rows.limit(0).withColumn("__h", h)
    # at most a few times ``most`` rows come this far
    nth = F.row_number().over(Window.partitionBy(by).orderBy("__h"))
    return kept.dropDuplicates(["__h"]).withColumn("__k", nth).where(F.col("__k") <= each).orderBy("__h").drop("__h", "__k").collect()
