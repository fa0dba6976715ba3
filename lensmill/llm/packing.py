"""Packing whole items into containers of a few permitted sizes with little space left over."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.shared import cut

#: Items that are packed together; the leftover space of a chunk is at most one container a size. And tasks that pack at most.
CHUNK_ITEMS, MOST_TASKS = 10_000, 20_000


class _Remaining:
    """The lengths still to be packed, as a multiset that gives its largest member up to a limit."""

    def __init__(self, lengths: np.ndarray):
        values, counts = np.unique(lengths, return_counts=True)
        self.values, self.counts = values.tolist(), counts.tolist()

    def largest(self, limit: int) -> int | None:
        """Index of the largest length of at most ``limit``; forgets lengths that are used up."""
        i = bisect.bisect_right(self.values, limit) - 1
        while i >= 0 and not self.counts[i]:
            del self.values[i], self.counts[i]
            i -= 1
        return i if i >= 0 else None

    def take(self, length: int) -> None:
        self.counts[bisect.bisect_left(self.values, length)] -= 1

    def trial(self, space: int) -> int:
        """Space that stays empty if ``space`` is filled greedily from what remains; changes nothing."""
        i = bisect.bisect_right(self.values, space) - 1
        while i >= 0 and space:
            if self.counts[i]:
                space -= min(self.counts[i], space // self.values[i]) * self.values[i]
            i = min(i - 1, bisect.bisect_right(self.values, space, 0, i) - 1)
        return space


def pack(lengths: Sequence[int], capacities: Sequence[int], cost: dict[int, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each item and capacity of each container.

    Variable-capacity best-fit on descending lengths: an item goes into the open container that it
    leaves with the least space. If none has room, every permitted size is tried on what remains and
    the one with the least cost per unit packed is opened (the larger one on a tie). In the end each
    container shrinks to the smallest size that holds its contents. ``cost`` defaults to the
    capacity. Every length must be at most the largest capacity; items of length 0 take no space and
    join the first container, which has the smallest size if there is nothing else.

    >>> bins, sizes = pack([400, 100, 12, 500], [512, 2048]); bins.tolist(), sizes.tolist()
    ([1, 1, 1, 0], [512, 512])
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    sizes = sorted(set(capacities))
    price = cost or {c: float(c) for c in sizes}
    where = np.zeros(len(lengths), dtype=np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (space left, container), ascending
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    rest = _Remaining(lengths[order])
    for item in order.tolist():
        need = int(lengths[item])
        rest.take(need)
        k = bisect.bisect_left(room, (need, -1))
        if k < len(room):
            space, container = room.pop(k)
        else:
            container = len(used)
            used.append(0)
            best = None
            for size in reversed([s for s in sizes if s >= need]):
                per_unit = price[size] / (size - rest.trial(size - need))
                if best is None or per_unit < best[0] - 1e-12:
                    best = (per_unit, size)
            if best is None:
                raise ValueError(f"an item of {need} exceeds every capacity")
            space = best[1]
        where[item] = container
        used[container] += need
        if space > need:
            bisect.insort(room, (space - need, container))
    if len(lengths) and not used:
        used.append(0)
    return where, np.array([sizes[bisect.bisect_left(sizes, u)] for u in used], dtype=np.int64)


def packed(items: DataFrame, capacities: Sequence[int], id_col: str = "doc_id", size_col: str = "n_tokens", chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """``<id_col>, piece, start, n_tokens, container, capacity``: where each item or piece of one went.

    Items are whole unless longer than the largest capacity; such an item is cut into pieces of that
    capacity and a rest (``start``: tokens before the piece). Items are spread by hash over chunks of
    about ``chunk_items``, which are packed independently, so no task grows with the input. A null
    size counts as 0. ``container`` is unique over all chunks; repeated ids are packed each.
    """
    items = cut(items.select(id_col, size_col))  # sizes may be dear to compute, and are read twice
    largest = max(capacities)
    sized = items.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    last = F.greatest(F.ceil(F.col("size") / largest) - 1, F.lit(0))
    pieces = sized.select("id", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * largest).withColumn("n_tokens", F.least(F.col("size") - F.col("start"), F.lit(largest)))
    count = max(1, -(-items.count() // chunk_items))
    # as many partitions as chunks, or tasks would hold many: pieces are so small that they would be joined
    spread = pieces.withColumn("chunk", F.pmod(F.xxhash64("id", "piece"), F.lit(count))).repartition(min(count, MOST_TASKS), "chunk")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "piece"], kind="stable")
        where, sizes = pack(frame["n_tokens"].to_numpy(), capacities)
        frame["capacity"] = sizes[where]
        frame["container"] = where * count + frame["chunk"].to_numpy()
        return frame[["id", "piece", "start", "n_tokens", "container", "capacity"]]

    kind = items.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece bigint, start bigint, n_tokens bigint, container bigint, capacity bigint"
    return spread.select("id", "piece", "start", "n_tokens", "chunk").groupBy("chunk").applyInPandas(run, schema).withColumnRenamed("id", id_col)
