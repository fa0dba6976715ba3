"""Drawing a sample with given category shares, and saying where they could not be met.

Items are tilted exponentially until the expected count of every category is its target: Newton's
method on the dual, over category moments that Spark aggregates. The sample is then drawn with the
resulting probabilities by the pivotal method; floors are fixed up and gaps reported.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensmill.shared import checked_join, cut

#: Units that one task runs the pivotal method over.
CHUNK_UNITS = 50_000
#: Newton steps; convergence is quadratic once near.
NEWTON_STEPS = 100


def normal_category(column: Column | str) -> Column:
    """Without outer white space (by Unicode) and in lower case; null stays null, blank becomes ''."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def pool_items(pool: DataFrame) -> DataFrame:
    """``app_id, id, category``, distinct, of the rows that have an id, an app and a non-blank review."""
    filled = pool.where("app_id is not null and id is not null").where(F.col("review").rlike(r"(?U)\S"))
    return filled.select("app_id", F.col("id").cast("string").alias("id"), normal_category("predicted").alias("category")).where("category is not null").distinct()


def cell_report(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """``cell_counts`` of a raw pool."""
    return cell_counts(pool_items(pool), targets)


def cell_counts(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row of ``targets`` with ``wanted, available, reachable, gap`` of its (app, category) cell of ``items``.

    ``wanted`` is the greater of the floor and the rounded share of the sample; ``available`` counts
    distinct items. Nulls in a target count as 0; an app without a pool has nothing available.
    """
    n = F.coalesce("sample_size", F.lit(0))
    wanted = F.greatest(F.coalesce("min_rows", F.lit(0)), F.round(F.coalesce("target_share", F.lit(0.0)) * n).cast("bigint"))
    keyed = targets.select("app_id", "predicted", "target_share", "min_rows", "sample_size", normal_category("predicted").alias("category"), wanted.alias("wanted"))
    moments = items.groupBy("app_id", "category").agg(F.count("*").alias("available"))
    report = keyed.join(moments, ["app_id", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    return report.withColumn("reachable", F.least("wanted", "available")).withColumn("gap", F.col("wanted") - F.col("reachable"))


def tilt(counts: np.ndarray, member: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Inclusion probability of each pattern of categories, so that expected category counts meet ``targets``.

    ``counts[p]`` items have pattern p; ``member[p, c]`` says whether it has category c. Minimises
    the divergence from equal probabilities: probabilities are ``base * exp(member @ x)``, and x is
    found by damped Newton steps on the dual. Patterns pushed above 1 are taken whole and the rest
    is solved again; a target above what is there is met as far as it goes.

    >>> tilt(np.array([10, 40]), np.eye(2), np.array([5.0, 10.0])).round(6).tolist()
    [0.5, 0.25]
    """
    member = member.astype(float)
    taken = np.zeros(len(counts), dtype=bool)
    taken[(member[:, counts @ member <= targets] > 0).any(axis=1)] = True
    while True:
        left = targets - counts[taken] @ member[taken]
        free = ~taken & (member[:, left <= 1e-9] == 0).all(axis=1)
        p = np.where(taken, 1.0, 0.0)
        cats = np.flatnonzero((counts[free] @ member[free] > 0) & (left > 1e-9))
        if not len(cats) or not free.any():
            return p
        m, t, n = member[free][:, cats], left[cats], counts[free]
        base = min(1.0, t.sum() / max(n.sum(), 1))
        x = np.zeros(len(cats))
        for _ in range(NEWTON_STEPS):
            w = n * base * np.exp(m @ x)
            error = t - w @ m
            if np.abs(error).max() < 1e-9 * max(1.0, t.max()):
                break
            step = np.linalg.lstsq(m.T @ (w[:, None] * m), error, rcond=None)[0]
            x += step / max(1.0, np.abs(step).max())
        p[free] = base * np.exp(m @ x)
        over = free & (p > 1 + 1e-9)
        if not over.any():
            return np.minimum(p, 1.0)
        taken |= over


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One pass of the sequential pivotal method: all but at most one unit end at 0 or 1.

    Two units fight at a time: their probabilities are summed and one of them is decided, so that
    each keeps its probability and the sum never changes.
    """
    p = p.astype(float).copy()
    p[p > 1 - 1e-12] = 1.0
    open_at = np.flatnonzero((p > 1e-12) & (p < 1))
    p[(p <= 1e-12)] = 0.0
    if not len(open_at):
        return p
    draws, values = rng.random(len(open_at)).tolist(), p[open_at].tolist()
    holder, held = 0, values[0]
    for k in range(1, len(values)):
        v, both = values[k], held + values[k]
        if both < 1:  # one of the two is out
            stays = draws[k] * both < held
            out, holder = (k, holder) if stays else (holder, k)
            values[out], held = 0.0, both
        else:  # one of the two is in
            stays = draws[k] * (2 - both) < 1 - held
            into, holder = (k, holder) if stays else (holder, k)
            values[into], held = 1.0, both - 1
    values[holder] = held if 1e-9 < held < 1 - 1e-9 else float(held > 0.5)
    p[open_at] = values
    return p


def _seed(*parts: object) -> int:
    return int(pd.util.hash_array(np.array(["|".join(map(str, parts))], dtype=object))[0])


def inclusion(units: DataFrame, cells: DataFrame) -> DataFrame:
    """``app_id, pattern, p, items``: for each set of categories that units (``app_id, id, pattern``) have, their probability."""
    sums = units.groupBy("app_id", "pattern").agg(F.count("*").alias("items"))

    def solve(key: tuple, moments: pd.DataFrame, goal: pd.DataFrame) -> pd.DataFrame:
        if not len(moments):
            return pd.DataFrame({"app_id": np.zeros(0, dtype=np.int64), "pattern": np.zeros(0, dtype=object), "p": np.zeros(0), "items": np.zeros(0, dtype=np.int64)})
        moments = moments.sort_values("pattern")
        at = {c: i for i, c in enumerate(sorted(goal["category"]))}
        member = np.zeros((len(moments), len(at)))
        for i, pattern in enumerate(moments["pattern"]):
            for c in pattern.split("\x1f"):
                member[i, at[c]] = 1
        aim = goal.set_index("category")["wanted"].reindex(sorted(at)).to_numpy(dtype=float)
        moments["p"] = tilt(moments["items"].to_numpy(dtype=float), member, aim)
        moments["app_id"] = key[0]
        return moments[["app_id", "pattern", "p", "items"]]

    return sums.groupBy("app_id").cogroup(cells.groupBy("app_id")).applyInPandas(solve, "app_id bigint, pattern string, p double, items bigint")


def sampled(pool: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """``app_id, id, category`` of the sample: an item once for each of its wanted categories.

    The same rows on every run with one ``seed``. Floors are met wherever the pool allows: a cell
    that the draw left below its floor is topped up with its next items in hash order. The pool is
    read once.
    """
    return drawn_from(cut(pool_items(pool)), targets, seed)


def _place(seed: int) -> Column:
    """The place of an item in the order of a seed, as 52 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "app_id", "id"), 12)


def first_of_cells(rest: DataFrame, seed: int, chunk: int | None = None) -> DataFrame:
    """``app_id, id`` of the first ``missing`` items of each cell in the order of the seed.

    A cell's order is cut into spans that hold about ``chunk`` items each; their counts say which
    spans are taken whole and in which one the last item lies. Only that one is ranked, so no task
    sorts a cell.
    """
    chunk = chunk or CHUNK_UNITS
    cell = ["app_id", "category"]
    placed = rest.withColumn("place", _place(seed))
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / chunk).alias("spans"))
    in_span = checked_join(placed, sizes, cell, "inner").withColumn("span", F.floor(F.col("place") * F.col("spans") / float(1 << 52)))
    counts = in_span.groupBy(*cell, "span").agg(F.count("*").alias("held"), F.max("missing").alias("missing"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*cell).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.withColumn("before", before).where("before < missing").select(*cell, "span", (F.col("before") + F.col("held") <= F.col("missing")).alias("whole"), (F.col("missing") - F.col("before")).alias("left"))
    near = checked_join(in_span, reached, [*cell, "span"], "inner")
    rank = F.row_number().over(Window.partitionBy(*cell, "span").orderBy("place", "id"))
    edge = near.where(~F.col("whole")).withColumn("k", rank).where("k <= left")
    return near.where("whole").select("app_id", "id").unionByName(edge.select("app_id", "id"))


def drawn_from(pooled: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """``sampled`` of items (``pool_items``) that are read several times and should be cut."""
    cells = cell_counts(pooled, targets).groupBy("app_id", "category").agg(F.max("wanted").alias("wanted"), F.max(F.coalesce("min_rows", F.lit(0))).alias("floor"))
    cells = cut(cells)
    items = checked_join(pooled, cells.select("app_id", "category"), ["app_id", "category"], "left_semi")
    units = items.groupBy("app_id", "id").agg(F.array_join(F.array_sort(F.collect_set("category")), "\x1f").alias("pattern"))
    chances = cut(inclusion(units, cells))
    shuffled = F.xxhash64(F.lit(seed), "app_id", "id")
    live = checked_join(units, chances, ["app_id", "pattern"], "inner").withColumn("r", shuffled)
    largest = live.agg(F.count("*")).first()[0]

    def fight(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pattern", "r", "id"], kind="stable")
        frame["p"] = pivotal(frame["p"].to_numpy(), np.random.default_rng(_seed(seed, *key)))
        return frame

    # chunks of a pattern first; each leaves at most one undecided unit, and those meet per app
    schema = "app_id bigint, id string, pattern string, p double, r bigint"
    live = live.withColumn("chunk", F.pmod("r", F.ceil(F.col("items") / CHUNK_UNITS)))
    decided = cut(live.select("app_id", "id", "pattern", "p", "r", "chunk").groupBy("app_id", "pattern", "chunk").applyInPandas(lambda k, f: fight(k, f)[["app_id", "id", "pattern", "p", "r"]], schema))
    done = decided.where("p = 0 or p = 1")
    undecided = decided.where("p > 0 and p < 1")
    while largest > CHUNK_UNITS * CHUNK_UNITS:
        undecided = cut(undecided.withColumn("chunk", F.pmod("r", F.lit(largest // CHUNK_UNITS // CHUNK_UNITS + 1))).groupBy("app_id", "chunk").applyInPandas(lambda k, f: fight(k, f)[["app_id", "id", "pattern", "p", "r"]], schema))
        done = done.unionByName(undecided.where("p = 0 or p = 1"))
        undecided = undecided.where("p > 0 and p < 1")
        largest //= CHUNK_UNITS
    last = undecided.groupBy("app_id").applyInPandas(lambda k, f: fight(k, f)[["app_id", "id", "pattern", "p", "r"]], schema)
    drawn = cut(done.unionByName(last.withColumn("p", F.round("p"))).where("p = 1").select("app_id", "id"))
    chosen = items.join(drawn, ["app_id", "id"], "left_semi")
    got = chosen.groupBy("app_id", "category").agg(F.count("*").alias("got"))
    short = cut(cells.join(got, ["app_id", "category"], "left").withColumn("missing", F.col("floor") - F.coalesce("got", F.lit(0))).where("missing > 0").select("app_id", "category", "missing"))
    rest = checked_join(items, short, ["app_id", "category"], "inner").join(drawn, ["app_id", "id"], "left_anti")
    whole = drawn.unionByName(first_of_cells(rest, seed).distinct())
    return items.join(whole, ["app_id", "id"], "left_semi")


def draw_report(pool: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """``cell_report`` with ``drawn`` and ``drawn_share`` for all target rows: the items of each cell that the sample holds, and their share of the app's.

    A cell with a gap is always drawn short, as a sample never holds more than there is; a cell
    drawn one short by rounding has no gap. The share is null for an app of which nothing was drawn.
    """
    items = cut(pool_items(pool))
    drawn = cut(drawn_from(items, targets, seed).groupBy("app_id", "category").agg(F.count("*").alias("drawn")))
    total = drawn.groupBy("app_id").agg(F.sum("drawn").alias("total"))
    report = cell_counts(items, targets).join(drawn, ["app_id", "category"], "left").join(total, "app_id", "left")
    report = report.withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint")))
    return report.withColumn("drawn_share", F.col("drawn") / F.col("total")).drop("total")
