"""Agreement of predictions with reference labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensmill.functions.stats import mcnemar, precision_recall_f1, rate, wilson
from lensmill.schema import CATEGORIES, CATEGORY_IDS, LABELS


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from a JSON array; a directory is read as all its ``*.json`` files in name order (``source``)."""
    return spark.read.schema(LABELS).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path).withColumn("source", F.input_file_name())


def returned(drawn: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Checks of labels that came back against the sample that was sent: ids unknown, missing, duplicate, and categories unknown."""
    ids = labels.select("id")
    order = Window.partitionBy("id").orderBy(*[c for c in ("source",) if c in labels.columns] or ["id"])
    categories = labels.select(F.explode(F.array_union(F.array("primary"), F.coalesce("secondary", F.array().cast("array<string>")))).alias("category"))
    return {
        "unknown": ids.join(drawn.select("id"), "id", "left_anti").distinct(),
        "missing": drawn.select("id").join(ids, "id", "left_anti").distinct(),
        "duplicate": labels.withColumn("k", F.row_number().over(order)).where("k > 1").select("id").distinct(),
        "bad_category": categories.where(F.col("category").isNotNull() & ~F.col("category").isin(*CATEGORY_IDS)).distinct(),
    }


def accepted(drawn: DataFrame, labels: DataFrame) -> DataFrame:
    """The first label of each drawn id, with the sample's subset. Unknown categories are reported elsewhere but kept."""
    order = Window.partitionBy("id").orderBy(*[c for c in ("source",) if c in labels.columns] or ["primary"])
    first = labels.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "source")
    subset = drawn.select("id", F.col("subset").alias("__subset")).dropDuplicates(["id"])
    return first.join(subset, "id").withColumn("subset", F.col("__subset")).drop("__subset").orderBy("id")


def compared(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels with their prediction: ``id, primary, reference, subset, ambiguous, predicted, mentions, anchors``; no prediction gives nulls.

    ``reference`` is the set of the label's primary and secondary categories. A label whose id has no
    prediction is unmatched, not an error.
    """
    wanted = predictions.join(labels.select(F.col("id").alias("recommendationid")).distinct(), "recommendationid", "left_semi")
    guess = wanted.select(F.col("recommendationid").alias("id"), F.col("primary_category").alias("predicted"), "mentions", "anchors")
    both = F.array_distinct(F.filter(F.array_union(F.array("primary"), F.coalesce("secondary", F.array().cast("array<string>"))), lambda c: c.isNotNull()))
    return labels.select("id", "primary", both.alias("reference"), "subset", "ambiguous").join(guess, "id", "left")


def confusion(pairs: DataFrame) -> DataFrame:
    """``primary, predicted, n`` of matched labels."""
    return pairs.where("predicted is not null").groupBy("primary", "predicted").agg(F.count("*").alias("n"))


def mistaken_for(matrix: DataFrame) -> DataFrame:
    """What each category is most often taken for: at least 3 times and a quarter of its misses; the last slot on ties."""
    slots = F.create_map(*[F.lit(x) for k, (c, _) in enumerate(CATEGORIES) for x in (c, k)])
    off = matrix.where("primary <> predicted").withColumn("slot", F.coalesce(slots[F.col("predicted")], F.lit(-1)))
    best = off.groupBy("primary").agg(F.sum("n").alias("misses"), F.max(F.struct("n", "slot", "predicted")).alias("b"))
    return best.where((F.col("b.n") >= 3) & (F.col("b.n") * 4 >= F.col("misses"))).select("primary", F.col("b.predicted").alias("taken_for"), F.col("b.n").alias("n"))


def category_counters(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per category (and ``by``): reference and predicted primaries, agreed ones, and the same for mentions, in one pass over exploded tags."""
    matched = pairs.where("predicted is not null")
    no = F.array().cast("array<string>")
    mentions = F.coalesce("mentions", no)

    def tags(array, name):
        return F.transform(array, lambda c: F.struct(c.alias("category"), F.lit(name).alias("what")))

    both = F.concat(
        tags(F.array("primary"), "ref_primary"), tags(F.array("predicted"), "pred_primary"), tags(F.when(F.col("primary") == F.col("predicted"), F.array("primary")).otherwise(no), "agreed"),
        tags(F.col("reference"), "ref_mentions"), tags(mentions, "pred_mentions"), tags(F.array_intersect("reference", mentions), "mention_agreed"),
    )
    each = matched.select(*by, F.explode(both).alias("t")).select(*by, "t.category", "t.what")
    return each.groupBy(*by, "category").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("ref_primary", "pred_primary", "agreed", "ref_mentions", "pred_mentions", "mention_agreed")])


def category_scores(counters: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the mentions of each category."""
    p, r, f1 = precision_recall_f1(F.col("ref_mentions"), F.col("pred_mentions"), F.col("mention_agreed"))
    return counters.withColumns({"precision": p, "recall": r, "f1": f1})


def macro_f1(scores: DataFrame) -> DataFrame:
    """Mean F1 of the categories that the reference mentions at all."""
    return scores.where("ref_mentions > 0").agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("categories"))


def slices(pairs: DataFrame) -> DataFrame:
    """Agreement of primaries with its interval: overall by subset, and by subset and whether the label is contested."""
    matched = pairs.where("predicted is not null")
    hit = F.count_if(F.col("primary") == F.col("predicted"))
    grouped = matched.groupingSets([["subset"], ["subset", "ambiguous"]], "subset", "ambiguous").agg(
        F.grouping("ambiguous").cast("int").alias("whole"), hit.alias("agreed"), F.count("*").alias("compared")
    )
    low, high = wilson(F.col("agreed"), F.col("compared"))
    return grouped.withColumns({"agreement": rate(F.col("agreed"), F.col("compared")), "low": low, "high": high})


def pooled(counters: DataFrame) -> DataFrame:
    """Counters of several apps summed by category: counts are added, rates never averaged; unknown categories are left out."""
    known = counters.where(F.col("category").isin(*CATEGORY_IDS))
    return known.groupBy("category").agg(*[F.sum(c).alias(c) for c in counters.columns if c not in ("category", "appid", "subset")])


def pooled_sources(sources: DataFrame) -> DataFrame:
    """The anchors and labellers behind several apps' agreement (``appid, anchors, produced_by``), each once and in order."""
    return sources.agg(F.count("*").alias("apps"), F.array_sort(F.collect_set("anchors")).alias("anchors"), F.array_sort(F.collect_set("produced_by")).alias("produced_by"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Gained, lost and the exact McNemar probability of two sets of verdicts (``id, right``) on the same reviews.

    Raises if the two do not cover the same ids.
    """
    a, b = first.select("id", F.col("right").alias("a")), second.select("id", F.col("right").alias("b"))
    together = a.join(b, "id", "full_outer")
    out = together.agg(
        F.count_if(~F.col("a") & F.col("b")).alias("gained"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("alone")
    )
    checked = out.withColumn("alone", F.when(F.col("alone") > 0, F.raise_error(F.lit("the two verdicts cover different reviews"))).otherwise(F.col("alone")))
    return checked.where("alone is null or alone = 0").select("gained", "lost", mcnemar(F.col("gained"), F.col("lost")).alias("p"))


def provenance(pairs: DataFrame) -> DataFrame:
    """The kinds of anchors behind the predictions; more than one is a mixture."""
    return pairs.agg(F.array_sort(F.collect_set("anchors")).alias("anchors")).withColumn("mixed", F.size("anchors") > 1)
