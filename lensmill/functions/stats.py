"""Rates, intervals and exact tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the normal distribution used for all intervals.
Z = 1.959963985


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole).otherwise(0.0)


def rate(part: Column, whole: Column) -> Column:
    """``part / whole``, null where the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole)


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval within [0, 1]; null for n = 0."""
    p = hits.cast("double") / n
    z2 = F.lit(Z * Z)
    centre = (p + z2 / (n * 2)) / (z2 / n + 1)
    half = F.sqrt(p * (1 - p) / n + z2 / (n * n * 4)) * Z / (z2 / n + 1)
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low), F.when(n > 0, high)


def mcnemar(gained: Column, lost: Column) -> Column:
    """Exact two-sided McNemar probability; null if nothing changed sides.

    The binomial tail is summed from its first term, 0.5 ** n, each term from the one before.
    """
    n, k = (gained + lost).cast("int"), F.least(gained, lost).cast("int")
    first = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.pow(F.lit(0.5), n).alias("sum"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, first, add)["sum"]
    return F.when(n > 0, F.least(F.lit(1.0), tail * 2))


def precision_recall_f1(reference: Column, predicted: Column, agreed: Column) -> tuple[Column, Column, Column]:
    """Precision and recall are null without a denominator; F1 is null only if there is neither reference nor prediction."""
    precision, recall = rate(agreed, predicted), rate(agreed, reference)
    p, r = F.coalesce(precision, F.lit(0.0)), F.coalesce(recall, F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return precision, recall, F.when((reference > 0) | (predicted > 0), f1)


def heat(c: Column) -> Column:
    """Shade of a rate in a matrix."""
    return F.least(F.lit(1.0), F.sqrt(2 * c))


def gauge(bias: Column) -> Column:
    """Where a bias factor stands between -1 and 1; 0 is as low as it goes."""
    return F.when(bias <= 0, -1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log2(bias) / 3)))


def tone(hits: Column, n: Column, baseline: Column) -> Column:
    """``warmer`` or ``colder`` only where the interval leaves the baseline on one side."""
    low, high = wilson(hits, n)
    return F.when(low > baseline, "warmer").when(high < baseline, "colder").otherwise("neutral")
