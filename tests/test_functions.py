from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lensmill.functions import show, stats, text


def one(spark, *columns, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items())) if names else spark.range(1)
    out = row.select(*columns).first()
    return out[0] if len(columns) == 1 else tuple(out)


def test_text_key_and_rank(spark):
    assert one(spark, text.text_key("t"), t="good game") == hashlib.sha256(b"good game").hexdigest()
    assert one(spark, text.text_key("t"), t="") == hashlib.sha256(b"").hexdigest()
    want = hashlib.sha256((7).to_bytes(8, "little") + b"report" + b"123").hexdigest()
    assert one(spark, text.rank_key(7, "report", "t"), t="123") == want
    assert one(spark, text.rank_key(8, "report", "t"), t="123") != want


@pytest.mark.parametrize(("t", "want"), [("   ", False), (" \n\x85", False), (" a ", True), (None, False), ("", False)])
def test_blank(spark, t, want):
    assert one(spark, text.not_blank("t"), t=t) is want


def test_calendar(spark):
    assert one(spark, text.day_name("t"), t=1709251199) == "29 February 2024"
    assert one(spark, text.day_name("t"), t=1709251200) == "1 March 2024"
    assert one(spark, text.day_name("t"), t=0) == "unknown"
    assert one(spark, text.year_month("t"), t=-1) == "1969-12"
    assert one(spark, text.month_name("t"), t="2024-02") == "Feb 2024"
    assert one(spark, text.month_name("t"), t="junk") == "junk"


def test_small_text_functions(spark):
    assert one(spark, text.bits_to_ids("m", ("a", "b", "c")), m=5) == ["a", "c"]
    assert one(spark, text.review_url("a", F.lit(1), "https://store.invalid"), a="7") == "https://store.invalid/profiles/7/recommended/1/"
    assert one(spark, text.review_url("a", F.lit(1), "x"), a="") is None
    assert one(spark, text.folded("t"), t="x" * 321 + "  ") is True
    assert one(spark, text.embedding_text(F.lit("Bugs"), F.lit("It crashes"))) == "Bugs. It crashes"


@pytest.mark.parametrize(("hits", "n", "low", "high"), [(24, 47, 0.372, 0.647), (12, 12, 0.757, 1.0), (0, 12, 0.0, 0.243)])
def test_wilson(spark, hits, n, low, high):
    got = one(spark, *stats.wilson(F.col("a"), F.col("b")), a=hits, b=n)
    assert got == pytest.approx((low, high), abs=0.002)


def test_wilson_of_nothing(spark):
    assert one(spark, *stats.wilson(F.col("a"), F.col("b")), a=0, b=0) == (None, None)


@pytest.mark.parametrize(("gained", "lost", "p"), [(12, 2, 0.012939453125), (7, 7, 1.0), (9, 7, 0.8036), (0, 0, None), (161, 79, 1.3e-7)])
def test_mcnemar(spark, gained, lost, p):
    got = one(spark, stats.mcnemar(F.col("a"), F.col("b")), a=gained, b=lost)
    assert got is None if p is None else got == pytest.approx(p, abs=1e-3)


@pytest.mark.parametrize(("ref", "pred", "hit", "want"), [(10, 20, 8, (0.4, 0.8, 0.53333)), (12, 0, 0, (None, 0.0, 0.0)), (0, 0, 0, (None, None, None))])
def test_precision_recall_f1(spark, ref, pred, hit, want):
    got = one(spark, *stats.precision_recall_f1(F.col("a"), F.col("b"), F.col("c")), a=ref, b=pred, c=hit)
    assert all(g is w if w is None else g == pytest.approx(w, abs=1e-5) for g, w in zip(got, want))


def test_tone_needs_evidence(spark):
    assert one(spark, stats.tone(F.col("a"), F.col("b"), F.lit(0.7)), a=8, b=8) == "neutral"
    assert one(spark, stats.tone(F.col("a"), F.col("b"), F.lit(0.7)), a=400, b=400) == "warmer"
    assert one(spark, stats.tone(F.col("a"), F.col("b"), F.lit(0.7)), a=1, b=400) == "colder"


def test_gauge_and_heat(spark):
    assert one(spark, stats.gauge(F.col("a")), a=0.0) == -1
    assert one(spark, stats.gauge(F.col("a")), a=2.0) == pytest.approx(1 / 3)
    assert one(spark, stats.heat(F.col("a")), a=0.9) == 1


def test_formats():
    assert [show.percent(x) for x in (0.0004, 0.0, 0.1234)] == ["<0.1%", "0.0%", "12.3%"]
    assert [show.coverage(x) for x in (1.0, 0.99999, 0.99991, 0.5, None)] == ["100.00%", ">99.99%", "99.99%", "50.00%", "unknown"]
    assert show.thousands(1234567) == "1,234,567"
    assert show.elapsed(11455) == "3h 10m" and show.elapsed(61) == "1m 01s" and show.elapsed(5) == "5s"
    assert show.escape("<a href='x'>&") == "&lt;a href=&#39;x&#39;&gt;&amp;"
    assert show.provenance([]) == "descriptions" and show.provenance([1, 2]) == "fitted:1+2"
    assert "mixture" in show.built_from(["a", "b"])
    assert show.title("", 7) == "App 7" and show.hours(59) == "59 min" and show.hours(180) == "3 h"


def test_sql_functions_agree_with_the_columns(spark):
    from lensmill.functions.register import register

    assert "mcnemar_p" in register(spark)
    rows = spark.createDataFrame([(24, 47, 12, 2), (0, 12, 7, 7), (12, 12, 9, 7), (0, 0, 0, 0), (5, 9, 3, 0)], "hits int, n int, gained int, lost int")
    rows.createOrReplaceTempView("verdicts")
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    want = rows.select(low, high, stats.mcnemar(F.col("gained"), F.col("lost")), stats.rate(F.col("hits"), F.col("n")), stats.ratio(F.col("hits"), F.col("n"))).collect()
    got = spark.sql("SELECT wilson_low(hits, n), wilson_high(hits, n), mcnemar_p(gained, lost), rate(hits, n), ratio(hits, n) FROM verdicts").collect()
    for g, w in zip(got, want):
        assert [None if x is None else round(x, 12) for x in g] == [None if x is None else round(x, 12) for x in w]
    assert spark.sql("SELECT year_month(-1), not_blank(' \n'), not_blank('a'), text_key('good game')").first()[:3] == ("1969-12", False, True)
