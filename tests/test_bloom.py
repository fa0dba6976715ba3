from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lensmill import bloom


def test_filters_never_miss_and_rarely_err():
    rng = np.random.default_rng(0)
    known, others = rng.integers(0, 2**63, 300_000).astype(np.uint64), rng.integers(0, 2**63, 50_000).astype(np.uint64)
    f = bloom.Bloom.of(known)
    assert f.might_contain(known).all() and f.might_contain(others).mean() < 0.02


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_filters_hold_what_was_added(known):
    h = np.array(known, dtype=np.uint64)
    assert bloom.Bloom.of(h).might_contain(h).all() and not bloom.Bloom.of(h[:0]).might_contain(h).any()


@pytest.mark.parametrize("most_bits", [bloom.MOST_BITS, 1 << 12])
def test_built_by_tasks_within_the_bound(spark, monkeypatch, most_bits):
    monkeypatch.setattr(bloom, "BLOCK_BITS", 1 << 10)
    rows = spark.range(5_000).select(F.xxhash64("id").alias("h"))
    f = bloom.bloom_of(rows, most_bits=most_bits)
    assert f.blocks > 1 and len(f.packed) * 8 <= most_bits
    inside = np.array([r.h for r in rows.collect()], dtype=np.int64).view(np.uint64)
    assert f.might_contain(inside).all()
    outside = f.might_contain(bloom.mix64(np.arange(10_000, dtype=np.uint64))).mean()
    assert outside < 0.05 or most_bits < bloom.MOST_BITS
    assert bloom.bloom_of(rows.limit(0)).might_contain(inside).sum() == 0


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_joins_are_exact_and_match_nulls(spark, how):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, str(i % 3) if i % 4 else None, i) for i in range(60)], "a int, b string, v int")
    keys = spark.createDataFrame([(1, "1"), (None, None), (2, None), (99, "x")], "a int, b string")
    known = {tuple(k) for k in keys.collect()}
    want = [tuple(r) for r in rows.collect() if ((r.a, r.b) in known) == (how == "left_semi")]
    assert sorted(map(str, bloom.screened_join(rows, keys, ["a", "b"], how).collect())) == sorted(str(r) for r in rows.collect() if tuple(r) in set(want))
