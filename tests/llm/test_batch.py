from __future__ import annotations

import numpy as np
import pytest

from lensmill.llm import batch


def test_chunks_cover_all_texts_and_never_cut_one():
    texts = ["a" * 5, None, "", "b" * 20, "c" * 3, "d" * 3]
    got = list(batch.chunks(texts, 10))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(6)) and (3, 4) in got
    assert list(batch.chunks([], 10)) == []


def test_codepoints_and_sums():
    flat, offsets = batch.codepoints(["aé", "", "🙂"])
    assert flat.tolist() == [97, 233, 0x1F642] and offsets.tolist() == [0, 2, 2, 3]
    assert batch.segment_sums(np.array([1, 2, 3]), offsets).tolist() == [3, 0, 3]
    assert batch.powers(3, 5).tolist() == [1, 3, 9, 27, 81]


@pytest.mark.parametrize("total", [0, 50, 100, 101, 110, 119, 121, 5_000])
def test_a_sample_is_bounded_and_whole_where_it_can_be(spark, total):
    rows = spark.range(total).selectExpr("cast(id as string) as t")
    got = [r[0] for r in batch.hash_sample(rows, 100)]
    assert len(got) == len(set(got)) == min(total, 100) if total != 5_000 else 70 < len(got) <= 100
    assert got == [r[0] for r in batch.hash_sample(rows.repartition(3), 100)]


def test_equal_rows_do_not_fill_a_sample(spark):
    rows = spark.range(10_000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id as string) end as t")
    assert len(batch.hash_sample(rows, 200)) <= 200
