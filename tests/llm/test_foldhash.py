from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lensmill.llm import foldhash

TEXT = "Через 418 часов я наконец дошёл до Feguzikedo. Лучше подождите хорошей скидки!"
FIELDS = "Graphics: 9 of 10\nAudio: weak\nFavourite map: Dagokokupi\nStory: 3 of 10"


def keys(texts):
    h, kept, fields = foldhash.fold_hashes(texts)
    return list(zip(h.tolist(), kept.tolist(), fields.tolist()))


def test_formatting_does_not_matter():
    same = [TEXT, TEXT.upper(), TEXT.replace(" ", "\u2003"), TEXT.replace(".", "").replace("!", ""), "- " + TEXT + " \n", TEXT.replace(" ", "")]
    assert len(set(keys(same))) == 1
    assert len(set(keys([TEXT, TEXT + "x", TEXT.replace("418", "419"), TEXT[::-1]]))) == 4


def test_order_of_fields_does_not_matter_but_their_values_do():
    other = " | ".join(p.upper() for p in reversed(FIELDS.split("\n")))
    swapped = FIELDS.replace("weak", "9 of 10").replace("Graphics: 9 of 10", "Graphics: weak")
    a, b, c, d = keys([FIELDS, other, swapped, FIELDS.replace(":", "").replace("\n", " ")])
    assert a == b and a[2] and a != c and not d[2] and a != d
    assert foldhash.same_record(FIELDS, other) and not foldhash.same_record(FIELDS, swapped) and not foldhash.same_record(FIELDS, FIELDS + "\nAudio: weak")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbB1 .:|;\n\u00dfI\u0130", max_size=12), min_size=1, max_size=12))
def test_hashes_and_comparisons_agree_with_canonical_forms(texts):
    k = keys(texts)
    forms = [(foldhash.canonical(t), foldhash.is_fields(t)) for t in texts]
    for i in range(len(texts)):
        assert k[i] == keys([texts[i]])[0]
        assert k[i][1] == foldhash.fold_kept(texts[i]) and k[i][2] == forms[i][1]
        for j in range(i):
            assert (k[i] == k[j]) == (forms[i] == forms[j]), (texts[i], texts[j])
            assert foldhash.same_record(texts[i], texts[j]) == (forms[i] == forms[j])


def brute(rows):
    groups = defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None and foldhash.fold_kept(t) >= foldhash.LEAST_KEPT:
            groups[foldhash.canonical(t), foldhash.is_fields(t)].add(i)
    return {(min(v), x) for v in groups.values() for x in v if x != min(v)}


@pytest.mark.parametrize("collide", [False, True])
def test_pairs(spark, collide, monkeypatch):
    if collide:  # every hash the same: verification and its exact rest must still tell the records apart
        real = foldhash.fold_hashes
        monkeypatch.setattr(foldhash, "fold_hashes", lambda texts: (np.zeros(len(texts), dtype=np.int64), np.full(len(texts), 30, dtype=np.int64) * (real(texts)[1] >= 30), np.zeros(len(texts), dtype=bool)))
    hot = [(f"h{i:03d}", TEXT.upper() if i % 2 else TEXT + "." * (i % 5)) for i in range(200)]
    rows = [*hot, ("h001", TEXT), ("f1", FIELDS), ("f2", " | ".join(reversed(FIELDS.split("\n")))), ("e1", "short"), ("e2", "short"), ("n", None), (None, TEXT), ("z", ""), ("two", TEXT), ("two", FIELDS), ("long1", "word " * 40_000), ("long2", "WORD" * 40_000)]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "rid string, review string, text string, h int")
    got = [(r.first_id, r.id) for r in foldhash.formatting_pairs(frame, "rid", "review").collect()]
    assert len(got) == len(set(got))
    if not collide:
        assert set(got) == brute(rows)
        assert {r.first_id: r.copies for r in foldhash.collapsed(frame, "rid", "review").collect()} == {"f1": 3, "h000": 201, "long1": 2}


def test_records_are_whole(spark):
    rows = [("a", TEXT), ("a", TEXT), ("a", FIELDS), ("b", TEXT.upper()), ("c", " | ".join(reversed(FIELDS.split("\n")))), ("d", "gg"), ("e", "GG!"), ("f", "alone"), ("g", None), (None, "Alone."), (None, "nobody"), ("h", "!"), ("i", "")]
    expected = defaultdict(list)
    for i, t in rows:
        if t is not None:
            expected[foldhash.canonical(t), foldhash.is_fields(t)].append(i)
    expected = sorted((min(filter(None, v), default="-"), len(set(v) - {None}), len(v)) for v in expected.values())
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "rid string, review string, text string, h int").repartition(3)
    assert sorted((r.first_id or "-", r.ids, r.copies) for r in foldhash.records(frame, "rid", "review").collect()) == expected
    assert expected == [("-", 0, 1), ("a", 2, 2), ("a", 2, 3), ("d", 2, 2), ("f", 1, 2), ("h", 2, 2)]


def test_colliding_records_are_told_apart():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": ["b", "c"], "h": [1, 1], "kept": [9, 9], "fields": [False, False], "text": [TEXT.upper(), FIELDS], "first_text": [TEXT, TEXT]})
    assert [r["other"] for r in next(iter(foldhash._compared(iter([batch])))).to_pylist()] == [None, foldhash.canonical(FIELDS)]


def test_collisions_are_told_apart():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": ["b", "c"], "first_id": ["a", "a"], "text": [TEXT.upper(), FIELDS], "first_text": [TEXT, TEXT]})
    out = next(iter(foldhash._verified(iter([batch])))).to_pylist()
    assert out[0]["other"] is None and out[1]["other"] == foldhash.canonical(FIELDS)


@pytest.mark.parametrize("at_once", [1, 7, 1 << 16])
def test_comparison_by_blocks(monkeypatch, at_once):
    monkeypatch.setattr(foldhash, "FOLD_AT_ONCE", at_once)
    assert foldhash.same_text(TEXT, "..." + TEXT.upper().replace(" ", "  ...  "))
    assert not foldhash.same_text(TEXT, TEXT + "x") and not foldhash.same_text("x" + TEXT, TEXT) and foldhash.same_text("!", "") and not foldhash.same_text("", "a")


def test_only_colliding_texts_leave_the_scan(spark, monkeypatch, tmp_path):
    """At any number of keys: the rows are screened where they are read, with no exchange between."""
    spark.range(3_000).selectExpr("cast(id as string) as rid", "concat('the quick brown fox jumps over the lazy dog, number ', cast(id % 2990 as string)) as review").write.parquet(f"{tmp_path}/t")
    seen = []
    real = foldhash.cut

    def cut(df):
        plan, out = df._jdf.queryExecution().executedPlan().toString(), real(df)
        seen.append((plan, df.columns, out.count()))
        return out

    monkeypatch.setattr(foldhash, "cut", cut)
    monkeypatch.setattr(foldhash, "spread", lambda df: df)
    assert foldhash.formatting_pairs(spark.read.parquet(f"{tmp_path}/t"), "rid", "review").count() == 10
    (_, _, keys), (texts, columns, members), _ = seen
    assert keys == 10 and "text" in columns and "Exchange" not in texts and 20 <= members < 20 + 3_000 * 0.05


def test_a_record_of_very_many_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(foldhash, "ROWS_PER_SALT", 50)
    rows = spark.range(500).selectExpr("format_string('%04d', id) as rid", f"concat('{TEXT}', repeat('!', cast(id % 7 as int))) as review")
    got = [(r.first_id, r.id) for r in foldhash.formatting_pairs(rows, "rid", "review").collect()]
    assert len(got) == 499 and {a for a, _ in got} == {"0000"}


def test_empty(spark):
    assert foldhash.formatting_pairs(spark.createDataFrame([], "rid string, review string"), "rid", "review").count() == 0
