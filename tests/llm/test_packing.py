from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lensmill.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60), st.sets(st.integers(100, 300), min_size=1, max_size=4))
def test_containers_hold_their_items_and_are_no_larger_than_needed(lengths, sizes):
    where, capacity = packing.pack(lengths, sorted(sizes))
    used = np.bincount(where, weights=lengths, minlength=len(capacity)) if lengths else np.zeros(0)
    assert (used <= capacity).all()
    for u, c in zip(used, capacity):
        assert c == min(s for s in sizes if s >= u)


def test_little_space_is_left():
    rng = random.Random(0)
    lengths = [rng.randint(1, 2_000) for _ in range(5_000)]
    _, capacity = packing.pack(lengths, [512, 2_048, 4_096])
    assert sum(lengths) / capacity.sum() > 0.99


def test_cheaper_sizes_are_opened():
    _, capacity = packing.pack([500] * 8, [512, 4_096], cost={512: 1.0, 4_096: 100.0})
    assert capacity.tolist() == [512] * 8
    with pytest.raises(ValueError):
        packing.pack([600], [512])


def brute_bins(lengths, size):
    """Fewest bins by trying every assignment of a few items."""
    best = len(lengths)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for k in range(len(room)):
            if room[k] >= lengths[i]:
                place(i + 1, [*room[:k], room[k] - lengths[i], *room[k + 1 :]])
        place(i + 1, [*room, size - lengths[i]])

    place(0, [])
    return best


def test_near_the_best_possible():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randint(1, 60) for _ in range(8)]
        assert len(packing.pack(lengths, [100])[1]) <= brute_bins(lengths, 100) + 1


def test_rows(spark):
    rows = [(1, 10), (1, 10), (2, None), (3, 0), (4, 1_000), (None, 5), (5, 512), (6, 513)]
    frame = spark.createDataFrame([(i, n, "clash", 1) for i, n in rows], "doc_id bigint, n_tokens bigint, piece string, container int")
    got = packing.packed(frame, [256, 512], chunk_items=3).collect()
    used, capacity, pieces = defaultdict(int), {}, defaultdict(list)
    for r in got:
        used[r.container] += r.n_tokens
        assert capacity.setdefault(r.container, r.capacity) == r.capacity
        pieces[r.doc_id].append((r.piece, r.start, r.n_tokens))
    assert all(used[c] <= capacity[c] for c in used)
    assert sorted(pieces[4]) == [(0, 0, 512), (1, 512, 488)] and sorted(pieces[6]) == [(0, 0, 512), (1, 512, 1)]
    assert pieces[1] == [(0, 0, 10)] * 2 and pieces[2] == pieces[3] == [(0, 0, 0)] and pieces[5] == [(0, 0, 512)] and pieces[None] == [(0, 0, 5)]
    assert packing.packed(frame.limit(0), [256]).count() == 0
