from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lensmill.llm import gbt, repetition

HONEST = "The weather system stops working when the launcher updates itself. The soundtrack has more depth than the trailer suggests. My clan has 183 members and we still play every weekend."


def brute_share(text):
    """Letters covered by runs that began earlier, by comparing every pair of places."""
    letters = "".join(c.lower()[0] for c in text if c.isalpha())
    width = repetition.RUN
    hit = set()
    for j in range(len(letters) - width + 1):
        if any(letters[i : i + width] == letters[j : j + width] for i in range(j)):
            hit.update(range(j, j + width))
    return len(hit) / len(letters)


@pytest.mark.parametrize("text", [HONEST, HONEST + HONEST, "good " * 20, "lololololo" * 8, HONEST + " again and again and again and again", "x" * 100])
def test_exact_share_is_that_of_brute_force(text):
    assert repetition.exact_share(text) == pytest.approx(brute_share(text))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abc .1", min_size=60, max_size=160))
def test_exact_share_on_small_alphabets(text):
    if sum(c.isalpha() for c in text) >= repetition.LEAST_LETTERS:
        assert repetition.exact_share(text) == pytest.approx(brute_share(text))


def test_what_does_not_matter():
    plain = repetition.exact_share((HONEST + " ") * 4)
    noisy = " ".join(f"{i}. {HONEST.upper() if i % 2 else HONEST}!!" for i in range(4)).replace(", ", "  ")
    assert repetition.exact_share(noisy) == pytest.approx(plain)
    assert repetition.exact_share("short short") is None and repetition.exact_share("") is None
    assert repetition.exact_share("开发者根本不听玩家的意见。" * 6) > 0.8


def test_statistics_are_those_of_each_text_alone():
    texts = ["", HONEST, "lol " * 40, "x", HONEST * 3, "这个价格没话说。" * 5]
    whole, letters = repetition.statistics(texts)
    for i, t in enumerate(texts):
        alone, n = repetition.statistics([t])
        assert whole[i] == pytest.approx(alone[0]) and letters[i] == n[0]
    assert repetition.statistics([])[0].shape == (0, len(repetition.MONOTONE))


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((2_000, 3))
    y = x[:, 0] ** 2 - 0.5 * x[:, 1] + rng.normal(0, 0.05, 2_000)
    trees = gbt.train(x, y, [1, -1, 0])
    assert np.abs(trees.score(x) - y).mean() < 0.08
    grid = np.linspace(0, 1, 200)
    for feature, way in ((0, 1), (1, -1)):
        for row in x[:50]:
            line = np.repeat(row[None], 200, axis=0)
            line[:, feature] = grid
            assert (np.diff(trees.score(line)) * way >= -1e-12).all()
    assert len(gbt.train(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).score(np.zeros((4, 3)))) == 4


def test_held_out_error_of_the_estimate():
    rng = np.random.default_rng(3)
    words = HONEST.split()
    texts = [" ".join(rng.permutation(words)) for _ in range(300)]
    texts += repetition._made(texts)
    share = np.array([repetition.exact_share(t) or 0.0 for t in texts])
    x, _ = repetition.statistics(texts)
    train, test = np.arange(len(texts)) % 2 == 0, np.arange(len(texts)) % 2 == 1
    trees = gbt.train(x[train], share[train], repetition.MONOTONE)
    assert np.abs(trees.score(x[test]) - share[test]).mean() < 0.03


def test_trees_alone_find_what_is_measured():
    """Recall and precision of the trees at the threshold, with no measurement behind them."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in ("ora", "eni", "ust") for c in ("m", "st", "ve", "n")]
    honest = [" ".join(rng.choice(words, 40)) for _ in range(600)]
    texts = [t for t in honest + repetition._made(honest) if repetition.exact_share(t) is not None]
    share = np.array([repetition.exact_share(t) for t in texts])
    x, _ = repetition.statistics(texts)
    train = np.arange(len(texts)) % 2 == 0
    score = gbt.train(x[train], share[train], repetition.MONOTONE).score(x[~train])
    clear = np.abs(share[~train] - repetition.FOUND) > 0.05
    assert clear.sum() > 400 and ((score >= repetition.FOUND) == (share[~train] >= repetition.FOUND))[clear].all()


def test_rows(spark):
    rows = [("a", "spam and eggs " * 20), ("a", "spam and eggs " * 20), ("b", HONEST), ("c", None), ("d", ""), ("e", "tiny"), (None, "lol" * 40), ("long", HONEST * 3_000)]
    frame = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "id string, review string, text string, share double")
    got = repetition.repetition(frame, "id", "review").collect()
    assert len(got) == len(rows)
    share = {r.id: r.share for r in got}
    assert share["a"] > 0.9 and share["b"] < 0.1 and share["long"] > 0.9 and share["c"] is share["d"] is share["e"] is None
    assert sorted(map(str, (r.id for r in repetition.repetitive(frame, "id", "review").collect()))) == ["None", "a", "long"]
    assert repetition.repetitive(frame.limit(0), "id", "review").count() == 0
