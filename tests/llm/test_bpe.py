from __future__ import annotations

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lensmill.llm import bpe
from lensmill.llm.batch import mix64

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.vocabulary_path()), reason="no vocabulary here")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1_000, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = mix64(np.arange(n, dtype=np.uint64) + np.uint64(99))
    assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(n))


def test_perfect_hash_refuses_repeated_keys():
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.array([1, 1], dtype=np.uint64))


@pytest.fixture(scope="module")
def both():
    tiktoken = pytest.importorskip("tiktoken")
    if not os.path.exists(bpe.vocabulary_path()):
        pytest.skip("no vocabulary here")
    own = bpe.encoder(bpe.vocabulary_path())
    return own, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def check(both, texts):
    own, other = both
    ids, begin = own.encode_batch(texts)
    got = [ids[a:b].tolist() for a, b in zip(begin, begin[1:])]
    assert got == [other.encode_ordinary(t or "") for t in texts]


def test_same_ids_as_the_library(both):
    check(both, ["", None, " ", "\n\n  x", "I'll don't", "naïve café 测试 текст 🙂👩‍👩‍👧", "a" * 20_000, "\x00\x01<|endoftext|>", "12345678901234567890", "x=y+1; C:\\games\\save", "ﬁ½①…"])
    check(both, [])
    check(both, [None])


def test_pretokens_of_random_letters(both):
    rng = random.Random(0)
    check(both, ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(80))) for _ in range(500)])


def test_pretokens_are_those_of_the_pattern():
    """Character classes, apostrophes, blanks and line ends in every order."""
    import regex

    from lensmill.llm.batch import codepoints

    pattern, rng = regex.compile(bpe.PATTERN), random.Random(3)
    alphabet = "ab'stmdrevl  \n\t.,!'’1２é漢\u3000\u00a0\r\u200bX²\u0301"
    texts = ["", "don't", "'tis", "they'll've", "''s", " 's", "'s", "'", "a's b'sx 'll"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(5_000)]
    flat, offsets = codepoints(texts)
    at = np.flatnonzero(bpe.pretoken_starts(flat, offsets))
    whole = "".join(texts)
    assert [whole[a:b] for a, b in zip(at, np.append(at[1:], len(whole)))] == [w for t in texts for w in pattern.findall(t)]


def test_counts_are_the_lengths(spark, both):
    frame = spark.createDataFrame([(1, "good game", 5), (2, None, 5), (None, "", 5)], "doc_id bigint, text string, n_tokens int")
    assert sorted(map(str, map(tuple, bpe.token_counts(frame).collect()))) == sorted(map(str, [(1, 2), (2, 0), (None, 0)]))


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(max_size=60), max_size=6))
def test_any_text(both, texts):
    check(both, texts)


def test_round_trip(both):
    own, other = both
    text = "Patch 1.2 – Größe, 价格没话说!\r\n\tend"
    ids, _ = own.encode_batch([text])
    assert other.decode(ids.tolist()) == text


def test_rows(spark, both):
    frame = spark.createDataFrame([(1, "good game", "clash"), (1, "good game", "clash"), (2, None, "clash"), (3, "", "clash"), (None, "x", "clash")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encoded(frame).collect()]
    want = both[1].encode_ordinary("good game")
    assert sorted(map(str, got)) == sorted(map(str, [(1, want), (1, want), (2, []), (3, []), (None, both[1].encode_ordinary("x"))]))
    assert dict(bpe.encoded(frame).dtypes)["ids"] == "array<int>"
    assert bpe.encoded(frame.limit(0)).count() == 0
