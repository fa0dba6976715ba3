from __future__ import annotations

import random

import numpy as np
import pytest

from lensmill.llm import langid

#: Words of three invented speakers; sentences are strung together from them.
WORDS = {
    "english": "the old game was really good and we played with friends every night because of its story".split(),
    "german": "das alte spiel war wirklich gut und wir haben jeden abend mit freunden wegen der geschichte gespielt".split(),
    "spanish": "el juego viejo era muy bueno y jugamos cada noche con los amigos por la historia que tiene".split(),
}
CODES = [("english", "en"), ("german", "de"), ("spanish", "es")]


def sentence(rng, language):
    return " ".join(rng.choice(WORDS[language]) for _ in range(9)).capitalize() + "."


def corpus(n, wrong=0.15, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        truth = rng.choice(list(WORDS))
        label = rng.choice(list(WORDS)) if rng.random() < wrong else truth
        out.append((f"{i:04d}", label, " ".join(sentence(rng, truth) for _ in range(3)), truth))
    return out


def test_parts_count_words_and_keep_their_places():
    texts = ["One two three four. Too short! Five six seven eight?", "", "...", "这个价格没话说真的好", "lol lol lol lol lol", "哈哈哈哈哈哈哈哈哈哈"]
    p = langid.parts(texts)
    said = [(int(d), texts[d][s:e].strip(), bool(f)) for d, s, e, f in zip(p.doc, p.start, p.end, p.full)]
    assert said == [(0, "One two three four.", True), (0, "Too short!", False), (0, "Five six seven eight?", True), (3, "这个价格没话说真的好", True), (4, "lol lol lol lol lol", False), (5, "哈哈哈哈哈哈哈哈哈哈", False)]
    for i, t in enumerate(texts):
        alone = langid.parts([t])
        own = np.flatnonzero(p.doc == i)
        assert p.words[own].tolist() == alone.words.tolist()
        assert [p.grams[p.gram_bounds[k] : p.gram_bounds[k + 1]].tolist() for k in own] == [alone.grams[alone.gram_bounds[k] : alone.gram_bounds[k + 1]].tolist() for k in range(len(own))]


def test_long_sentences_without_punctuation_are_cut():
    p = langid.parts(["word%s " * 40 % tuple("abcdefghijklmnopqrstuvwxyzabcdefghijklmn")])
    assert len(p.doc) == 4 and p.end[-1] == p.start[-1] + (p.end[-1] - p.start[-1]) and p.start[0] == 0


def test_held_out_accuracy_with_wrong_labels():
    rows = corpus(400)
    names = sorted(WORDS)
    model = langid.learn([r[2] for r in rows], np.array([names.index(r[1]) for r in rows]), names)
    test = corpus(300, seed=2)
    p = langid.parts([r[2] for r in test])
    best, sure = model.score(p)
    right = np.array([names[b] == test[d][3] for b, d in zip(best, p.doc)])
    assert right.mean() > 0.99 and ((sure >= 0.3) & (sure <= 1.0 + 1e-9)).all()


def test_scores_are_those_of_a_plain_loop():
    rows = corpus(50)
    names = sorted(WORDS)
    model = langid.learn([r[2] for r in rows], np.array([names.index(r[1]) for r in rows]), names)
    p = langid.parts([r[2] for r in rows[:5]])
    for k, b in enumerate(model.score(p)[0]):
        total = np.zeros(len(names))
        for g in p.grams[p.gram_bounds[k] : p.gram_bounds[k + 1]]:
            total += model.log_p[g]
        assert total.argmax() == b


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(9)
    rows = [(i, label, text) for i, label, text, _ in corpus(300)]
    mixed = " ".join(sentence(rng, "german") for _ in range(2)) + "\n" + " ".join(sentence(rng, "spanish") for _ in range(2))
    rows += [("mixed", " GERMAN", mixed), ("mixed", " GERMAN", mixed), ("iso", "ES ", sentence(rng, "spanish")), ("none", None, sentence(rng, "english")), ("odd", "n/a", "10/10 GOTY"), ("null", "english", None), ("empty", "english", ""), (None, None, sentence(rng, "german"))]
    rows += [("long", "english", " ".join(sentence(rng, "english") for _ in range(6_000)))]
    frame = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "rid string, language string, review string, label string, confidence double")
    return frame, spark.createDataFrame(CODES, "language string, iso_code string")


def test_labels_and_parts(found):
    frame, codes = found
    missing = {(r.id, r.language) for r in langid.unlabelled(frame, "rid", "language", "review", codes).collect()}
    assert {("mixed", "spanish"), ("none", "english")} <= missing
    assert not {i for i, _ in missing} & {"iso", "odd", "null", "empty", "long", None}
    want = {(i, truth) for i, label, _, truth in corpus(300) if label != truth}
    assert {m for m in missing if m[0].isdigit()} == want
    parts = [r for r in langid.languages_of(frame, "rid", "language", "review", codes).collect()]
    ids = [r.id for r in parts]
    assert ids.count("mixed") == 4 and ids.count("long") == 1 and ids.count("null") == 1
    mixed = sorted((r.start, r.end, r.language) for r in parts if r.id == "mixed")[::2]
    assert [m[2] for m in mixed] == ["german", "spanish"] and mixed[0][0] == 0 and mixed[0][1] == mixed[1][0]
    assert all(r.confidence > 0.9 for r in parts if r.language) and {r.language for r in parts if r.id in ("odd", "null", "empty")} == {None}


def test_documents_have_one_language_each(found):
    frame, codes = found
    rows = langid.documents_of(langid.languages_of(frame, "rid", "language", "review", codes)).collect()
    assert len(rows) == frame.count()
    by = {r.id: r for r in rows}
    assert by["mixed"].language in ("german", "spanish") and 0.4 < by["mixed"].confidence < 0.7
    assert by["null"].language is by["odd"].language is None and by["null"].confidence == 0 and by["long"].language == "english"
    truth = {i: t for i, _, _, t in corpus(300)}
    assert all(by[i].language == t and by[i].confidence > 0.9 for i, t in truth.items())


def test_sure_sentences_are_right():
    """Held-out full sentences, a third of whose words are of another language: those called sure are right as often as said."""
    rng = random.Random(4)
    names = sorted(WORDS)
    rows = corpus(300)
    model = langid.learn([r[2] for r in rows], np.array([names.index(r[1]) for r in rows]), names)
    test = [rng.choice(names) for _ in range(3_000)]
    p = langid.parts([" ".join(rng.choice(WORDS[t if k % 3 else rng.choice(names)]) for k in range(6)) for t in test])
    best, sure = model.score(p)
    right = np.array([names[b] == test[d] for b, d in zip(best, p.doc)])
    inside = p.full & (sure >= langid.SURE)
    assert inside.sum() > 1_000 and right[inside].mean() >= langid.SURE


def test_rare_languages_get_their_part_of_the_sample(spark):
    rows = spark.range(20_000).selectExpr("if(id % 1000 = 0, 'rare', if(id % 2 = 0, 'a', 'b')) as label", "cast(id as string) as text").unionByName(spark.createDataFrame([(None, "x")], "label string, text string"))
    from lensmill.llm.batch import hash_sample

    got = [r.label for r in hash_sample(rows, 300, "label")]
    assert got.count("rare") == 20 and got.count("a") == got.count("b") == 100
    assert hash_sample(rows.where("label = 'none'"), 300, "label") == []


def test_empty_tables(found):
    frame, codes = found
    assert langid.unlabelled(frame.limit(0), "rid", "language", "review", codes).count() == 0
    assert langid.unlabelled(frame, "rid", "language", "review", codes.limit(0)).count() == 0
