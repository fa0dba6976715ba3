from __future__ import annotations

import random

import pytest

from lensmill.llm import pages, spam

SUBJECTS = ["the map", "the story", "the music", "my clan", "this old patch", "the shop", "a boss", "the save menu"]
VERBS = ["is simple to learn and hard to put down", "was the reason that i came back to it", "takes far too long for what it is", "has more depth than you can see at first", "works well on my old laptop", "asks for patience that i do not have"]
KEYS = ["gold farm", "coin shop", "level boost", "wallhack", "discount code", "gift card", "season pass cheap", "unlock all", "mod menu"]


def honest(rng, n):
    return " ".join(f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)}.".capitalize() for _ in range(n))


@pytest.fixture(scope="module")
def shares(spark):
    rng = random.Random(4)
    rows = [(i, honest(rng, rng.randint(3, 12)), "en") for i in range(300)]
    links = "\n".join(f"- https://www.shop{i}.test/keys/{i}" for i in range(12))
    special = {
        "commas": ", ".join(rng.choice(KEYS) for _ in range(40)), "plain": " ".join(rng.choice(KEYS) for _ in range(60)), "lines": "\n".join(rng.choice(KEYS) for _ in range(40)),
        "hash": " ".join("#" + rng.choice(KEYS).replace(" ", "") for _ in range(40)), "links": links,
        "labelled": "\n".join(f"[{rng.choice(KEYS)}](https://a.test/{i})" for i in range(15)),
        "dressed": " ".join(f"Find {a}, {b} and {a} with {a}! Why {b}? Because {a}, {b}." for a, b in [("gold farm", "coin shop")] * 8),
        "products": "\n".join(f"Vizu Gold Edition | EU | {i}.99 | in stock" for i in range(12)),
        "under text": honest(rng, 12) + "\nTags: Horror, Open World, Puzzle, Survival, RPG",
        "spec": honest(rng, 10) + "\nOS: 64 bit\nMemory: 8 GB\nStorage: 20 GB\nSound: any",
        "with links": "\n".join(honest(rng, 3) + f"\n  https://www.guide{i}.test/list/{i}" for i in range(5)),
        "half": honest(rng, 4) + "\n\n" + ", ".join(rng.choice(KEYS) for _ in range(90)),
    }
    names = list(special)
    rows += [(1_000 + k, special[n], "en") for k, n in enumerate(names)]
    rows += [(2_000, None, "en"), (2_001, "", None), (2_002, " \n ", "en"), (2_003, "wow", "en"), (2_004, ", ".join(KEYS * 9), None), (2_004, ", ".join(KEYS * 9), "??"), (None, honest(rng, 5), "en"), (2_005, ", ".join(KEYS * 4_000), "en")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, lang string, spam_share string, words int")
    got = [(r.doc_id, r.spam_share) for r in spam.scored(frame).collect()]
    assert len(got) == len(rows)
    return frame, names, dict(got)


@pytest.mark.parametrize("name", ["commas", "plain", "lines", "hash", "links", "labelled", "dressed", "products", "half"])
def test_spam_is_found(shares, name):
    _, names, got = shares
    assert got[1_000 + names.index(name)] > 0.5


@pytest.mark.parametrize("name", ["under text", "spec", "with links"])
def test_honest_lists_are_no_spam(shares, name):
    _, names, got = shares
    assert got[1_000 + names.index(name)] < 0.5


def test_honest_documents_and_odd_rows(shares):
    frame, _, got = shares
    assert max(v for k, v in got.items() if k is not None and k < 1_000) < 0.3
    assert [got[k] for k in (2_000, 2_001, 2_002, 2_003)] == [0.0] * 4 and got[2_004] > 0.5 and got[2_005] > 0.5
    ids = [r.doc_id for r in spam.spam_pages(frame).collect()]
    assert ids.count(2_004) == 1 and None not in ids


def test_long_lines_said_again(spark):
    rng = random.Random(5)
    rows = [(i, honest(rng, rng.randint(3, 12)), "en") for i in range(100)]
    line = "If you came for the {0} then this is the place that has the {0} you look for, and it is a {0} for all who like a {0} at the end of the day"
    long = line + ", so take the {0} from me and the {0} of my clan, as this {0} is the {0} that was in the past and will be the {0} for as long as there is a map to play on"
    notes = honest(rng, 60).replace(". ", ".\n")
    special = ["\n".join([line.format("gold farm")] * 9), "\n".join([long.format("gold farm")] * 6), notes + "\n" + notes + "\n" + notes, honest(rng, 30) + "\n" + "\n".join([line.format("gold farm")] * 3)]
    rows += [(1_000 + k, t, "en") for k, t in enumerate(special)]
    got = {r.doc_id: r.spam_share for r in spam.scored(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[1_000] > 0.5 and got[1_001] > 0.5, got
    assert max(v for k, v in got.items() if k < 1_000 or k > 1_001) < 0.5


def test_rare_languages_have_no_function_words(spark):
    rng = random.Random(6)
    rows = [(i, honest(rng, rng.randint(3, 12)), "en") for i in range(100)]
    finnish = ["kartta", "tarina", "musiikki", "kauppa", "peli", "vihollinen", "tallennus", "valikko", "taso", "kaveri"]
    verbs = ["oli helppo oppia mutta vaikea lopettaa", "toimii vanhalla koneella todella hyvin", "vie aivan liian kauan aikaa", "kaipaa vielä muutaman kuukauden työtä", "yllätti minut täysin jo alussa"]
    rows += [(1_000 + i, " ".join(f"{rng.choice(finnish)} {rng.choice(verbs)}.".capitalize() for _ in range(12)), "fi") for i in range(9)]
    special = [", ".join(rng.choice(finnish) for _ in range(60)), "\n".join(f"- https://www.kauppa{i}.test/peli/{i}" for i in range(12)), " ".join(["halpa kauppa"] * 40)]
    rows += [(2_000 + k, t, "fi") for k, t in enumerate(special)]
    got = {r.doc_id: r.spam_share for r in spam.scored(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert max(v for k, v in got.items() if k < 2_000) < 0.5, got
    assert min(v for k, v in got.items() if k >= 2_000) > 0.5, got
    alone = spark.createDataFrame(rows[100:], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in spam.spam_pages(alone).collect()} == {2_000, 2_001, 2_002}


def test_languages_that_no_document_knows_are_not_spam(spark):
    """Honest text of a language that the labels do not know or name wrongly, in scripts with and without spaces."""
    rng = random.Random(7)
    rows = [(i, honest(rng, rng.randint(3, 12)), "en") for i in range(200)]
    texts = {
        "fi": "Kartta oli helppo oppia mutta vaikea lopettaa. Peli toimii vanhalla koneella todella hyvin ja se on ihan ok. En ole varma, mutta kun sain sen niin se oli jo aika hyvä. Me ja he ovat iloisia siitä. ",
        "ko": "이 게임은 정말 재미있어요. 그래픽도 좋고 음악도 훌륭합니다. 친구들과 함께 하면 더 즐겁습니다. 하지만 가격이 조금 비싸요. 다음 업데이트를 기다리고 있습니다. ",
        "th": "เกมนี้สนุกมากและกราฟิกสวยงาม เพลงประกอบก็ดีมาก ผมเล่นกับเพื่อนทุกวันและไม่เคยเบื่อ แต่ราคาแพงไปหน่อย รอการอัปเดตครั้งต่อไป ",
        "tr": "Bu oyun çok iyi ama biraz pahalı. Ben ve arkadaşım her gün oynuyoruz. Daha ne olsun ki, bir de harita var ki çok büyük. Ne zaman yeni bir şey gelse hep bakarız. ",
    }
    odd = [(1_000 + k, t, label) for k, (t, label) in enumerate((t, label) for lang, t in texts.items() for label in (None, "en", lang))]
    got = {r.doc_id: r.spam_share for r in spam.scored(spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")).collect()}
    assert max(v for k, v in got.items() if k >= 1_000) < 0.5, got
    # keywords and links of such a language are found all the same
    lists = [(2_000, ", ".join(["halpa peli", "ilmainen avain", "paras hinta", "tili myydään"] * 9), None), (2_001, "\n".join(f"- https://www.kauppa{i}.test/peli/{i}" for i in range(12)), None)]
    got = {r.doc_id: r.spam_share for r in spam.scored(spark.createDataFrame(rows + lists, "doc_id bigint, text string, lang string")).collect()}
    assert got[2_000] > 0.5 and got[2_001] > 0.5


def test_statistics_are_those_of_each_page_alone():
    """A batch gives every page what it gets alone, and counts agree with a plain loop."""
    from collections import Counter

    rng = random.Random(2)
    texts = [honest(rng, 9), "", None, "one, two, three\nfour | five\n\nsix seven", "[gold farm](https://a.test/1) and www.b.test/x here", "说了又说说了又说。好玩", "a\r\nb\r\n", honest(rng, 40), "#tag #tag\n" * 5]
    words = ["the", "is", "a", "to", "and", "it", "that"]
    order = pages.word_hashes(words).argsort()
    lexicon = pages.Lexicon(["en"], pages.word_hashes(words)[order], pages.np.ones((7, 1), dtype=bool), pages.np.ones((7, 1), dtype=bool))
    whole = pages.measure(texts, lexicon)
    at = [0, *pages.np.cumsum(whole.windows).tolist()]
    for i, t in enumerate(texts):
        alone = pages.measure([t], lexicon)
        for name in ("size", "words", "content", "function", "variety", "repeated", "separators", "link_share"):
            assert getattr(whole, name)[at[i] : at[i + 1]] == pytest.approx(getattr(alone, name)), (t, name)
        assert (whole.links[i], whole.top[i], whole.again[i]) == pytest.approx((alone.links[0], alone.top[0], alone.again[0]))
        for k, (a, b) in enumerate(pages.spans((t or "").replace("\r\n", "\n"))):
            said = pages._WORD.findall(pages._LINK.sub(" ", (t or "").replace("\r\n", "\n")[a:b]).lower())
            content = [w for w in said if w not in words]
            assert alone.words[k] == len(said) and alone.content[k] == len(content)
            assert alone.variety[k] == pytest.approx(len(set(content)) / len(content) if content else 1.0)
            pairs = Counter(zip(said, said[1:]))
            assert alone.repeated[k] == pytest.approx(sum(v for v in pairs.values() if v > 1) / (len(said) - 1) if len(said) > 1 else 0.0)


def test_said_again():
    assert spam.said_again("") == 0 and spam.said_again("a b\nA  B\n\ncd") == pytest.approx(1 / 3)


def test_windows_make_up_the_whole_text():
    rng = random.Random(1)
    for text in (honest(rng, 40), "x" * 5_000, "a\n\nb\n" * 100, "", "one line"):
        parts = spam.windows(text)
        assert "".join("".join(parts).split()) == "".join(text.split())
        assert all(len(p) <= 2 * pages.WINDOW for p in parts)


def test_empty(shares):
    frame, *_ = shares
    assert spam.scored(frame.limit(0)).count() == 0
