"""The language of each document and of each part of a mixed one, with a confidence.

Multinomial naive Bayes over hashed character n-grams of one to three. The model is learned from a
bounded sample of labelled rows and cleans itself: labels that the model contradicts are replaced by
its own answer and the counts are taken again. The matrix of log probabilities has a fixed size and
is broadcast; batches are scored in numpy by gathering its rows for the n-grams that occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmill.llm.batch import chunks, codepoints, hash_sample, mix64, powers, segment_sums
from lensmill.shared import spread

#: Buckets of the hashed n-grams: with 12 languages the matrix takes 3 MB, whatever the corpus.
BUCKETS = 1 << 16
#: Labelled rows the model is learned from at most, and rounds of cleaning.
TRAIN_ROWS, ROUNDS = 12_000, 3
#: Words, or characters in scripts without spaces, of a full sentence.
WORDS, CHARACTERS = 4, 8
#: N-grams that count as independent evidence at most when a confidence is given.
EVIDENCE = 24
#: Characters scored at once, which bounds the gathered rows to some 30 MB.
SCORE_CHARS = 200_000
#: Sentences without punctuation are cut after this many words, so that a switch of language inside one shows.
LONG = 12
#: Letters from which a word stands for several that were run together, if it has this many different letters.
RUN_TOGETHER, DIFFERENT = 24, 8
#: Confidence from which a sentence is taken to be in its language.
SURE = 0.95
#: Fixed value: what ends a sentence or a part.
_ENDS = ".!?。！？…\n\r\v\f\x85\u2028\u2029;；|/．｡:："

_ROLL = 0x2545F4914F6CDD1D
_UNROLL = pow(_ROLL, -1, 1 << 64)
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letter of each code point (32 for anything else), and bits: 1 letter, 2 ends a sentence, 4 script without spaces, 8 joins words."""
    global _tables
    if _tables is None:
        low, kind = np.full(0x110000, 32, dtype=np.uint32), np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha() or 0x300 <= c < 0x370:
                low[c], kind[c] = ord(ch.lower()[0]), 1
        for ch in _ENDS:
            kind[ord(ch)] = 2
        for lo, hi in ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
            kind[lo : hi + 1] |= 4 * (kind[lo : hi + 1] & 1)
        for ch in "'’-":
            kind[ord(ch)] = 8
        _tables = low, kind
    return _tables


@dataclass
class Parts:
    """Sentences of a batch: their text, where they start and end in it, words, dense characters, hashed n-grams."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    dense: np.ndarray
    grams: np.ndarray
    gram_bounds: np.ndarray

    @property
    def full(self) -> np.ndarray:
        return (self.words >= WORDS) | (self.dense >= CHARACTERS)


def _different(owner: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
    """Number of different values of each owner."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    fresh = np.ones(len(o), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[fresh], minlength=count)


def parts(texts: list[str]) -> Parts:
    """Cut texts into sentences and hash the n-grams of each; sentences without a letter are left out."""
    flat, offsets = codepoints(texts)
    low_table, kind_table = _character_tables()
    low, kind = low_table[flat], kind_table[flat]
    begins = np.zeros(len(flat), dtype=bool)
    begins[offsets[:-1][offsets[:-1] < len(flat)]] = True
    begins[1:] |= kind[:-1] == 2
    starts = np.append(np.flatnonzero(begins), len(flat))
    letter = (kind & 1).astype(bool)
    letters = segment_sums(letter.astype(np.int64), starts)
    keep = letters > 0
    number = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    joined = letter | (kind == 8)
    fresh_word = letter & ~(kind & 4).astype(bool)
    opens = fresh_word.copy()
    opens[1:] &= ~(joined[:-1] & (kind[:-1] & 4 == 0)) | begins[1:]
    # a long unpunctuated sentence goes on in a new one every LONG words
    nth = np.cumsum(opens) - opens
    nth -= nth[starts[:-1]][number] if len(flat) else 0
    cut = opens & (nth > 0) & (nth % LONG == 0)
    if cut.any():
        starts = np.union1d(starts, np.flatnonzero(cut))
        number = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        keep = segment_sums(letter.astype(np.int64), starts) > 0
    # different words and different dense characters: a name or a laugh said again is no sentence
    at_word = np.flatnonzero(opens)
    in_word = fresh_word | (kind == 8)
    ends_word = np.ones(len(flat), dtype=bool)
    ends_word[:-1] = ~in_word[1:] | opens[1:] | (number[1:] != number[:-1])
    stop = np.flatnonzero(in_word & ends_word) + 1
    stop = stop[np.searchsorted(stop, at_word, side="right")] if len(at_word) else at_word
    rolled = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(low) * powers(_ROLL, len(low)), dtype=np.uint64)])
    inverse = powers(_UNROLL, len(low) + 1)
    word = mix64((rolled[stop] - rolled[at_word]) * inverse[at_word])
    words = _different(number[at_word], word, len(starts) - 1)
    long = np.flatnonzero(stop - at_word >= RUN_TOGETHER)
    for k in long.tolist():
        if len(np.unique(low[at_word[k] : stop[k]])) >= DIFFERENT:
            words[number[at_word[k]]] += (stop[k] - at_word[k]) // 6
    is_dense = kind & 4 > 0
    dense = segment_sums(is_dense.astype(np.int64), starts)
    varied = _different(number[is_dense], low[is_dense].astype(np.uint64), len(starts) - 1)
    dense[varied < (CHARACTERS + 1) // 2] = 0
    doc = np.searchsorted(offsets, starts[:-1], side="right") - 1
    # n-grams of letters and single spaces; a run of other characters counts as one space
    spaced = np.where(letter, low, 32)
    useful = letter.copy()
    useful[1:] |= ~letter[1:] & letter[:-1]
    at = np.flatnonzero(useful)
    c, seg = spaced[at].astype(np.uint64), number[at]
    grams, owners = [c[c != 32] + np.uint64(1 << 40)], [seg[c != 32]]
    if len(c) > 1:
        same = seg[1:] == seg[:-1]
        two = c[:-1] << np.uint64(21) | c[1:]
        grams.append((two + np.uint64(2 << 50))[same])
        owners.append(seg[1:][same])
        if len(c) > 2:
            same3 = same[1:] & same[:-1]
            grams.append((mix64(two[:-1]) ^ (c[2:] * np.uint64(0x9E3779B97F4A7C15)))[same3])
            owners.append(seg[2:][same3])
    # each n-gram counts once a sentence, so that laughter of a hundred letters weighs as one of four
    hashed = mix64(np.concatenate(grams)) & np.uint64(BUCKETS - 1)
    packed = np.sort(np.concatenate(owners).astype(np.uint64) * np.uint64(BUCKETS) + hashed)
    fresh = np.ones(len(packed), dtype=bool)
    fresh[1:] = packed[1:] != packed[:-1]
    packed = packed[fresh]
    grams_of, owner = (packed & np.uint64(BUCKETS - 1)).astype(np.int32), (packed // np.uint64(BUCKETS)).astype(np.int64)
    bounds = np.searchsorted(owner, np.append(np.flatnonzero(keep), len(starts)))
    # owners are kept sentences only: a sentence without letters has no n-gram
    return Parts(doc[keep], starts[:-1][keep] - offsets[doc[keep]], starts[1:][keep] - offsets[doc[keep]], words[keep], dense[keep], grams_of, bounds)


def _only(p: Parts, keep: np.ndarray) -> Parts:
    """The sentences ``keep`` of ``p``."""
    sizes = np.diff(p.gram_bounds)
    chosen = np.zeros(len(sizes), dtype=bool)
    chosen[keep] = True
    bounds = np.concatenate([[0], np.cumsum(sizes[keep])])
    return Parts(p.doc[keep], p.start[keep], p.end[keep], p.words[keep], p.dense[keep], p.grams[np.repeat(chosen, sizes)], bounds)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages, float32

    def score(self, p: Parts) -> tuple[np.ndarray, np.ndarray]:
        """Best language (its number) and confidence of each sentence."""
        best, sure = np.zeros(len(p.doc), dtype=np.int64), np.zeros(len(p.doc))
        if not len(p.doc) or not self.languages:
            return best, sure
        sums = np.add.reduceat(self.log_p[p.grams], p.gram_bounds[:-1], axis=0).astype(np.float64)
        grams = np.maximum(np.diff(p.gram_bounds), 1)
        best = sums.argmax(axis=1)
        scaled = (sums - sums.max(axis=1, keepdims=True)) * (np.minimum(grams, EVIDENCE) / grams)[:, None]
        return best, 1.0 / np.exp(scaled).sum(axis=1)


def learn(texts: list[str], labels: np.ndarray, languages: Sequence[str], rounds: int = ROUNDS) -> Model:
    """A model from ``texts`` with a number of a language each; wrong labels are outvoted round by round."""
    pieces = []  # little is kept of each chunk of texts: the n-grams of its full sentences and their label
    for lo, hi in chunks(texts, SCORE_CHARS):
        p = parts(texts[lo:hi])
        keep = np.flatnonzero(p.full)
        pieces.append((_only(p, keep), labels[lo:hi][p.doc[keep]]))
    n = len(languages)
    model = Model(list(languages), np.zeros((BUCKETS, n), dtype=np.float32))
    for turn in range(rounds):
        table = np.zeros(BUCKETS * n)
        for p, target in pieces:
            use = np.ones(len(target), dtype=bool)
            if turn:
                target, sure = model.score(p)
                use = sure > 0.5
            of = np.repeat(np.where(use, target, -1), np.diff(p.gram_bounds))
            table += np.bincount(p.grams[of >= 0].astype(np.int64) * n + of[of >= 0], minlength=BUCKETS * n)
        smooth = table.reshape(BUCKETS, n) + 0.05
        model.log_p = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
    return model


def _named(label_col: str) -> Column:
    """A label in lower case without outer white space, by Unicode."""
    return F.lower(F.regexp_replace(label_col, r"(?U)^\s+|\s+$", ""))


def _said(label_col: str, names: dict[str, str]) -> Column:
    """The language that a label names, or null."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[_named(label_col)] if names else F.lit(None).cast("string")


def label_names(codes: DataFrame) -> dict[str, str]:
    """What a label may say (in lower case) and the language it then names; the table is small and fixed."""
    names = {}
    for language, iso in codes.select("language", "iso_code").collect():
        names |= {str(x).strip().lower(): language for x in (iso, language) if x and language}
    return names


def trained(rows: DataFrame, label_col: str, text_col: str, names: dict[str, str], most: int = TRAIN_ROWS) -> Model:
    """Learned from at most ``most`` rows whose label names a language, taken by hash, as many of each language as far as there are."""
    languages = sorted(set(names.values()))
    number = {k: i for i, k in enumerate(languages)}
    said = _said(label_col, names)
    got = [r for r in hash_sample(rows.select(said.alias("label"), F.col(text_col).alias("text")), most, "label") if r.text]
    return learn([r.text for r in got], np.array([number[r.label] for r in got], dtype=np.int64), languages)


def languages_of(rows: DataFrame, id_col: str, label_col: str, text_col: str, codes: DataFrame, most: int = TRAIN_ROWS, least: float = SURE) -> DataFrame:
    """``id, label, start, end, language, confidence, sentences, main, main_confidence``: the parts of each text, in one language each.

    Neighbouring sentences of one language form a part; those too short or unsure (under ``least``)
    to tell join the part before them, or after at the start. A text without a full sentence has one part with a null language and confidence 0, so null,
    empty and blank texts come out too. ``label`` is the language that the label names, or null. ``main`` is
    the language of most of the text's full sentences, by characters, and ``main_confidence`` how much
    of them it has, weighted by their confidence; a text's first part starts at 0, so the parts that
    start there are one row for each text.
    """
    spark = rows.sparkSession
    names = label_names(codes)
    model = spark.sparkContext.broadcast(trained(rows, label_col, text_col, names, most))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in chunks(texts, SCORE_CHARS):
                part = [t or "" for t in texts[lo:hi]]
                p = parts(part)
                best, sure = known.score(p)
                keep = np.flatnonzero(p.full & (sure >= least))
                doc, lang = p.doc[keep], best[keep]
                change = np.ones(len(keep), dtype=bool)
                change[1:] = (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])
                at = np.flatnonzero(change)
                sizes = (p.end - p.start)[keep].astype(float)
                bounds = np.append(at, len(keep))
                weight = segment_sums(sizes, bounds)
                confidence = segment_sums(sizes * sure[keep], bounds) / np.maximum(weight, 1)
                main, main_sure = _main(doc, lang, sizes, sure[keep], len(part), len(known.languages))
                sentences = np.diff(bounds)
                first = np.ones(len(at), dtype=bool)
                first[1:] = doc[at][1:] != doc[at][:-1]
                begin = np.where(first, 0, p.start[keep][at])
                length = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
                stop = length[doc[at]]
                stop[:-1] = np.where(first[1:], stop[:-1], begin[1:])
                none = np.setdiff1d(np.arange(len(part)), doc)
                owner = np.concatenate([doc[at], none])
                order = np.argsort(owner, kind="stable")
                pick = lambda a, b, order=order: np.concatenate([a, b])[order]
                zeros = np.zeros(len(none), dtype=np.int64)
                owned = owner[order]
                where = pa.array(owner[order] + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(where), batch["label"].take(where), pa.array(pick(begin, zeros)), pa.array(pick(stop, length[none])), _names(known.languages, pick(lang[at], zeros - 1)),
                     pa.array(pick(confidence, zeros.astype(float))), pa.array(pick(sentences, zeros)), _names(known.languages, main[owned]), pa.array(main_sure[owned])],
                    names=["id", "label", "start", "end", "language", "confidence", "sentences", "main", "main_confidence"],
                )

    slim = rows.select(F.col(id_col).alias("id"), _said(label_col, names).alias("label"), F.col(text_col).alias("text"))
    return spread(slim).mapInArrow(run, f"id {kind}, label string, start bigint, end bigint, language string, confidence double, sentences bigint, main string, main_confidence double")


def _names(languages: Sequence[str], number: np.ndarray) -> pa.Array:
    """The languages of the given numbers; null for a number below 0."""
    return pa.array(languages, pa.string()).take(pa.array(number, pa.int64(), mask=number < 0))


def _main(doc: np.ndarray, lang: np.ndarray, sizes: np.ndarray, sure: np.ndarray, docs: int, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language of most sentences of each document (-1: none), and its confidence."""
    main, confidence = np.full(docs, -1), np.zeros(docs)
    if len(doc):
        each = np.bincount(doc * languages + lang, weights=sizes, minlength=docs * languages).reshape(docs, languages)
        certain = np.bincount(doc * languages + lang, weights=sizes * sure, minlength=docs * languages).reshape(docs, languages)
        total = each.sum(axis=1)
        best = each.argmax(axis=1)
        main = np.where(total > 0, best, -1)
        confidence = certain[np.arange(docs), best] / np.maximum(total, 1)
    return main, confidence


def documents_of(parts: DataFrame) -> DataFrame:
    """``id, label, language, confidence`` of each text from its parts, null and empty ones included."""
    return parts.where("start = 0").select("id", "label", F.col("main").alias("language"), F.col("main_confidence").alias("confidence"))


def unlabelled(rows: DataFrame, id_col: str, label_col: str, text_col: str, codes: DataFrame, most: int = TRAIN_ROWS, least: float = SURE) -> DataFrame:
    """``id, language``: each language of a document that its label does not name, once. Ids that are null are left out."""
    found = languages_of(rows, id_col, label_col, text_col, codes, most, least)
    return found.where("id is not null and language is not null and (label is null or label <> language)").select("id", "language").distinct()
