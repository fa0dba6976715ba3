"""Pages made of keywords, tags, product names or links in place of sentences.

A document is cut into windows of about a sentence or two, never across a blank line. A window is
spam by thresholds on its link-text ratio, its share of function words, its separator density, its
share of repeated bigrams and how few different words it has. Over the whole document, the share of
lines said before and that of its top word find what no window can see: one long line said again and
again. The function words and all thresholds come from the corpus itself, language by language: from
document frequencies and from the median document of each language, counted over all documents. A
document is spam if more than half of its text lies in such windows or lines.

A window cannot be told by its function words where the language has none, or where no language
knows half of the window's short words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.llm.batch import chunks
from lensmill.llm.pages import Lexicon, measure, said_again, short_words, spans, word_hashes  # noqa: F401
from lensmill.shared import cut, spread

#: A function word is in this share of its language's documents; single characters of dense scripts need more.
COMMON, COMMON_DENSE = 0.3, 0.7
#: Share of a language's documents that a short word is in to be known there, and different short words of a window from which it can be strange.
KNOWN, STRANGE_WORDS = 0.002, 8
#: Documents that a known word is in at least, so that a few wrongly labelled ones teach nothing.
KNOWN_DOCUMENTS = 3
#: Documents from which a language's own counts are used.
LANGUAGE_DOCUMENTS = 20
#: Thresholds as parts of the language's median window: function words alone; with many separators; variety of words.
FEW_FUNCTION, FEW_WITH_SEPARATORS, LITTLE_VARIETY = 0.36, 0.62, 0.43
#: Separators a word that count as many, at least and as a multiple of the language's median.
MANY_SEPARATORS, SEPARATOR_MULTIPLE = 0.16, 2.0
#: Times as many are needed where a window cannot be told by its function words.
SEPARATORS_ALONE = 1.5
#: Share of links and their labels in a window of links, at least and as a multiple of the language's median.
LINKS, LINK_MULTIPLE = 0.6, 2.0
#: Share of repeated bigrams that backs little variety, at least and as a multiple of the language's median.
REPEATED, REPEATED_MULTIPLE = 0.35, 3.0
#: Share of the text that must be spam, and words or links below which a text is too short to tell.
FOUND, LEAST_WORDS, LEAST_LINKS = 0.5, 8, 2
#: A document whose lines said before make up ``FOUND`` of it is spam if its top content word has so many times the share it has in the median document of the language.
TOP_MULTIPLE = 2.0
#: Bins of the histograms from which medians are read; top words have small shares and wider bins.
BINS, TOP_SCALE = 200, 5
#: Characters of which one batch of arrays is made.
AT_ONCE = 200_000


def windows(text: str) -> list[str]:
    """The text in its windows."""
    return [text[a:b] for a, b in spans(text)]


@dataclass
class Thresholds:
    function: list[float]
    with_separators: list[float]
    separators: list[float]
    variety: list[float]
    top: list[float]
    repeated: list[float]
    links: list[float]


#: What is kept of each window, and the type of its column; a window takes some 40 bytes.
_KEPT = {"size": np.int32, "words": np.int32, "language": np.int32, "content": np.int32, "function": np.float32, "variety": np.float32, "repeated": np.float32, "separators": np.float32, "link_share": np.float32}


def spam_windows(w: dict[str, np.ndarray], t: Thresholds) -> np.ndarray:
    """Which of the windows are spam; ``w`` has an array for each statistic.

    Where a window cannot be told by function words, no rule asks for them, and separators must stand out more.
    """
    at = lambda name: np.array(getattr(t, name))[w["language"]]
    known = w["language"] < len(t.function) - 1
    few = (w["function"] < at("function")) & ((w["function"] * 1.5 < at("function")) | (w["variety"] < 2 * at("variety")) | (w["separators"] >= at("separators")))
    listed = np.where(known, w["function"] < at("with_separators"), w["separators"] >= SEPARATORS_ALONE * at("separators")) & (w["separators"] >= at("separators"))
    same = (w["content"] >= 12) & (w["variety"] < at("variety")) & (w["repeated"] >= at("repeated"))
    return (w["link_share"] >= at("links")) | (w["words"] >= 3) & (known & few | listed | same)


def _clean(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lang = F.lower(F.trim(F.col(lang_col)))
    return spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.when(lang.rlike("^[a-z]{2}$"), lang).alias("lang")))


def _short_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each language a short word is in, and under '' how many there are, added up for each batch."""
    for batch in batches:
        counts: Counter = Counter()
        texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
        for lo, hi in chunks(texts, AT_ONCE):
            part = [t if lang else None for t, lang in zip(texts[lo:hi], langs[lo:hi])]
            counts.update((lang, "") for t, lang in zip(part, langs[lo:hi]) if t)
            doc, words, number = short_words(part)
            names = sorted({lang for lang in langs[lo:hi] if lang})
            place = {k: i for i, k in enumerate(names)}
            own = np.array([place.get(lang, 0) for lang in langs[lo:hi]], dtype=np.int64)[doc]
            keys, n = np.unique(own * max(1, len(words)) + number, return_counts=True)
            for key, k in zip(keys.tolist(), n.tolist()):
                counts[names[key // len(words)], words[key % len(words)]] += k
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "word", "n"])


def lexicon_of(slim: DataFrame) -> Lexicon:
    """Function words and known short words of each language.

    Documents hold some tens of different short words each, so some thousands a language can be in
    ``KNOWN`` of its documents, and language codes have two letters: the result is small.
    """
    counts = cut(slim.mapInArrow(_short_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counts.where("word = ''").select("lang", F.col("n").alias("total")).where(F.col("total") >= LANGUAGE_DOCUMENTS)
    dense = F.col("word").rlike(r"^[぀-ヿ㐀-鿿]$")
    common = F.col("n") >= F.col("total") * F.when(dense, COMMON_DENSE).otherwise(COMMON)
    rows = counts.where("word <> ''").join(F.broadcast(totals), "lang").where((F.col("n") >= F.col("total") * KNOWN) & (F.col("n") >= KNOWN_DOCUMENTS)).select("lang", "word", common.alias("function")).collect()
    languages = sorted({r.lang for r in rows if r.function})
    number = {k: i for i, k in enumerate(languages)}
    words = sorted({r.word for r in rows})
    place = {w: i for i, w in enumerate(words)}
    function, known = (np.zeros((len(words), len(languages)), dtype=bool) for _ in range(2))
    for r in rows:
        if r.lang in number:
            known[place[r.word], number[r.lang]] = True
            function[place[r.word], number[r.lang]] = r.function
    hashes = word_hashes(words)
    order = np.argsort(hashes)
    return Lexicon(languages, hashes[order], function[order], known[order])


def measured(slim: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``id, n_words, n_links, top, again`` of each document and the statistics of its windows as arrays. Cut: it is read twice."""
    known = set(lexicon.languages)
    sent = slim.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
            for lo, hi in chunks(texts, AT_ONCE):
                p = measure(texts[lo:hi], words, STRANGE_WORDS)
                foreign = np.array([bool(lang) and lang not in known for lang in langs[lo:hi]], dtype=bool)
                p.language = np.where(np.repeat(foreign, p.windows) | p.strange, len(words.languages), p.language)
                ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(p.windows)])
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(getattr(p, name).astype(kind))) for name, kind in _KEPT.items()]
                total = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(p.words)])
                flat = [pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()), pa.array(p.links), pa.array(p.top.astype(np.float32)), pa.array(p.again.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), *flat, *lists], names=["id", "n_words", "n_links", "top", "again", *_KEPT])

    kind = slim.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{name} array<{'int' if t is np.int32 else 'float'}>" for name, t in _KEPT.items())
    return cut(slim.mapInArrow(run, f"id {kind}, n_words bigint, n_links bigint, top float, again float, {columns}"))


def _windows_of(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The statistics of all windows of a batch end to end, and the number of the document each belongs to."""
    sizes = batch["size"].value_lengths().to_numpy(zero_copy_only=False)
    return {name: batch[name].flatten().to_numpy() for name in _KEPT}, np.repeat(np.arange(batch.num_rows), sizes)


def thresholds(table: DataFrame, languages: list[str]) -> Thresholds:
    """Thresholds of each language from its median document.

    A document counts once, with the means of its windows of at least 12 words, under the language
    most of them are in, and its top word with its share of the whole; so a few endless pages do not move the medians.
    """
    names = ("function", "separators", "variety", "top", "repeated", "link_share")
    many = len(languages) + 1  # the last: documents of languages without function words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((many, len(names), BINS), dtype=np.int64)
        for batch in batches:
            w, doc = _windows_of(batch)
            plain = (w["words"] >= 12) & (w["link_share"] < LINKS)
            key, inverse, n = np.unique(doc[plain] * many + w["language"][plain], return_inverse=True, return_counts=True)
            order = np.lexsort((key, -n, key // many))  # the language of most windows first, of each document
            first = np.ones(len(order), dtype=bool)
            first[1:] = key[order][1:] // many != key[order][:-1] // many
            chosen = order[first]
            for k, name in enumerate(names):
                if name == "top":
                    mean = batch["top"].to_numpy()[key[chosen] // many] * TOP_SCALE
                else:
                    mean = np.bincount(inverse, weights=w[name][plain], minlength=len(key))[chosen] / n[chosen]
                np.add.at(counts, (key[chosen] % many, k, np.minimum(BINS - 1, (mean * BINS).astype(np.int64))), 1)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in at), pa.array(counts[at], pa.int64())], names=["language", "what", "bin", "n"])

    added = table.mapInArrow(run, "language bigint, what bigint, bin bigint, n bigint").groupBy("language", "what", "bin").agg(F.sum("n").alias("n"))
    hist = np.zeros((many, len(names), BINS))
    for r in added.collect():
        hist[r.language, r.what, r.bin] = r.n
    total = hist.sum(axis=2)
    overall = hist.sum(axis=0)
    hist = np.where((total >= LANGUAGE_DOCUMENTS)[:, :, None], hist, overall[None])
    half = np.cumsum(hist, axis=2) * 2 >= hist.sum(axis=2, keepdims=True)
    median = (half.argmax(axis=2) + 0.5) / BINS
    f, s, v, top, repeated, links = median.T
    f[-1] = 0.0
    floors = (np.maximum(MANY_SEPARATORS, SEPARATOR_MULTIPLE * s), LITTLE_VARIETY * v, TOP_MULTIPLE * top / TOP_SCALE, np.clip(REPEATED_MULTIPLE * repeated, REPEATED, 1), np.clip(LINK_MULTIPLE * links, LINKS, 1))
    return Thresholds((FEW_FUNCTION * f).tolist(), (FEW_WITH_SEPARATORS * f).tolist(), *(x.tolist() for x in floors))


def scored(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``<id_col>, spam_share, words, links``: how much of each text lies in spam windows, or in
    lines said before if these make up most of it and a top word stands out.

    Null, empty and blank texts have share 0, as have texts too short to tell. Every row comes out,
    repeated and null ids included. A null or unusual language label does no harm: the language of
    each window is that of the function words it has. Documents whose label names a language with
    too few documents for function words, and windows whose short words no language knows, are
    judged by separators, links and variety alone. Texts are read twice: for the function words
    and for the statistics of windows, from which both thresholds and decisions are made.
    """
    slim = _clean(documents, id_col, text_col, lang_col)
    lexicon = lexicon_of(slim)
    table = measured(slim, lexicon)
    limits = thresholds(table, lexicon.languages)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, doc = _windows_of(batch)
            size = np.bincount(doc, weights=w["size"], minlength=batch.num_rows)
            bad = np.bincount(doc, weights=w["size"] * spam_windows(w, limits), minlength=batch.num_rows)
            enough = (batch["n_words"].to_numpy() >= LEAST_WORDS) | (batch["n_links"].to_numpy() >= LEAST_LINKS)
            share = bad / np.maximum(size, 1)
            again, by_language = batch["again"].to_numpy(), np.zeros((batch.num_rows, len(limits.top)))
            np.add.at(by_language, (doc, w["language"]), w["words"])
            stuffed = (again > FOUND) & (batch["top"].to_numpy() >= np.array(limits.top)[by_language.argmax(axis=1)])
            share = np.where(enough & (size > 0), np.where(stuffed, np.maximum(share, again), share), 0.0)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(share), batch["n_words"], batch["n_links"]], names=["id", "spam_share", "words", "links"])

    return table.mapInArrow(run, f"id {kind}, spam_share double, words bigint, links bigint").withColumnRenamed("id", id_col)


def spam_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``<id_col>`` of every document more than half of whose text is keywords, tags, names or links."""
    return scored(documents, id_col, text_col, lang_col).where(F.col("spam_share") > FOUND).select(id_col).distinct()
