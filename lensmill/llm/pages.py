"""Statistics of pages in batches: windows, words, lines, links and separators as flat numpy arrays.

All texts of a batch lie end to end; words, lines and windows are spans of that array, and what is
counted of them comes from sums over spans and from sorting hashes.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np

from lensmill.arrays import mix64, powers, segment_sums
from lensmill.llm.batch import codepoints

#: Characters of a window, about; a line is cut at spaces beyond one and a half of it.
WINDOW = 240
#: A short word has at most so many letters.
WORD_LETTERS = 4

_DENSE = "぀-ヿ㐀-鿿豈-﫿"
_WORD = re.compile(rf"[{_DENSE}]|(?:(?![{_DENSE}])[^\W\d_])+")
_URL = r"(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w.@])[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/[^\s<>\"')\]]*"
_LINK = re.compile(_URL)
_LABELLED = re.compile(rf"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\((?:{_URL})\)|{_URL}", re.S)
_SLASHED = re.compile(r"\.[a-z]{2,}/")
#: Characters that separate entries, and those that end a line.
_SEPARATORS, _BREAKS = ",/|•·»>#;\t", "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"
#: Words a line has at most whose end separates as well.
SHORT_LINE = 5
_LETTER, _IDEOGRAPH, _SPACE, _SEPARATOR, _BREAK = 1, 2, 4, 8, 16
_ROLL = 0x2545F4914F6CDD1D
_UNROLL = pow(_ROLL, -1, 1 << 64)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form of each code point, and its class bits."""
    low, kind = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            if not ch.isdecimal():
                kind[c] = _LETTER
            low[c] = ord(ch.lower()[0])
        elif ch.isspace():
            kind[c] = _SPACE
    for lo, hi in ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)):
        kind[lo : hi + 1] |= _IDEOGRAPH * (kind[lo : hi + 1] & _LETTER)
    for ch in _SEPARATORS:
        kind[ord(ch)] |= _SEPARATOR
    for ch in _BREAKS:
        kind[ord(ch)] |= _BREAK
    return low, kind


def spans(text: str) -> list[tuple[int, int]]:
    """Windows of about ``WINDOW`` characters, never across a blank line, that together make up the text."""
    out, start, at, long = [], -1, 0, WINDOW * 3 // 2
    lines = text.split("\n")
    for k, line in enumerate(lines):
        stop = at + len(line) + (k < len(lines) - 1)
        if not line or line.isspace():
            if start >= 0:
                out.append((start, stop))
                start = -1
        else:
            begin = at
            if start >= 0 and stop - start > long:
                out.append((start, at))
                start = -1
            while stop - begin > long:
                cut = text.rfind(" ", begin + WINDOW // 2, begin + WINDOW)
                cut = begin + WINDOW if cut < 0 else cut
                out.append((begin, cut))
                begin = cut
            if start < 0:
                start = begin
            if stop - start >= WINDOW:
                out.append((start, stop))
                start = -1
        at = stop
    return [*out, (start, len(text))] if start >= 0 else out


def has_links(text: str) -> bool:
    return "://" in text or "www." in text or "<a" in text or _SLASHED.search(text) is not None


def _mark_links(text: str, base: int, link: np.ndarray, linked: np.ndarray) -> int:
    """Mark in ``link`` the characters of addresses, and in ``linked`` those of links with their labels; a line of little else is marked whole. Gives the number of links."""
    for m in _LINK.finditer(text):
        link[base + m.start() : base + m.end()] = True
    count, at = 0, base
    for line in text.split("\n"):
        if "/" in line or "<a" in line or "www." in line:
            found = list(_LABELLED.finditer(line))
            if found:
                count += len(found)
                whole, plain = sum(m.end() - m.start() for m in found), sum(map(len, line.split()))
                if whole * 3 >= plain and len(_WORD.findall(_LABELLED.sub(" ", line))) <= 6 * len(found):
                    linked[at : at + len(line)] = True
                else:
                    for m in found:
                        linked[at + m.start() : at + m.end()] = True
        at += len(line) + 1
    return count


def _rolled(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(mix64(low) * powers(_ROLL, len(low)), dtype=np.uint64, out=total[1:])
    return total, powers(_UNROLL, len(low) + 1)


def _words(low: np.ndarray, kind: np.ndarray, begins: np.ndarray, masked: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word: a run of letters, or one ideograph. No word crosses a beginning or a masked character."""
    letter = (kind & _LETTER).astype(bool)
    if masked is not None:
        letter &= ~masked
    single = letter & (kind & _IDEOGRAPH > 0)
    plain = letter & ~single
    goes_on = np.zeros(len(low) + 1, dtype=bool)  # the same word as the character before
    goes_on[1:-1] = plain[1:] & plain[:-1] & ~begins[1:]
    start = np.flatnonzero(letter & ~goes_on[:-1])
    end = np.flatnonzero(letter & ~goes_on[1:]) + 1
    total, inverse = _rolled(low)
    return start, end, mix64((total[end] - total[start]) * inverse[start])


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes that ``_words`` gives these words, which hold nothing but letters."""
    flat, offsets = codepoints(words)
    total, inverse = _rolled(flat)
    return mix64((total[offsets[1:]] - total[offsets[:-1]]) * inverse[offsets[:-1]])


def _whole(texts: list[str | None]) -> list[str]:
    return [(t.replace("\r\n", "\n") if "\r" in t else t) if t else "" for t in texts]


def short_words(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The different short words of each text outside its links: text number, and number in the list of words; and that list."""
    texts = _whole(texts)
    flat, offsets = codepoints(texts)
    low_of, kind_of = _tables()
    low, kind = low_of[flat], kind_of[flat]
    begins = np.zeros(len(flat) + 1, dtype=bool)
    begins[offsets[:-1]] = True
    masked = None
    for k, t in enumerate(texts):
        if has_links(t):
            masked = np.zeros(len(flat), dtype=bool) if masked is None else masked
            for m in _LINK.finditer(t):
                masked[offsets[k] + m.start() : offsets[k] + m.end()] = True
    start, end, h = _words(low, kind, begins[:-1], masked)
    short = end - start <= WORD_LETTERS
    start, end, h = start[short], end[short], h[short]
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    words = ["".join(map(chr, low[a:b].tolist())) for a, b in zip(start[first].tolist(), end[first].tolist())]
    doc = np.searchsorted(offsets, start, side="right") - 1
    pairs = np.unique(doc * max(1, len(words)) + number)
    return pairs // max(1, len(words)), words, pairs % max(1, len(words))


@dataclass
class Lexicon:
    """Short words by hash: which are function words of a language, and which the language's documents know at all."""

    languages: list[str]
    hashes: np.ndarray  # sorted
    function: np.ndarray  # words x languages
    known: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's word; the number of words if it has none."""
        at = np.searchsorted(self.hashes, h)
        near = np.minimum(at, max(0, len(self.hashes) - 1))
        return np.where(self.hashes[near] == h, near, len(self.hashes)) if len(self.hashes) else np.full(len(h), 0)


def _different(owner: np.ndarray, h: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different (owner, hash): its owner and its number; owners are few enough for 20 bits. And different ones by owner."""
    packed, counts = np.unique(owner.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20), return_counts=True)
    of = (packed >> np.uint64(44)).astype(np.int64)
    return of, counts, np.bincount(of, minlength=owners)


@dataclass
class Pages:
    """Statistics of the windows of a batch, end to end, and of its documents."""

    windows: np.ndarray  # of each document
    size: np.ndarray  # visible characters
    words: np.ndarray
    language: np.ndarray  # the language most of whose function words it has
    function: np.ndarray  # share of words that are function words of that language
    strange: np.ndarray  # no language knows half of its short words
    content: np.ndarray  # other words
    variety: np.ndarray  # different content words a content word
    repeated: np.ndarray  # share of bigrams that occur again
    separators: np.ndarray  # a word
    link_share: np.ndarray  # of links and their labels
    links: np.ndarray  # of each document
    top: np.ndarray  # share of its most frequent content word
    again: np.ndarray  # share of its text in lines said before


def measure(texts: list[str | None], lexicon: Lexicon, strange_words: int = 8, known_share: float = 0.5) -> Pages:
    """Statistics of the windows of ``texts``, whole; null is as empty."""
    texts = _whole(texts)
    flat, offsets = codepoints(texts)
    low_of, kind_of = _tables()
    low, kind = low_of[flat], kind_of[flat]
    n = len(flat)
    cuts = [spans(t) for t in texts]
    per_doc = np.fromiter(map(len, cuts), dtype=np.int64, count=len(texts))
    doc = np.repeat(np.arange(len(texts)), per_doc)
    opens = np.fromiter((a for c in cuts for a, _ in c), dtype=np.int64, count=len(doc)) + offsets[doc]
    many = len(doc)
    bounds = np.append(opens, n)
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets[:-1]] = True
    begins[opens] = True
    begins = begins[:-1]
    link, linked, links = None, None, np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        if has_links(t):
            if link is None:
                link, linked = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            links[k] = _mark_links(t, int(offsets[k]), link, linked)
    space = kind & _SPACE > 0
    visible = ~space
    size = segment_sums(visible.astype(np.int64), bounds)
    link_share = (segment_sums((linked & visible).astype(np.int64), bounds) if linked is not None else np.zeros(many)) / np.maximum(size, 1)

    # words
    start, end, h = _words(low, kind, begins, link)
    of = np.searchsorted(opens, start, side="right") - 1
    if len(of) and of.min() < 0:  # no word lies before the first window
        keep = of >= 0
        start, end, h, of = start[keep], end[keep], h[keep], of[keep]
    words = np.bincount(of, minlength=many)
    word_bounds = np.concatenate([[0], np.cumsum(words)])
    at = lexicon.find(h)
    many_languages = len(lexicon.languages)
    if many_languages:
        rows = lambda m: np.concatenate([m, np.zeros((1, many_languages), dtype=m.dtype)])[at]
        add = lambda m: np.diff(np.concatenate([np.zeros((1, many_languages), dtype=np.int64), np.cumsum(m, axis=0, dtype=np.int64)])[word_bounds], axis=0)
        hits = add(rows(lexicon.function))
        language = hits.argmax(axis=1)
        function = hits[np.arange(many), language] / np.maximum(words, 1)
        is_function = np.append(lexicon.function.any(axis=1), False)[at]
        # each short word once: a name said again and again is no language
        short = np.flatnonzero(end - start <= WORD_LETTERS)
        packed, first = np.unique(of[short].astype(np.uint64) << np.uint64(44) | h[short] >> np.uint64(20), return_index=True)
        owner = (packed >> np.uint64(44)).astype(np.int64)
        different_short = np.bincount(owner, minlength=many)
        told = np.concatenate([lexicon.known, np.zeros((1, many_languages), dtype=bool)])[at[short[first]]]
        best = np.stack([np.bincount(owner, weights=told[:, k], minlength=many) for k in range(many_languages)]).max(axis=0)
        strange = (different_short >= strange_words) & (best < known_share * different_short)
    else:
        language, function, is_function, strange = np.zeros(many, dtype=np.int64), np.zeros(many), np.zeros(len(h), dtype=bool), np.zeros(many, dtype=bool)
    other = ~is_function
    _, _, different = _different(of[other], h[other], many)
    content = np.bincount(of[other], minlength=many)
    variety = np.where(content > 0, different / np.maximum(content, 1), 1.0)
    pair = np.flatnonzero(of[1:] == of[:-1])
    pair_of, pair_count, _ = _different(of[pair], mix64(h[pair] + mix64(h[pair + 1])), many)
    repeated = np.bincount(pair_of, weights=np.where(pair_count > 1, pair_count, 0), minlength=many) / np.maximum(words - 1, 1)
    word_doc = doc[of]
    top_of, top_count, _ = _different(word_doc[other], h[other], len(texts))
    top = np.zeros(len(texts))
    np.maximum.at(top, top_of, top_count)
    top /= np.maximum(np.bincount(word_doc, minlength=len(texts)), 1)

    # separators: the ends of short lines, and separating characters elsewhere
    newline = flat == 10
    line = begins.copy()
    line[1:] |= newline[:-1]
    line_at = np.flatnonzero(line)
    line_bounds = np.append(line_at, n)
    shown = visible & ~link if link is not None else visible
    token = shown.copy()
    token[1:] &= ~shown[:-1] | line[1:]
    tokens = segment_sums(token.astype(np.int64), line_bounds)
    mark = (kind & _SEPARATOR > 0) & (~link if link is not None else True)
    marks = segment_sums(mark.astype(np.int64), line_bounds)
    odd = segment_sums((space & (flat != 32) & ~newline).astype(np.int64), line_bounds)
    ended = newline[line_bounds[1:] - 1] if n else np.zeros(0, dtype=bool)
    one = (tokens >= 1) & (tokens <= SHORT_LINE) & shown[line_at] & ~mark[line_at] & (odd == 0) & ended
    line_of = np.searchsorted(opens, line_at, side="right") - 1
    inside = line_of >= 0
    separators = np.bincount(line_of[inside], weights=np.where(one, 1, marks)[inside], minlength=many) / np.maximum(words, 1)
    separators[words == 0] = 0.0
    return Pages(per_doc, size, words, language, function, strange, content, variety, repeated, separators, link_share, links, top, _again(low, kind, offsets))


def _again(low: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each text, by visible characters, in lines that were said before in it; case and spaces do not matter."""
    n = len(low)
    texts = len(offsets) - 1
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets[:-1]] = True
    begins = begins[:-1]
    begins[1:] |= kind[:-1] & _BREAK > 0
    shown = np.flatnonzero(kind & _SPACE == 0)
    bounds = np.searchsorted(shown, np.append(np.flatnonzero(begins), n))
    total, inverse = _rolled(low[shown])
    a, b = bounds[:-1], bounds[1:]
    filled = b > a
    a, b = a[filled], b[filled]
    if not len(a):
        return np.zeros(texts)
    doc = np.searchsorted(offsets, shown[a], side="right") - 1
    h = mix64((total[b] - total[a]) * inverse[a] ^ mix64((b - a).astype(np.uint64)))
    order = np.lexsort((np.arange(len(h)), h, doc))
    seen = np.zeros(len(h), dtype=bool)
    seen[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    size = (b - a).astype(float)
    return np.bincount(doc, weights=size * seen, minlength=texts) / np.maximum(np.bincount(doc, weights=size, minlength=texts), 1)


def said_again(text: str) -> float:
    """``Pages.again`` of one text."""
    flat, offsets = codepoints([text])
    low, kind = _tables()
    return float(_again(low[flat], kind[flat], offsets)[0])
