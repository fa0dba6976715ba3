"""The share of a document that repeats itself.

A document is reduced to its letters. A letter stands in a repeat if it is covered by a run of
letters that began before at an earlier place in the same document; the first occurrence does not
count. Boosted trees with monotonic constraints give that share from statistics of whole batches;
they are trained on texts whose share is measured exactly, which needs a loop over every letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.llm import gbt
from lensmill.llm.batch import chunks, codepoints, hash_sample, mix64, powers, segment_sums
from lensmill.shared import spread

#: Documents with fewer letters have no share worth measuring: theirs is null.
LEAST_LETTERS = 30
#: Length in letters of a run that counts as a repeat, and in scripts without spaces.
RUN, RUN_DENSE = 12, 6
#: Rows the trees are trained on at most (as many again are made from them).
TRAIN_ROWS = 4_000
#: Characters of a text that is trained on at most: measuring one takes memory for each letter. Texts of any length are scored.
TRAIN_CHARS = 50_000
#: Made texts there are at least, so that a small table trains as good trees, and words of a text that one is made of.
MADE_ROWS, MADE_WORDS = 2_000, 400
#: Share from which a document is repetitive.
FOUND = 0.5
#: Window lengths of the statistics, and the direction in which each statistic may move the estimate.
WINDOWS = (4, 6, 12, 24)
MONOTONE = [1, 1, 1, 1, -1, 0, 0]


def _letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0: digits, spaces, marks and punctuation do not matter."""
    global _LETTERS
    if _LETTERS is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
        _LETTERS = table
    return _LETTERS


_LETTERS: np.ndarray | None = None


def _dense(letters: np.ndarray) -> np.ndarray:
    """Whether a letter belongs to a script written without spaces (kana and ideographs)."""
    return ((letters >= 0x3040) & (letters <= 0x30FF)) | ((letters >= 0x3400) & (letters <= 0x9FFF)) | ((letters >= 0x20000) & (letters <= 0x3FFFF))


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of statistics for each text, and its number of letters.

    For each window length the share of letters covered by windows seen before in the text; the
    share of distinct pairs of letters; the logarithm of the length; the share of dense script.
    """
    flat, offsets = codepoints(texts)
    letters = _letter_table()[flat]
    kept = np.flatnonzero(letters)
    s = letters[kept]
    bounds = np.searchsorted(kept, offsets)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), count)
    left = np.repeat(bounds[1:], count) - np.arange(len(s))
    safe = np.maximum(count, 1)
    rolled = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(s) * powers(0x2545F4914F6CDD1D, len(s)), dtype=np.uint64)])
    inverse = powers(pow(0x2545F4914F6CDD1D, -1, 1 << 64), len(s))
    salt = mix64(doc.astype(np.uint64) + np.uint64(0x51ED27))
    columns = []

    def seen_before(width: int) -> tuple[np.ndarray, np.ndarray]:
        # hash above, place below: one sort of plain integers brings equal windows together in order
        at = np.flatnonzero(left >= width)
        low = np.uint64(max(1, len(at)).bit_length())
        h = mix64((rolled[at + width] - rolled[at]) * inverse[at] ^ salt[at])
        packed = np.sort((h >> low) << low | np.arange(len(at), dtype=np.uint64))
        repeat = np.zeros(len(at), dtype=bool)
        again = packed[1:][packed[1:] >> low == packed[:-1] >> low]
        repeat[(again & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)] = True
        return at, repeat

    for width in WINDOWS:
        at, repeat = seen_before(width)
        edge = np.zeros(len(s) + 1, dtype=np.int32)
        edge[at[repeat]] = 1
        edge[at[repeat] + width] -= 1
        columns.append(segment_sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), bounds) / safe)
    at, repeat = seen_before(2)
    fresh = np.zeros(len(s), dtype=np.int64)
    fresh[at[~repeat]] = 1
    columns.append(segment_sums(fresh, bounds) / safe)
    columns.append(np.log1p(count))
    columns.append(segment_sums(_dense(s).astype(np.int64), bounds) / safe)
    return np.stack(columns, axis=1), count


def exact_share(text: str) -> float | None:
    """Share of the letters of ``text`` that are covered by runs begun earlier; null under ``LEAST_LETTERS``.

    >>> exact_share("one two three four five six seven") or exact_share("lol " * 30)
    0.9666666666666667
    """
    table = _letter_table()
    letters = table[np.fromiter(map(ord, text), dtype=np.int64, count=len(text))] if text else np.zeros(0, dtype=np.uint32)
    letters = letters[letters > 0]
    n = len(letters)
    if n < LEAST_LETTERS:
        return None
    width = RUN_DENSE if _dense(letters).mean() > 0.5 else RUN
    s = "".join(map(chr, letters.tolist()))
    seen: set[str] = set()
    covered = until = 0
    for i in range(n - width + 1):
        run = s[i : i + width]
        if run in seen:
            covered += i + width - max(i, until)
            until = i + width
        else:
            seen.add(run)
    return covered / n


def _made(texts: list[str], least: int = MADE_ROWS) -> list[str]:
    """Texts that repeat parts of ``texts`` to various degrees, so that the trees see every share: one of each, and ``least`` at least."""
    rng = np.random.default_rng(5)
    worded = [w for t in texts if (w := t.split())]
    out = []
    for i in range(max(len(worded), least) if worded else 0):
        words = worded[i % len(worded)]
        start = int(rng.integers(0, max(1, len(words) - MADE_WORDS + 1)))
        words = words[start : start + MADE_WORDS]
        unit = words[: max(1, int(rng.integers(1, 12)))]
        times = int(rng.choice([1, rng.integers(2, 12), rng.integers(12, 60)], p=[0.2, 0.65, 0.15]))
        tail = words[: int(rng.integers(0, len(words) + 1))]
        parts = [" ".join(unit) + (f" {i}." if rng.random() < 0.3 else ".") for i in range(times)]
        out.append(" ".join(parts + tail) if rng.random() < 0.5 else " ".join(tail + parts))
    return out


def trained(rows: DataFrame, text_col: str, most: int = TRAIN_ROWS) -> gbt.Trees:
    """Trees for the share of repeated letters, trained on at most ``most`` texts (taken by hash) and as many made ones."""
    texts = [r[0] for r in hash_sample(rows.select(text_col), most, only=F.length(text_col) <= TRAIN_CHARS) if r[0]]
    texts += _made(texts)
    labelled = [(t, share) for t in texts if (share := exact_share(t)) is not None]
    x, _ = statistics([t for t, _ in labelled])
    return gbt.train(x, np.array([share for _, share in labelled]), MONOTONE)


def repetition(rows: DataFrame, id_col: str, text_col: str, most: int = TRAIN_ROWS) -> DataFrame:
    """``id, share``: for each row the share of its letters that stand in repeats, by the trees.

    Null texts and those under 30 letters have a null share. Rows are kept one by one, repeated ids
    and null ids included. Every letter of a text goes into its statistics, however long it is.
    """
    spark = rows.sparkSession
    trees = spark.sparkContext.broadcast(trained(rows, text_col, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trees.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in chunks(texts):
                x, letters = statistics([t or "" for t in texts[lo:hi]])
                shares = pa.array(np.clip(known.score(x), 0, 1), pa.float64(), mask=letters < LEAST_LETTERS)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), shares], names=["id", "share"])

    kind = rows.schema[id_col].dataType.simpleString()
    slim = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(slim).mapInArrow(run, f"id {kind}, share double")


def repetitive(rows: DataFrame, id_col: str, text_col: str, found: float = FOUND) -> DataFrame:
    """``id`` of every document of which a share of ``found`` or more repeats itself, once each."""
    return repetition(rows, id_col, text_col).where(F.col("share") >= found).select("id").distinct()
