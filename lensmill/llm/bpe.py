"""Encoding a corpus with a public byte-level BPE vocabulary.

Texts are cut into pre-tokens by arrays of character classes, all texts of a batch at once. Two tiers
then: whole pre-tokens that are in the vocabulary are resolved through a minimal perfect hash; the
others are merged with a heap over linked bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.arrays import hash_spans
from lensmill.llm.batch import chunks, codepoints, mix64, segment_sums
from lensmill.shared import spread

#: Where the public tokenizers lie, and the vocabulary used unless another is named.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Misses a worker remembers; only saves time.
MEMO = 200_000
_BASE = 0x9E3779B97F4A7C15 | 1
#: Endings that stay with an apostrophe before them, of one letter and of two.
_ENDINGS, _LONG_ENDINGS = "stmd", ("re", "ve", "ll")
_LETTER, _NUMBER, _SPACE = 1, 2, 3


@functools.cache
def character_classes() -> np.ndarray:
    """Class of each code point as ``PATTERN`` sees it: letter, number, white space, or 0."""
    table = np.zeros(0x110000, dtype=np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            table[m.start() : m.end()] = kind
    return table


def pretoken_starts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a pre-token of ``PATTERN`` starts at each code point of texts that lie end to end.

    A pre-token is a run of one class. Of a run of white space that something follows, the last
    character stands alone, and if that is a blank it opens the run that follows. A lone apostrophe
    without a blank before it takes its ending with it.
    """
    n = len(flat)
    kind = character_classes()[flat]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets[:-1]] = True
    begins[n] = True
    run = begins[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = flat[:-1] == 32
    blank_before &= ~begins[:-1]
    space = kind == _SPACE
    last = space & ~begins[1:]  # the last white space before something else
    last[:-1] &= ~space[1:]
    starts = run & (space | ~blank_before) | last
    next_run = np.append(run[1:], True)
    mark = np.flatnonzero((flat == 39) & starts & next_run & ~begins[1:])
    if len(mark):
        ahead = np.concatenate([flat, np.zeros(3, dtype=flat.dtype)])
        inside = np.concatenate([~run & (kind == _LETTER), np.zeros(3, dtype=bool)])  # goes on with the same letters
        one, two = ahead[mark + 1], ahead[mark + 2]
        single = np.isin(one, [ord(c) for c in _ENDINGS])
        double = inside[mark + 2] & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in _LONG_ENDINGS])
        starts[mark[single | double] + 1] = False
        for which, size in ((single, 2), (double, 3)):
            at = mark[which] + size
            starts[at[inside[at]]] = True
    return starts


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: n keys, n slots, one displacement per bucket.

    >>> h = PerfectHash(mix64(np.arange(1000, dtype=np.uint64))); sorted(h.slots(mix64(np.arange(1000, dtype=np.uint64))).tolist()) == list(range(1000))
    True
    """

    def __init__(self, keys: np.ndarray, per_bucket: int = 4):
        self.n = len(keys)
        self.buckets = max(1, self.n // per_bucket)
        self.displace = np.zeros(self.buckets, dtype=np.int64)
        if len(np.unique(keys)) != self.n:
            raise ValueError("the keys of a perfect hash must be distinct")
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(self.n, dtype=bool)
        sizes = np.diff(bounds)
        for b in np.argsort(-sizes, kind="stable"):
            own = keys[order[bounds[b] : bounds[b + 1]]]
            if len(own) < 2:
                break
            d, width = 1, 4
            while not self.displace[b]:
                tries = np.arange(d, d + width, dtype=np.uint64)
                slots = (mix64(own[None, :] ^ (tries * np.uint64(_BASE))[:, None]) % np.uint64(self.n)).astype(np.int64)
                for k in np.flatnonzero(free[slots].all(axis=1)).tolist():
                    if len(set(slots[k].tolist())) == len(own):
                        self.displace[b] = d + k
                        free[slots[k]] = False
                        break
                d, width = d + width, min(width * 4, 1024)
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1):
            self.displace[b] = -1 - next(left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(keys), dtype=np.int64)
        d = self.displace[(keys % np.uint64(self.buckets)).astype(np.int64)]
        moved = mix64(keys ^ (np.maximum(d, 0).astype(np.uint64) * np.uint64(_BASE))) % np.uint64(self.n)
        return np.where(d < 0, -1 - d, moved.astype(np.int64))


class Encoder:
    """A byte-level BPE encoder over a rank file (token in base64, rank) whose texts are split by ``PATTERN``."""

    def __init__(self, rank_file: bytes):
        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        tokens = list(self.ranks)
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        keys = hash_spans(data, ends - lengths, ends)
        self.perfect = PerfectHash(keys)
        slot = self.perfect.slots(keys)
        self.data = data
        self.start, self.length, self.id = (np.zeros(len(tokens), dtype=np.int64) for _ in range(3))
        self.start[slot], self.length[slot], self.id[slot] = ends - lengths, lengths, list(self.ranks.values())
        self.memo: dict[bytes, list[int]] = {}

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token: merge the lowest-ranked pair, leftmost first, until none is left.

        Adjacent pairs wait in a heap; the bytes are a doubly linked list of spans, so a merge costs
        a logarithm even in a pre-token of millions of bytes. Stale heap entries are recognised by
        the ends they recorded.
        """
        ranks, n = self.ranks, len(token)
        if token in ranks:
            return [ranks[token]]
        end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and end[i] == j and end[j] == stop):
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            k = after[i]
            if k < n:
                before[k] = i
                r = ranks.get(token[i : end[k]])
                if r is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            h = before[i]
            if h >= 0:
                r = ranks.get(token[h:stop])
                if r is not None:
                    heapq.heappush(heap, (r, h, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = after[i]
        return out

    def _miss(self, token: bytes) -> list[int]:
        ids = self.memo.get(token)
        if ids is None:
            ids = self.merge(token)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(token) < 64:
                self.memo[token] = ids
        return ids

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids start (plus the end); null is as empty."""
        texts = [t or "" for t in texts]
        flat, offsets = codepoints(texts)
        if not len(flat):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        at = np.flatnonzero(pretoken_starts(flat, offsets))
        width = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
        place = np.cumsum(width)
        data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        starts = place[at] - width[at]
        ends = np.append(starts[1:], len(data))
        lengths = ends - starts
        keys = hash_spans(data, starts, ends)
        slot = self.perfect.slots(keys)
        hit = self.length[slot] == lengths
        # compare the bytes of what the hash names, so that a foreign pre-token is never taken for a known one
        known = np.flatnonzero(hit)
        hit[known] = _same_bytes(data, starts[known], self.data, self.start[slot[known]], lengths[known])
        counts = np.ones(len(at), dtype=np.int64)
        missed = np.flatnonzero(~hit)
        token = lambda i: data[starts[i] : ends[i]].tobytes()
        # equal misses are merged once: by hash, with their bytes compared
        _, first, inverse = np.unique(keys[missed], return_index=True, return_inverse=True)
        same = lengths[missed] == lengths[missed[first[inverse]]]
        same[same] = _same_bytes(data, starts[missed[same]], data, starts[missed[first[inverse[same]]]], lengths[missed[same]])
        once = [self._miss(token(i)) for i in missed[first].tolist()]
        for k in np.flatnonzero(~same).tolist():
            inverse[k] = len(once)
            once.append(self._miss(token(missed[k])))
        sizes = np.fromiter(map(len, once), dtype=np.int64, count=len(once))
        counts[missed] = sizes[inverse]
        begin = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(begin[-1], dtype=np.int32)
        ids[begin[:-1][hit]] = self.id[slot[hit]]
        if len(missed):
            merged = np.fromiter(itertools.chain.from_iterable(once), dtype=np.int32, count=sizes.sum())
            of = counts[missed]
            within = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
            ids[np.repeat(begin[missed], of) + within] = merged[np.repeat((np.cumsum(sizes) - sizes)[inverse], of) + within]
        return ids, begin[np.searchsorted(at, offsets)]


def _same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each span of ``a`` has the bytes of its span of ``b``."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths)
    differ = a[np.repeat(a_start, lengths) + step] != b[np.repeat(b_start, lengths) + step]
    return segment_sums(differ.astype(np.int64), bounds) == 0


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a rank file, built once on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return Encoder(f.read())


def vocabulary_path(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return os.path.join(folder, name)


def encoded(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``<id_col>, ids``: the token ids of each text, without special tokens.

    Null and empty texts give an empty array. Every row comes out once, repeated ids included; a
    text of any length is encoded whole. ``path`` is the rank file, read on the driver only.
    """
    sent = documents.sparkSession.sparkContext.broadcast(encoder(path or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in chunks(texts):
                ids, begin = known.encode_batch(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), lists], names=["id", "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    slim = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(slim).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``<id_col>, n_tokens``: the length of each text in tokens; only the lengths leave the workers."""
    sent = documents.sparkSession.sparkContext.broadcast(encoder(path or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in chunks(texts):
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), pa.array(np.diff(known.encode_batch(texts[lo:hi])[1]), pa.int64())], names=["id", "n_tokens"])

    kind = documents.schema[id_col].dataType.simpleString()
    slim = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(slim).mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)
