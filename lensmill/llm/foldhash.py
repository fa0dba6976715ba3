"""Duplicates hidden by spacing, case, punctuation or the order of fields.

Every text runs once through a table that maps each character to its folded form or to "skip".
Rolling polynomial hashes are taken over what remains; the canonical string is never built. Texts
whose hashes collide are then compared with two pointers that skip over dropped characters.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmill.bloom import bloom_of
from lensmill.llm.batch import chunks, codepoints, mix64, segment_sums
from lensmill.shared import cut, spread

#: Texts with fewer kept letters and digits than this are no case.
LEAST_KEPT = 30
#: Rows of one record from which it is split, and the number of parts all records together are split into at most.
ROWS_PER_SALT, MOST_PARTS = 10_000, 100_000
#: Characters of a text that a comparison folds at once.
FOLD_AT_ONCE = 1 << 16
_P = (1 << 31) - 1
_BASES = (1_000_003_319, 1_700_000_429)
#: Characters that end a field, and those that join a label to its value.
_BREAKS = "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029|;"
_COLONS = ":："


@functools.cache
def fold_table() -> np.ndarray:
    """For each code point its lower-case letter or digit, or 0 if it is skipped."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            kept = [x for x in ch.lower() if x.isalnum()]
            table[c] = ord(kept[0]) if kept else 0
    return table


@functools.cache
def _classes() -> np.ndarray:
    """Bit 0: ends a field; bit 1: colon; bit 2: not white space."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        if not chr(c).isspace():
            table[c] = 4
    for ch in _BREAKS:
        table[ord(ch)] = 1
    for ch in _COLONS:
        table[ord(ch)] |= 2
    return table


def _powers_mod(base: int, count: int) -> np.ndarray:
    out = np.ones(max(count, 1), dtype=np.uint64)
    done = 1
    step = base % _P
    while done < len(out):
        more = min(done, len(out) - done)
        out[done : done + more] = out[:more] * np.uint64(step) % np.uint64(_P)
        done += more
        step = step * step % _P
    return out


def fold_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of kept characters and whether it is a list of fields, for each text.

    A list of fields has two or more non-blank pieces between line breaks, ``|`` and ``;``, each
    with a colon. Its hash is a sum over the hashes of its pieces, so their order does not count.
    """
    flat, offsets = codepoints(texts)
    kinds = _classes()[flat]
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    first = np.zeros(len(flat) + 1, dtype=bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    starts_piece = first.copy()
    starts_piece[1:] |= (kinds[:-1] & 1).astype(bool)
    piece_starts = np.flatnonzero(starts_piece)
    bounds = np.append(piece_starts, len(flat))
    piece_doc = doc[piece_starts] if len(flat) else np.zeros(0, dtype=np.int64)
    filled = segment_sums((kinds & 4 > 0).astype(np.int64), bounds) > 0
    colon = segment_sums((kinds & 2 > 0).astype(np.int64), bounds) > 0
    pieces = np.bincount(piece_doc, weights=filled, minlength=n)
    lacking = np.bincount(piece_doc, weights=filled & ~colon, minlength=n)
    fields = (pieces >= 2) & (lacking == 0)

    folded = fold_table()[flat]
    kept_at = np.flatnonzero(folded)
    values = mix64(folded[kept_at]) % np.uint64(_P)
    whole = np.zeros(len(piece_starts), dtype=bool)
    whole[np.flatnonzero(first[piece_starts])] = True
    unit_piece = whole | fields[piece_doc]
    unit_starts = np.append(piece_starts[unit_piece], len(flat))
    unit_doc = piece_doc[unit_piece]
    inner = np.searchsorted(kept_at, unit_starts)
    rank = np.arange(len(kept_at)) - np.repeat(inner[:-1], np.diff(inner))
    most = int(rank.max()) + 1 if len(rank) else 1
    halves = []
    for base in _BASES:
        terms = values * _powers_mod(base, most)[rank] % np.uint64(_P)
        halves.append(segment_sums(terms, inner) % np.uint64(_P))
    unit_hash = (halves[0] << np.uint64(31)) | halves[1]
    unit_kept = np.diff(inner)
    unit_hash = np.where(fields[unit_doc], mix64(unit_hash + unit_kept.astype(np.uint64)), unit_hash)
    unit_hash[(unit_kept == 0)] = 0
    order = np.searchsorted(unit_doc, np.arange(n + 1))
    hashes = segment_sums(unit_hash, order)
    kept = segment_sums(unit_kept.astype(np.int64), order)
    return hashes.view(np.int64), kept, fields


def _pieces(text: str) -> list[str]:
    for ch in _BREAKS[1:]:
        text = text.replace(ch, "\n")
    return [p for p in text.split("\n") if not p.isspace() and p]


def is_fields(text: str) -> bool:
    pieces = _pieces(text)
    return len(pieces) >= 2 and all(":" in p or "：" in p for p in pieces)


def same_text(a: str, b: str) -> bool:
    """Whether two texts keep the same folded characters.

    Two pointers run over the raw characters, a block at a time, and skip what folding drops; no
    more than the kept characters of one block of each are ever held.
    """
    if a == b:
        return True
    table = fold_table()
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (a, b)]
    at, held = [0, 0], [raw[0][:0], raw[1][:0]]
    while True:
        for k in (0, 1):
            while not len(held[k]) and at[k] < len(raw[k]):
                block = table[raw[k][at[k] : at[k] + FOLD_AT_ONCE]]
                held[k], at[k] = block[block > 0], at[k] + FOLD_AT_ONCE
        n = min(len(held[0]), len(held[1]))
        if not n:
            return len(held[0]) == len(held[1])
        if not np.array_equal(held[0][:n], held[1][:n]):
            return False
        held = [held[0][n:], held[1][n:]]


def same_record(a: str, b: str) -> bool:
    """``same_text``, or for two lists of fields the same pieces in any order."""
    if a == b:
        return True
    if is_fields(a) != is_fields(b):
        return False
    if not is_fields(a):
        return same_text(a, b)
    left, right = _pieces(a), _pieces(b)
    by_hash: dict[int, list[str]] = {}
    for piece, h in zip(right, fold_hashes(right)[0].tolist()):
        by_hash.setdefault(h, []).append(piece)
    for piece, h in zip(left, fold_hashes(left)[0].tolist()):
        for k, other in enumerate(by_hash.get(h, [])):
            if same_text(piece, other):
                by_hash[h].pop(k)
                break
        else:
            if fold_kept(piece):
                return False
    return not any(fold_kept(p) for rest in by_hash.values() for p in rest)


def fold_kept(text: str) -> int:
    """Number of letters and digits that folding keeps."""
    return int(np.count_nonzero(fold_table()[np.fromiter(map(ord, text), dtype=np.int64, count=len(text))]))


def canonical(text: str) -> str:
    """The canonical form; only built for texts whose hashes collided without their being the same."""
    table = fold_table()
    form = lambda s: "".join(chr(c) for c in table[np.fromiter(map(ord, s), dtype=np.int64, count=len(s))] if c)
    return "\x00".join(sorted(filter(None, map(form, _pieces(text))))) if is_fields(text) else form(text)


def _hashed(batches: Iterator[pa.RecordBatch], least: int = LEAST_KEPT, wanted=None) -> Iterator[pa.RecordBatch]:
    """Texts with their keys; only those that keep ``least`` characters and whose hash ``wanted`` lets through."""
    for batch in batches:
        ids, column = batch["id"], batch["text"]
        texts = column.to_pylist()
        for lo, hi in chunks(texts):
            h, kept, fields = fold_hashes(texts[lo:hi])
            keep = np.flatnonzero(kept >= least)
            if wanted is not None:
                keep = keep[wanted(h[keep].view(np.uint64))]
            at = pa.array(keep + lo)
            arrays = [ids.take(at), column.take(at), pa.array(h[keep]), pa.array(kept[keep]), pa.array(fields[keep])]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "text", "h", "kept", "fields"])


def _hashed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _hashed(batches):
        yield batch.select(["id", "h", "kept", "fields"])


def _digested_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of all texts, short ones included, with 128 bits of a digest that tell whether texts are the very same."""
    for batch in _hashed(batches, 0):
        digests = b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest() for t in batch["text"].to_pylist())
        d = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
        arrays = [*(batch[c] for c in ("id", *_KEY)), pa.array(d[:, 0]), pa.array(d[:, 1])]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", *_KEY, "d0", "d1"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch["text"].to_pylist(), batch["first_text"].to_pylist())
        other = [None if same_record(a, b) else canonical(a) for a, b in pairs]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", *_KEY)), pa.array(other, pa.string())], names=["id", *_KEY, "other"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [same_record(a, b) for a, b in zip(batch["text"].to_pylist(), batch["first_text"].to_pylist())]
        other = [None if ok else canonical(t) for ok, t in zip(same, batch["text"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["first_id"], pa.array(other, pa.string())], names=["id", "first_id", "other"])


_KEY = ["h", "kept", "fields"]
_TEXTS = "id string, text string, h bigint, kept bigint, fields boolean, salt int, salts int"


def _colliding(source: DataFrame, keys: DataFrame, least: int) -> DataFrame:
    """``id, text, h, kept, fields, salt, salts`` of the rows of ``source`` whose hash is among ``keys`` (``h, n``, cut).

    A Bloom filter of the keys turns down all other rows where they are read, but for about one in a
    hundred, so only colliding texts ever leave the scan, at any number of keys. A key of very many
    rows (``n``) is split into parts; there are at most ``MOST_PARTS`` of these in all. Cut.
    """
    spark = source.sparkSession
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part = max(ROWS_PER_SALT, -(-total // MOST_PARTS))
    heavy = sorted((r.h, -(-r.n // part)) for r in keys.where(F.col("n") > part).groupBy("h").agg(F.sum("n").alias("n")).collect())
    sent = spark.sparkContext.broadcast((bloom_of(keys), np.array([h for h, _ in heavy], dtype=np.int64), np.array([k for _, k in heavy], dtype=np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, hot, parts = sent.value
        for batch in _hashed(batches, least, bloom.might_contain):
            salts = np.ones(batch.num_rows, dtype=np.int32)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, batch["h"].to_numpy()), len(hot) - 1)
                salts = np.where(hot[at] == batch["h"].to_numpy(), parts[at], salts)
            salt = (np.arange(batch.num_rows) % salts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(salt), pa.array(salts)], names=[*batch.schema.names, "salt", "salts"])

    return cut(source.mapInArrow(run, _TEXTS))


def _with_first(members: DataFrame, firsts: DataFrame) -> DataFrame:
    """``members`` beside the first text of their key; a split key's first is repeated once for each of its parts."""
    copies = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return members.drop("salts").join(copies, [*_KEY, "salt"])


def formatting_pairs(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``first_id, id``: for each record of two or more ids the smallest id with each other id, once.

    Null texts and ids, and texts with fewer than 30 letters and digits, are no case. An id with
    several texts may belong to several records. Only colliding rows carry their texts through a
    shuffle; a record that very many share is spread by salts.
    """
    source = spread(rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")))
    keys = source.mapInArrow(_hashed_keys, "id string, h bigint, kept bigint, fields boolean")
    # read more than once and dear to make
    shared = cut(keys.groupBy(*_KEY).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last").select("h", "n"))
    members = _colliding(source, shared, LEAST_KEPT)
    firsts = members.groupBy(*_KEY).agg(F.min(F.struct("id", "text")).alias("f"), F.max("id").alias("last"), F.first("salts").alias("salts")).where("f.id < last")
    compared = _with_first(members, firsts.select(*_KEY, "salts", F.col("f.id").alias("first_id"), F.col("f.text").alias("first_text")))
    compared = cut(compared.select("id", "first_id", "text", "first_text").mapInArrow(_verified, "id string, first_id string, other string"))
    same = compared.where("other is null").select("first_id", "id")
    apart = compared.where("other is not null").select("other", "id")
    again = apart.join(apart.groupBy("other").agg(F.min("id").alias("first_id")), "other").select("first_id", "id")
    return same.unionByName(again).where("id > first_id").distinct()


def records(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``h, kept, fields, first_id, ids, copies``: one row for each record, those of one row and short ones included.

    ``copies`` counts the rows that have the record, ``ids`` their distinct ids, of which
    ``first_id`` is the smallest. Null texts are no record; a row with a null id is a copy, but no
    id. An id with several texts belongs to several records. Keys whose rows all have the very same
    text need no comparison; the rows of the others carry their texts through a shuffle as in
    ``formatting_pairs``.
    """
    source = spread(rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")))
    keys = source.mapInArrow(_digested_keys, "id string, h bigint, kept bigint, fields boolean, d0 bigint, d1 bigint")
    each = [f(d).alias(f"{name}_{d}") for d in ("d0", "d1") for name, f in (("min", F.min), ("max", F.max))]
    again = [f(f"{name}_{d}").alias(f"{name}_{d}") for d in ("d0", "d1") for name, f in (("min", F.min), ("max", F.max))]
    per_id = keys.groupBy(*_KEY, "id").agg(F.count("*").alias("n"), *each)
    groups = cut(per_id.groupBy(*_KEY).agg(F.min("id").alias("first_id"), F.count("id").alias("ids"), F.sum("n").alias("copies"), *again))
    alike = F.expr("min_d0 = max_d0 and min_d1 = max_d1")
    columns = [*_KEY, "first_id", "ids", "copies"]
    mixed = cut(groups.where(~alike).select(*_KEY, F.col("copies").alias("n")))
    members = _colliding(source, mixed, 0)
    firsts = members.groupBy(*_KEY).agg(F.min("text").alias("first_text"), F.first("salts").alias("salts")).join(mixed.select(*_KEY), _KEY, "left_semi")
    compared = _with_first(members, firsts).select("id", *_KEY, "text", "first_text").mapInArrow(_compared, "id string, h bigint, kept bigint, fields boolean, other string")
    told = compared.groupBy(*_KEY, "other", "id").agg(F.count("*").alias("n")).groupBy(*_KEY, "other").agg(F.min("id").alias("first_id"), F.count("id").alias("ids"), F.sum("n").alias("copies"))
    return groups.where(alike).select(*columns).unionByName(told.select(*columns))


def collapsed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per record of at least 30 letters and digits that has several ids: ``first_id`` and ``copies``, the number of its ids."""
    return records(rows, id_col, text_col).where((F.col("kept") >= LEAST_KEPT) & (F.col("ids") > 1)).select("first_id", F.col("ids").alias("copies"))
