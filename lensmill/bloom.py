"""Bloom filters over 64-bit hashes: packed bits, a bounded size, built where the keys lie.

A filter screens rows for an exact join that follows: what it turns down is certainly no match and
never moves. Its size follows the number of keys up to a fixed bound, beyond which it only lets more
through, so the joined result is the same at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.arrays import mix64

#: Bits of one block, which a task builds alone, and of the largest filter (64 MB).
BLOCK_BITS, MOST_BITS = 1 << 19, 1 << 29
#: Bits a key and probes: about one in a hundred foreign keys passes.
BITS_PER_KEY, PROBES = 10, 7


def power_of_two(n: int) -> int:
    """The least power of two that is not below ``n``."""
    return 1 << max(0, int(n) - 1).bit_length()


class Bloom:
    """A filter of ``blocks`` blocks of ``block_bits`` bits (powers of two); the top bits of a hash name its block.

    >>> f = Bloom.of(np.array([1, 2], dtype=np.uint64)); f.might_contain(np.array([1, 9], dtype=np.uint64)).tolist()
    [True, False]
    """

    def __init__(self, block_bits: int, blocks: int = 1, probes: int = PROBES, packed: np.ndarray | None = None):
        self.block_bits, self.blocks, self.probes = block_bits, blocks, probes
        self.packed = np.zeros(block_bits * blocks // 8, dtype=np.uint8) if packed is None else packed

    @classmethod
    def of(cls, hashes: np.ndarray, bits_per_key: int = BITS_PER_KEY, probes: int = PROBES) -> Bloom:
        """A filter of one block that holds ``hashes``."""
        out = cls(power_of_two(max(64, len(hashes) * bits_per_key)), 1, probes)
        out.packed |= out.bits_of(hashes)
        return out

    def _walk(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = mix64(hashes)
        return mixed, (mixed >> np.uint64(32)) | np.uint64(1)

    def bits_of(self, hashes: np.ndarray) -> np.ndarray:
        """One block, packed, with the bits of ``hashes``, all of which must belong to the same block."""
        bits = np.zeros(self.block_bits, dtype=bool)
        at, step = self._walk(hashes)
        for _ in range(self.probes):
            bits[at & np.uint64(self.block_bits - 1)] = True
            at = at + step
        return np.packbits(bits, bitorder="little")

    def block_of(self, hashes: np.ndarray) -> np.ndarray:
        shift = 64 - (self.blocks.bit_length() - 1)
        return hashes >> np.uint64(shift) if self.blocks > 1 else np.zeros(len(hashes), dtype=np.uint64)

    def might_contain(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the filter; a hash is dropped from the walk at its first missing bit."""
        found = np.zeros(len(hashes), dtype=bool)
        alive = np.arange(len(hashes))
        at, step = self._walk(hashes)
        base = self.block_of(hashes) * np.uint64(self.block_bits)
        for _ in range(self.probes):
            bit = base + (at & np.uint64(self.block_bits - 1))
            hit = (self.packed[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
            alive, at, step, base = alive[hit], at[hit] + step[hit], step[hit], base[hit]
        found[alive] = True
        return found


def bloom_of(keys: DataFrame, column: str = "h", bits_per_key: int = BITS_PER_KEY, most_bits: int = MOST_BITS) -> Bloom:
    """A filter that holds the bigint ``column`` of ``keys``, of at most ``most_bits``. Keys meet block by block in tasks; the driver gets packed blocks only."""
    bits = min(most_bits, power_of_two(max(1024, keys.count() * bits_per_key)))
    blocks = max(1, bits // BLOCK_BITS)
    out = Bloom(bits // blocks, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            hashes = batch["h"].to_numpy(zero_copy_only=False).view(np.uint64)
            of = out.block_of(hashes)
            for b in np.unique(of):
                packed = out.bits_of(hashes[of == b])
                own[int(b)] = own[int(b)] | packed if int(b) in own else packed
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([p.tobytes() for p in own.values()], pa.binary())], names=["block", "bits"])

    block = F.shiftrightunsigned("h", 64 - (blocks.bit_length() - 1)) if blocks > 1 else F.lit(0)
    slim = keys.select(F.col(column).alias("h")).repartition(blocks, block)
    size = out.block_bits // 8
    for r in slim.mapInArrow(run, "block int, bits binary").collect():
        out.packed[r.block * size : (r.block + 1) * size] |= np.frombuffer(r.bits, dtype=np.uint8)
    return out


def screen(spark: SparkSession, bloom: Bloom) -> Callable[[Column], Column]:
    """A function of a bigint column that says whether its hash may be in ``bloom``; only that column goes to Python."""
    sent = spark.sparkContext.broadcast(bloom)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(sent.value.might_contain(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    return maybe


def split(rows: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` that surely have no match in ``keys``, and those that may have one; nothing is shuffled.

    ``keys`` is read more than once and should be cut. Key columns may hold nulls.
    """
    maybe = screen(rows.sparkSession, bloom_of(keys.select(F.xxhash64(*key).alias("h"))))(F.xxhash64(*key))
    return rows.where(~maybe), rows.where(maybe)


def screened_join(rows: DataFrame, keys: DataFrame, key: list[str], how: str = "left_semi") -> DataFrame:
    """``rows`` semi- or anti-joined with ``keys`` (null matches null); only rows that may match are shuffled."""
    apart, near = split(rows, keys, key)
    right = keys.select(*[F.col(k).alias(f"__{k}") for k in key])
    joined = near.join(right, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], how)
    return apart.unionByName(joined) if how == "left_anti" else joined
