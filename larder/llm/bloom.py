"""Blocked Bloom filters of bounded size, filled on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One block is eight 64-bit words, a cache line; a key sets one bit in each of them.
WORDS = 8
#: Bits for each key, up to 32 MB in all: with more keys than that has room for, more of the others pass.
BITS_A_KEY, MOST_BLOCKS = 16, 1 << 19
#: Blocks that one group fills.
SEGMENT = 1 << 12


class BlockedBloom:
    """Each key's bits lie in one block of 512 bits, so a lookup touches one cache line. Keys are 64-bit hashes."""

    def __init__(self, capacity: int):
        self.blocks = np.zeros((min(MOST_BLOCKS, max(1, -(-capacity * BITS_A_KEY // 512))), WORDS), np.uint64)

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)
        shifts = np.uint64(6) * np.arange(WORDS, dtype=np.uint64)
        return hashes.view(np.int64) % len(self.blocks), np.uint64(1) << ((mixed[:, None] >> shifts) & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        block, bits = self._place(hashes)
        np.bitwise_or.at(self.blocks, block, bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = self._place(hashes)
        return ((self.blocks[block] & bits) == bits).all(axis=1)


def filled(hashes: DataFrame, capacity: int) -> BlockedBloom:
    """The filter of a table with one long column of hashes. Each group fills some blocks; the driver gets the filter's
    bytes, never the keys."""
    bloom = BlockedBloom(capacity)
    n = len(bloom.blocks)

    def fill(key, table):
        part = BlockedBloom(capacity)
        part.add(table.column("h").combine_chunks().to_numpy().view(np.uint64))
        first = key[0].as_py() * SEGMENT
        return pa.table({"seg": [key[0].as_py()], "bits": pa.array([part.blocks[first : first + SEGMENT].tobytes()], pa.binary())})

    named = hashes.toDF("h").where("h is not null")
    segments = named.withColumn("seg", F.floor(F.pmod("h", F.lit(n).cast("long")) / SEGMENT).cast("long"))
    for seg, bits in segments.groupBy("seg").applyInArrow(fill, "seg long, bits binary").collect():
        part = np.frombuffer(bits, np.uint64).reshape(-1, WORDS)
        bloom.blocks[seg * SEGMENT : seg * SEGMENT + len(part)] = part
    return bloom
