"""A set of 64-bit hashes as a bit map whose size follows their number, built in tasks and used in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the least and the most bits of a map (the most: 32 MB); beyond that only false hits grow.
SPREAD, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: Words of 32 bits in one row when a map is gathered.
CHUNK = 1 << 14


class BitMap:
    """Tells of hashes whether they may be in the set; false hits are possible, misses are not."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.shift = words, np.uint64(64 - (32 * len(words)).bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes.view(np.uint64) >> self.shift).astype(np.int64)
        return (self.words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (SPREAD * n - 1).bit_length()))


def bit_map(hashes: DataFrame, n: int) -> BitMap:
    """The map of a table of one column of hashes (bigint) with n rows."""
    size = bits_for(n)
    bit = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - size.bit_length() + 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))
    words = hashes.select(F.shiftright(bit, 5).alias("at"), one.alias("one")).groupBy("at").agg(F.bit_or("one").alias("value"))

    def pack(part: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK, np.uint32)
        out[part["at"].to_numpy() % CHUNK] = part["value"].to_numpy().astype(np.uint32)
        return pa.table({"chunk": part["chunk"].slice(0, 1), "part": pa.array([out.tobytes()], pa.binary())})

    packed = words.withColumn("chunk", F.floor(F.col("at") / CHUNK)).groupBy("chunk").applyInArrow(pack, "chunk long, part binary").toArrow()
    out = np.zeros((-(-size // 32 // CHUNK), CHUNK), np.uint32)
    for i, part in zip(packed["chunk"].to_pylist(), packed["part"], strict=True):
        out[i] = np.frombuffer(part.as_py(), np.uint32)
    return BitMap(out.ravel()[: size // 32])
