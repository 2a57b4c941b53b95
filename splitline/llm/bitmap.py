"""A fixed-size bitmap over 64-bit keys, built by Spark: a lossless prefilter before an exact hash join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: 2**23 bits: one megabyte, whatever the number of keys. More keys only let more rows through to the exact join.
BITS = 23
BLOCK = 16


def slots(keys: np.ndarray, shift: int = 64 - BITS) -> np.ndarray:
    return (keys.astype(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << BITS) - 1)


def build(keys: DataFrame, column: str, shift: int = 64 - BITS, bits: int = BITS) -> np.ndarray:
    """0/1 bytes per slot, ``bits`` bits of a key from ``shift`` up, of the non-null long keys in ``column``. At most 2**(bits-BLOCK) blocks of
    bits reach the driver: one megabyte for 2**23 slots."""
    slot = F.shiftrightunsigned(F.col(column), shift).bitwiseAND((1 << bits) - 1)
    blocks = (
        keys.where(F.col(column).isNotNull())
        .select(F.shiftright(slot, BLOCK).cast("int").alias("block"), slot.bitwiseAND((1 << BLOCK) - 1).cast("int").alias("bit"))
        .distinct()
        .groupBy("block")
        .agg(F.collect_list("bit").alias("bits"))  # at most 2**BLOCK of them
        .select("block", F.col("bits"))
    )

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for bits in b.column("bits"):
                m = np.zeros(1 << BLOCK, dtype=np.uint8)
                m[np.array(bits.as_py(), dtype=np.int64)] = 1
                out.append(np.packbits(m).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary())], names=["block", "m"])

    found = np.zeros(1 << bits, dtype=np.uint8)
    for r in blocks.mapInArrow(pack, "block int, m binary").collect():
        found[r.block << BLOCK : (r.block + 1) << BLOCK] = np.unpackbits(np.frombuffer(bytes(r.m), dtype=np.uint8))
    return found
