"""Bloom filters of a fixed size, put together by Spark and looked up in tasks.

The size is a parameter and not a matter of the data, so the filter may be broadcast. It only spares work: what it lets
through wrongly is dropped by an exact join afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return hashes >> shift, (hashes * np.uint64(0xD6E8FEB86659FD93)) >> shift


def build(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter of ``2 ** bits`` bits of a column of 64-bit hashes; at most ``2 ** (bits - 6)`` words reach the driver."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_slots(hashes, bits)).view(np.int64))], names=["slot"])

    words = (
        df.select(column)
        .mapInArrow(slots, "slot long")
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("value"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["value"].to_numpy().view(np.uint64)
    return table


def passes(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    a, b = _slots(hashes, bits)
    low, six = np.uint64(63), np.uint64(6)
    return ((table[a >> six] >> (a & low)) & (table[b >> six] >> (b & low)) & np.uint64(1)).astype(bool)
