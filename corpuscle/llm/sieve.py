"""A Bloom filter over 64-bit keys, built by executors and broadcast: what it lets through needs an exact join.

Its size follows the number of keys, PER_KEY bits each, up to MOST bits (32 MB), which is all that is ever broadcast. Up to 16
million keys one row in seventy passes that need not; at 67 million one in seven; far beyond that the filter lets most rows
through, and the exact join behind it moves them. Results are the same at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a key, and of a filter at least and at most.
PER_KEY, LEAST, MOST = 16, 1 << 16, 1 << 28
#: Slices, the parts of a filter that one group each makes, and bits of a slice at least.
SLICES, SLICE = 1 << 12, 1 << 10


def bits_for(n: int) -> int:
    """The power of two that gives n keys PER_KEY bits, within the bounds."""
    return max(LEAST, min(MOST, 1 << max(0, n * PER_KEY - 1).bit_length()))


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two bit places of each key."""
    x = keys.astype(np.int64).view(np.uint64)
    out = np.empty((len(x), 2), np.int64)
    for i, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        h = (x ^ x >> np.uint64(31)) * np.uint64(odd)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, i] = (h >> np.uint64(24)) % np.uint64(bits)
    return out


def test(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = places(keys, len(mask) * 8)
    return ((mask[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _longs(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).cast(pa.int64()).drop_null().to_numpy(zero_copy_only=False)


def build(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray] = _longs) -> bytes:
    """The filter of the keys of `rows`, by default those of its one long column; a written table, as it is counted, then read.
    `keys` runs in the worker that finds the places, so that a task needs one worker only."""
    size = bits_for(rows.count())
    part_bits = max(SLICE, size // SLICES)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = np.unique(places(keys(b), size))
            yield pa.RecordBatch.from_arrays([pa.array((where // part_bits).astype(np.int32)), pa.array((where % part_bits).astype(np.int32))], ["slice", "at"])

    def merged(part: pa.Table) -> pa.Table:
        mask = np.zeros(part_bits, np.uint8)
        mask[part.column("at").to_numpy()] = 1
        return pa.table({"slice": part.column("slice")[:1], "bits": pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())})

    told = rows.mapInArrow(some, "slice int, at int")
    out = bytearray(size // 8)
    for r in told.groupBy("slice").applyInArrow(merged, "slice int, bits binary").collect():  # MOST / 8 bytes in all, at most
        out[r["slice"] * part_bits // 8 : (r["slice"] + 1) * part_bits // 8] = r["bits"]
    return bytes(out)


def split(rows: DataFrame, key: Column, mask: bytes) -> tuple[DataFrame, DataFrame]:
    """Rows whose long key may be in the filter, and those whose key is not. Only the key goes through Python."""
    told = rows.sparkSession.sparkContext.broadcast(mask)  # MOST / 8 bytes at most

    @F.pandas_udf("boolean")
    def held(key):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(test(np.frombuffer(told.value, np.uint8), key.fillna(0).to_numpy().astype(np.int64)) & key.notna().to_numpy())

    return rows.where(held(key)), rows.where(~held(key))
