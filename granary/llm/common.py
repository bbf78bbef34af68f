"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import Scratch, shared_folder

__all__ = ["RollingHash", "Scratch", "as_bytes", "joined_evenly", "mix", "mix_bytes", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that hold more than a MANY-th of a table's rows are joined by a broadcast; there are fewer than MANY of them.
MANY = 1024


def joined_evenly(rows: DataFrame, keys: DataFrame, on: str | list[str], size: str) -> DataFrame:
    """rows.join(keys, on) without a task that gets all rows of a frequent key. Both are written tables.

    keys has each key once, and in column `size` at least its number of rows. Those above a MANY-th of all sizes, fewer
    than MANY keys, go to every task; the rest is shuffled. Rows are told apart by the hashes of the frequent keys, of
    which the driver gets fewer than MANY.
    """
    names = [on] if isinstance(on, str) else on
    total, most = keys.agg(F.sum(size), F.max(size)).first()
    if not total or most * MANY <= total:
        return rows.join(keys, names)
    hashes = [r.h for r in keys.where(F.col(size) * MANY > total).select(F.xxhash64(*names).alias("h")).collect()]
    theirs = F.xxhash64(*names).isin(hashes)
    rest = rows.where(~theirs).join(keys.where(~theirs), names)
    return rows.where(theirs).join(F.broadcast(keys.where(theirs)), names).unionByName(rest)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding; null becomes empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


class RollingHash:
    """Polynomial hashes modulo 2**64 of any substring of a byte block, from one prefix sum."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            step = np.full(size, self.BASE, np.uint64)
            step[0] = 1
            self.powers = np.multiply.accumulate(step)
            step[1:] = pow(self.BASE, -1, 1 << 64)
            self.inverse = np.multiply.accumulate(step)

    def prefix(self, block: np.ndarray) -> np.ndarray:
        """block: uint8, the bytes; result: one longer than it."""
        self._grow(len(block) + 1)
        out = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(mix_bytes(block) * self.powers[: len(block)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverse[start])


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def mix_bytes(block: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value for each byte, so that low bits of the sums are well spread."""
    return _BYTE[block]
