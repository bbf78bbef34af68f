"""Files of little-endian 16-bit token ids as a Spark data source, written and read.

A folder of part files is one stream of tokens, in the order of their names, which is that of the writing partitions.
Reading cuts the stream, or one large file, into windows; a partition is a range of windows, so its size is what
RANGE_BYTES says and no file is read whole. Writing: see commits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .commits import FolderWriter, Written, listed, opened, place

FORMAT = "granary_tokens"
SCHEMA = "file string, pos long, ids array<int>"
SUFFIX = ".bin"
WINDOW = 1024
RANGE_BYTES = 32 << 20
WRITE_BYTES = 4 << 20  #: so many are gathered between two writes


def packed(ids: pa.Array) -> np.ndarray:
    """Ids of all rows of a list column, one row after the other, as 16-bit numbers; null rows have none."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    if not len(flat):
        return np.zeros(0, "<u2")
    if flat.dtype.kind not in "iu" or flat.min() < 0 or flat.max() > 0xFFFF:
        raise ValueError("a token id is missing or needs more than 16 bits")
    return flat.astype("<u2")


class Writer(FolderWriter):
    """Column ids of the rows, in their order: a file for each partition that has tokens."""

    def __init__(self, path: str, overwrite: bool) -> None:
        super().__init__(path, overwrite, SUFFIX)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, entry, out, held = opened(self.path)[0], None, None, []
        try:
            for batch in iterator:
                tokens = packed(batch.column("ids"))
                if not len(tokens):
                    continue
                if out is None:
                    entry = {"name": self.new_name(), "bytes": 0}
                    out = store.open_output_stream(self.draft(entry["name"]), compression=None)
                held.append(tokens)
                entry["bytes"] += 2 * len(tokens)
                if sum(map(len, held)) * 2 >= WRITE_BYTES:
                    out.write(np.concatenate(held).tobytes())
                    held = []
            if held:
                out.write(np.concatenate(held).tobytes())
        finally:
            if out:
                out.close()
        return Written([entry] if entry else [])


@dataclass
class Range(InputPartition):
    """Windows that begin at tokens first, first + step, ... before upto of a stream of (name, first token, end) files."""

    files: list[tuple[str, int, int]]
    first: int
    upto: int


class Reader(DataSourceReader):
    """Options: window, more (further tokens of the stream after each window, as targets need one), from and to (tokens
    at which windows may begin), per_file (each file is a stream of its own), range_bytes."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.window, self.more = int(options.get("window", WINDOW)), int(options.get("more", 0))
        self.first, self.upto = int(options.get("from", 0)), int(options["to"]) if "to" in options else None
        self.per_file, self.range_bytes = options.get("per_file", "false").lower() == "true", int(options.get("range_bytes", RANGE_BYTES))
        if self.window < 1 or self.more < 0:
            raise ValueError("a window has one token at least")

    def partitions(self) -> list[Range]:
        streams, at = [[]], 0
        for e in listed(self.path, SUFFIX):
            if e["bytes"] % 2:
                raise ValueError(f"{e['name']} doesn't hold whole 16-bit ids")
            if self.per_file:
                streams, at = [*streams, []], 0
            streams[-1].append((e["name"], at, at + e["bytes"] // 2))
            at += e["bytes"] // 2
        step = max(1, self.range_bytes // 2 // self.window) * self.window
        out = []
        for files in streams:
            end = min(files[-1][2] if files else 0, 1 << 62 if self.upto is None else self.upto)
            first = -(-self.first // self.window) * self.window
            for a in range(first, end, step):
                b = min(a + step, end)
                out.append(Range([f for f in files if f[1] < b + self.window + self.more and f[2] > a], a, b))
        return out or [Range([], 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store = opened(self.path)[0]
        block = max(1, (8 << 20) // (2 * self.window)) * self.window
        schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for a in range(partition.first, partition.upto, block):
            starts = np.arange(a, min(a + block, partition.upto), self.window)
            parts, names = [], []
            for name, first, end in partition.files:
                lo, hi = max(a, first), min(int(starts[-1]) + self.window + self.more, end)
                if lo < hi:
                    with store.open_input_file(place(self.path, name)) as f:
                        parts.append(np.frombuffer(f.read_at(2 * (hi - lo), 2 * (lo - first)), "<u2"))
                    names.append((first, end, name))
            ids = np.concatenate(parts).astype(np.int32)
            offsets = np.minimum(starts - a, len(ids))
            ends = np.minimum(offsets + self.window + self.more, len(ids))
            if self.more:
                ids, ends = np.concatenate([ids[x:y] for x, y in zip(offsets, ends, strict=True)]), np.cumsum(ends - offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
            where = [next(n for x, y, n in names if x <= s < y) for s in starts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(starts), lists], schema=schema)


class TokenSource(DataSource):
    """format(FORMAT): rows file, pos, ids: the windows of a stream, the last of which may be short; pos is the first token's
    place in the stream, file the one that it is in. Writing takes rows with a column ids."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if "ids" not in schema.fieldNames():
            raise ValueError("token files are made of a column ids")
        return Writer(self.options["path"], overwrite)


def read_tokens(spark: SparkSession, path: str, window: int = WINDOW, **options) -> DataFrame:
    spark.dataSource.register(TokenSource)
    return spark.read.format(FORMAT).options(window=window, **options).load(path)


def write_tokens(rows: DataFrame, path: str, order: str, ids: str = "ids", mode: str = "overwrite") -> None:
    """ids of rows as one stream in ascending order (null first); an append goes after what is there. A row is never cut."""
    rows.sparkSession.dataSource.register(TokenSource)
    dealt = rows.select(order, rows[ids].alias("ids")).repartitionByRange(order).sortWithinPartitions(order)
    dealt.select("ids").write.format(FORMAT).mode(mode).save(path)
