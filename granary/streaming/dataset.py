"""A stream over an exported dataset of Parquet parts: verified parts before unverified ones, each document once.

An offset holds the documents done of each part, so it is the ledger of a scan as well. A micro-batch is the next
ROWS documents in the order of parts, files and rows, cut at row groups into partitions; what is done is not read again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.commits import opened

FORMAT = "granary_dataset"
SCHEMA = "part string, pos long, text string"
PARTS = "verified,unverified"
ROWS = 1_000_000


@dataclass
class Piece(InputPartition):
    """Rows first to upto of a row group; `pos` is the place of the first of them in its part."""

    part: str
    file: str
    group: int
    first: int
    upto: int
    pos: int


class DatasetReader(DataSourceStreamReader):
    """Options: path (a folder with one of each part), parts (in order; folders that aren't named are never read), column,
    rows (of a micro-batch), done (documents of each part that earlier scans have had, as JSON), progress (a file that
    holds the end of the last planned batch, so that a restarted query goes on in batches of the same size)."""

    def __init__(self, options: dict) -> None:
        self.path, self.column, self.rows = options["path"], options.get("column", "text"), int(options.get("rows", ROWS))
        self.parts, self.progress = options.get("parts", PARTS).split(","), options.get("progress")
        self.done = {p: int(json.loads(options.get("done", "{}")).get(p, 0)) for p in self.parts}
        self.planned: dict | None = None
        self.groups: dict[tuple[str, int], list[int]] = {}

    def files(self, part: str) -> list[tuple[str, list[int]]]:
        """Files of a part in order of names, with the rows of their row groups; a footer is read once."""
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/{part}", recursive=True, allow_not_found=True))
        out = []
        for f in sorted((f for f in found if f.base_name.endswith(".parquet") and f.size), key=lambda f: f.path):
            if (f.path, f.size) not in self.groups:
                with store.open_input_file(f.path) as file:
                    meta = pq.read_metadata(file)
                self.groups[f.path, f.size] = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
            out.append((f.path, self.groups[f.path, f.size]))
        return out

    def initialOffset(self) -> dict:
        return self.done

    def _known(self) -> dict:
        if self.planned is None and self.progress:
            store, at = opened(self.progress)
            if store.get_file_info(at).type == fs.FileType.File:
                with store.open_input_stream(at) as f:
                    self.planned = json.loads(f.read())
        return self.planned or self.done

    def latestOffset(self) -> dict:
        """Up to `rows` documents further than what is planned; a part begins when the one before it is exhausted."""
        end, left = dict(self._known()), self.rows
        for part in self.parts:
            there = sum(n for _, groups in self.files(part) for n in groups)
            step = min(left, max(0, there - end[part]))
            end[part] += step
            left -= step
            if end[part] < there:
                break
        return end

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for part in self.parts:
            at = 0
            for file, groups in self.files(part):
                for group, n in enumerate(groups):
                    a, b = max(start[part], at), min(end[part], at + n)
                    if a < b:
                        out.append(Piece(part, file, group, a - at, b - at, a))
                    at += n
        if self.planned is None or sum(end.values()) > sum(self.planned.values()):
            self.planned = dict(end)
            if self.progress:
                store, at = opened(self.progress)
                with store.open_output_stream(draft := f"{at}.{uuid.uuid4().hex}") as f:
                    f.write(json.dumps(end).encode())
                store.move(draft, at)
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """Trimmed texts of a piece; empty ones have a place but no row."""
        with opened(self.path)[0].open_input_file(piece.file) as file:
            at = 0
            for batch in pq.ParquetFile(file).iter_batches(4096, row_groups=[piece.group], columns=[self.column]):
                a, b = max(piece.first, at), min(piece.upto, at + batch.num_rows)
                texts = [(piece.pos + k - piece.first, (t or "").strip()) for k, t in enumerate(batch.column(0)[a - at : b - at].to_pylist(), a)] if a < b else []
                kept = [(p, t) for p, t in texts if t]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([piece.part] * len(kept)), pa.array([p for p, _ in kept], pa.int64()), pa.array([t for _, t in kept])], ["part", "pos", "text"])
                at += batch.num_rows


class Dataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DatasetReader:
        return DatasetReader(dict(self.options))


def documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stream: part, pos (place in its part), text."""
    spark.dataSource.register(Dataset)
    return spark.readStream.format(FORMAT).options(**options).load(path)


def scan(spark: SparkSession, path: str, out: str, checkpoint: str, batches: int | None = None, **options) -> None:
    """Writes the stream's documents below out, a folder for each micro-batch, until the dataset is exhausted or, where
    `batches` is given, so many are done; the next call goes on there."""
    stream, count = documents(spark, path, progress=f"{checkpoint}.progress", **options), 0

    def write(batch: DataFrame, number: int) -> None:
        nonlocal count
        if batches is not None and count >= batches:
            raise InterruptedError("enough batches")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        count += 1

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    except Exception:
        if batches is None or count < batches:
            raise
    finally:
        query.stop()
