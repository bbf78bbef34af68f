"""Blank-line segments of text files of any size, by splits.

Spark cuts files into byte ranges and gives each task the lines that begin in its range. A task numbers the stretches
between its blank lines; how many blank lines the ranges before it have is a prefix sum, which turns these numbers into
numbers of the whole file. What ends one range and begins the next has the same number, and is put together; all other
segments stay where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import Scratch

BLANKS = b" \t\x0b\x0c\r"
BATCH_BYTES = 4 << 20


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (path, block, value) as stretches (path, block, number, text), and for each range its last number with null."""
    rows: list[tuple] = []
    where, number, lines, size = None, 0, [], 0

    def close() -> None:
        nonlocal lines, size
        if lines:
            text = b"\n".join(lines).decode("utf-8", "replace")
            size += len(text)
            rows.append((*where, number, text))
            lines = []

    def batch_of() -> pa.RecordBatch:
        nonlocal rows, size
        columns = list(zip(*rows, strict=True)) or [()] * 4
        rows, size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "block", "number", "text"])

    for batch in batches:
        for path, block, value in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if where != (path, block):
                if where:
                    close()
                    rows.append((*where, number, None))
                where, number = (path, block), 0
            if value.strip(BLANKS):
                lines.append(value)
            else:
                close()
                number += 1
            if size >= BATCH_BYTES:
                yield batch_of()
    if where:
        close()
        rows.append((*where, number, None))
    yield batch_of()


@contextmanager
def _splits(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Files are cut into ranges of `size` bytes meanwhile."""
    wanted = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0} if size else {}
    kept = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def file_segments(spark: SparkSession, path: str, glob: str = "*.txt", split_bytes: int | None = None) -> DataFrame:
    """path, pos, text: the segments that files.segments() finds in each file below path, numbered from 0; bytes that are no
    UTF-8 are replaced, and a file's byte order mark is left out. Splits: those of the session, or of split_bytes."""
    scratch = Scratch(spark)
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    with _splits(spark, split_bytes):
        found = scratch.written(lines.mapInArrow(_stretches, "path string, block long, number long, text string"), "stretches")
    ranges = found.where("text is null").select("path", "block", F.col("number").alias("blanks"))  # a row for each range
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = scratch.written(ranges.withColumn("first", F.coalesce(F.sum("blanks").over(earlier), F.lit(0))), "ranges")
    numbered = found.where("text is not null").join(ranges, ["path", "block"]).withColumn("segment", F.col("first") + F.col("number"))
    edge = (F.col("number") == 0) | (F.col("number") == F.col("blanks"))
    inner = numbered.where(~edge).select("path", "block", "segment", "text")
    pieces = numbered.where(edge).groupBy("path", "segment").agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    joined = pieces.select("path", "block", "segment", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    whole = inner.unionByName(joined).withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    whole = scratch.written(whole, "segments")
    scratch.drop("stretches")
    counts = whole.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("path", "block").orderBy("segment")) - 1
    return whole.withColumn("rank", rank).join(before, ["path", "block"]).select("path", (F.col("before") + F.col("rank")).cast("long").alias("pos"), "text")
