"""Incremental collection: a file stream into a raw table, a clean table and a ledger, which change together.

A micro-batch writes its three parts under names of its own attempt; then one manifest, moved to its place last, lists
them (see sources.commits). Readers follow the manifest, so they see all of a batch or nothing of it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..presets import Preset
from ..sources import commits

TABLES = {"raw": "key {}, text string", "clean": "key {}, text string", "ledger": "key {}, status string, words int"}


def collected(spark: SparkSession, source: str, schema: str, preset: Preset, out: str, checkpoint: str, files_per_batch: int = 100, min_words: int = 0, most_items: int | None = None, most_seconds: float | None = None) -> str:
    """Collects rows (key, text) of a file source until it is `drained`, or a run has had most_items rows (`items`) or
    most_seconds (`seconds`), whichever comes first and between micro-batches; says which. The next run goes on there.

    A batch that is run again, after a crash at any point, takes the place of what its earlier attempt wrote.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    began, items, ended = time.monotonic(), 0, None

    def write(batch: DataFrame, number: int) -> None:
        nonlocal items, ended
        if most_items is not None and items >= most_items:
            ended = "items"
        elif most_seconds is not None and items and time.monotonic() - began >= most_seconds:
            ended = "seconds"
        if ended:
            raise InterruptedError(ended)  # the batch isn't committed, so the next run has it
        got = batch.withColumn("c", udfs.cleaned(F.coalesce(F.col("text"), F.lit("")), preset)).withColumn("clean", F.col("c.text"))
        n, m = T.rough_tokens(F.col("text")), T.rough_tokens(F.col("clean"))
        status = F.when(n < min_words, "too_short_or_no_article").when((m < min_words) | (F.col("clean") == ""), "filtered_below_min_words").otherwise("done")
        got = got.withColumns({"status": status, "words": m}).persist()
        folder = f"batch={number}/attempt={uuid.uuid4().hex}"
        got.select("key", "text").write.parquet(f"{out}/raw/{folder}")
        got.where("status = 'done'").select("key", F.col("clean").alias("text")).write.parquet(f"{out}/clean/{folder}")
        got.select("key", "status", F.col("words").cast("int").alias("words")).write.parquet(f"{out}/ledger/{folder}")
        n = got.count()
        last, entries = commits.manifest(out)
        kept = [e for e in entries or [] if e["batch"] != number]
        commits.publish(out, [*kept, {"batch": number, "folder": folder, "items": n}], last + 1)
        items += n
        got.unpersist()

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if not ended:
            raise
    return ended or "drained"


def collection(spark: SparkSession, out: str, table: str, key: str = "string") -> DataFrame:
    """The raw or clean table or the ledger: what the newest manifest lists, in any number of batches."""
    entries = commits.manifest(out)[1] or []
    read = spark.read.schema(TABLES[table].format(key))
    return read.parquet(*(f"{out}/{table}/{e['folder']}" for e in entries)) if entries else spark.createDataFrame([], TABLES[table].format(key))


def distinct_stream(rows: DataFrame) -> DataFrame:
    """First of each text on a stream; the state holds every fingerprint, as an exact ledger must."""
    return rows.withColumn("fp", T.fingerprint(F.col("text"))).dropDuplicates(["fp"])


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event-time window, for late data too."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
