"""Stateful stream operators: one retry of each item, caps of a run, running shards.

State is one small row a key in the state store; timers drop it once the watermark says that its run is over, so keys
that are done with cost nothing. A query that starts again from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.lineage import Scratch

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class _Run(StatefulProcessor):
    """A key's state from its first row until `keep_ms` after it in event time; then the key begins anew."""

    def __init__(self, state: str, keep_ms: int) -> None:
        self.schema, self.keep_ms = state, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", self.schema)

    def begin(self, frames: list[pd.DataFrame]) -> None:
        first = min(f["at"].min() for f in frames)
        self.handle.registerTimer(int(first.timestamp() * 1000) + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


class _Retries(_Run):
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        tries, done = self.state.get() if known else (0, False)
        first: list[tuple] = []
        for f in rows:  # no more than two attempts count, so two rows are held
            if not known:
                self.begin([f])
                known = True
            first = heapq.nsmallest(2, [*first, *((p, bool(ok)) for p, ok in zip(f["pos"], f["ok"].fillna(False), strict=True))])
        before = (tries, done)
        for _, ok in first:
            if not done and tries < 2:
                tries, done = tries + 1, ok
        if (tries, done) != before:
            self.state.update((tries, done))
            yield pd.DataFrame({"key": [key[0]], "tries": [tries], "state": ["done" if done else "retry" if tries < 2 else "given_up"]})


class _Capped(_Run):
    def __init__(self, keep_ms: int, order: str, cap: int) -> None:
        super().__init__("n long", keep_ms)
        self.order, self.cap = order, cap

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        held = self.state.get()[0] if known else 0
        kept = None
        for f in rows:
            if not known:
                self.begin([f])
                known = True
            if held < self.cap:
                kept = (f if kept is None else pd.concat([kept, f])).nsmallest(self.cap - held, self.order)
        if kept is not None and len(kept):
            self.state.update((held + len(kept),))
            yield kept.reset_index(drop=True)


class _Sharded(_Run):
    def __init__(self, keep_ms: int, order: str, tokens: str, limit: int) -> None:
        super().__init__("shard long, held long", keep_ms)
        self.order, self.tokens, self.limit = order, tokens, limit

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)  # what one key has in a micro-batch
        if not self.state.exists():
            self.begin(frames)
        shard, held = self.state.get() if self.state.exists() else (0, 0)
        f, out = pd.concat(frames).sort_values(self.order, kind="stable"), []
        for n in f[self.tokens].fillna(0).astype("int64"):
            out.append(shard)
            held += int(n)
            if held >= self.limit:
                shard, held = shard + 1, 0
        self.state.update((shard, held))
        yield f.assign(shard=out).reset_index(drop=True)


def _run(rows: DataFrame, by: str, processor: _Run, schema: str, late: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.withWatermark("at", late).groupBy(by).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def retries(attempts: DataFrame, keep_ms: int = 30 * DAY_MS, late: str = "1 hour") -> DataFrame:
    """What ledger.retry_plan gives, on a stream of attempts (key, pos, ok, at): a row for each change of a key's state,
    of which the one with most tries holds. A failed item is tried once more, and then given up.

    Attempts count in the order of pos within a micro-batch, and of arrival otherwise. After keep_ms in event time
    from a key's first attempt its state is dropped: the next attempt is the first of a new run.
    """
    kind = dict(attempts.dtypes)["key"]
    return _run(attempts.select("key", "pos", "ok", "at"), "key", _Retries("tries long, done boolean", keep_ms), f"key {kind}, tries long, state string", late)


def capped(rows: DataFrame, by: str, order: str, cap: int, keep_ms: int = 30 * DAY_MS, late: str = "1 hour") -> DataFrame:
    """At most `cap` rows of each group in a run of keep_ms of event time (column at) from the group's first row: what
    ledger.first_n gives on rows that arrive in order. A micro-batch's rows of a group are reduced to cap."""
    return _run(rows, by, _Capped(keep_ms, order, cap), ", ".join(f"`{n}` {t}" for n, t in rows.dtypes), late)


def sharded(rows: DataFrame, by: str, order: str, tokens: str, limit: int, keep_ms: int = 30 * DAY_MS, late: str = "1 hour") -> DataFrame:
    """rows with the shard that each falls into, as ledger.shards gives it on rows that arrive in order: a shard closes once
    it holds `limit` tokens. A stream without rows for a run of keep_ms from its first one begins anew."""
    return _run(rows, by, _Sharded(keep_ms, order, tokens, limit), ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), "shard long"]), late)


def drained(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream until its source is drained. Each micro-batch has a folder of its own, so one that is run again
    replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def once(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """A stream's output, drained into the shared folder."""
    place = Scratch(spark).place
    drained(stream, f"{place}/out", f"{place}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{place}/out").select(*stream.columns)


def source(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over the files of a Parquet table, a folder or one file: a pattern stands for either."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def final(states: DataFrame) -> DataFrame:
    """The last state of each key of retries(), of one run each."""
    return states.groupBy("key").agg(F.max("tries").alias("tries"), F.max_by("state", "tries").alias("state"))
