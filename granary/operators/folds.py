"""The shard fold of a stream, in parallel.

A shard that starts at row s closes with the first row whose running total is at least that before s plus the limit: its
target. A stream is dealt out in ranges. What a range does with a target that comes in depends only on the row in
which it closes, one of the first `limit` tokens; for each of these rows the range's own pass finds the target that goes
out and how many shards close. Targets lead from range to range; pointer doubling finds those that the stream really
has in a logarithmic number of rounds, and then each range folds its rows on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.lineage import Scratch


def _pieces(batches: Iterator[pa.RecordBatch], piece: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """piece(stream, range, rows) of each run of rows of one stream and range; rows come sorted by both, then pos."""
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held)
            yield from piece(rows["stream"][0].as_py(), rows["range"][0].as_py(), rows).cast(schema).to_batches()
            held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        stream, part = batch.column("stream"), batch.column("range").to_numpy()
        other = np.array([a != b for a, b in zip(stream[1:].to_pylist(), stream[:-1].to_pylist(), strict=True)], bool) if batch.num_rows > 1 else np.zeros(0, bool)
        cuts = [0, *(np.flatnonzero(other | (np.diff(part) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (held[-1].column("range")[0] != batch.column("range")[a] or held[-1].column("stream")[0] != stream[a]):
                yield from done()
            held.append(batch.slice(a, b - a))
    yield from done()


def _ends(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, list[int]]:
    """Running totals of a piece, and for each row with which a shard starts the row after its last; len + 1: it stays open."""
    totals = np.cumsum(tokens)
    before = totals - tokens
    return totals, (np.searchsorted(totals, before + limit, side="left") + 1).tolist()


def _doors(limit: int, starts: dict):
    """For rows of streams with several ranges: each closing row's total (hi), the target that goes out, and closed shards."""

    def piece(stream, part, rows) -> pa.Table:
        tokens = rows["tokens"].to_numpy()
        totals, ends = _ends(tokens, limit)
        n, base = len(tokens), starts[stream][part]
        out, closed = [0] * (n + 1), [0] * (n + 1)  # of a shard that starts with a row of this piece
        out[n] = base + int(totals[-1]) + limit
        for s in range(n - 1, -1, -1):
            e = ends[s]
            if e > n:
                out[s] = base + int(totals[s] - tokens[s]) + limit
            else:
                out[s], closed[s] = out[e], closed[e] + 1
        doors = [j for j in range(n) if tokens[j] and totals[j] - tokens[j] < limit]
        table = {"stream": pa.array([stream] * len(doors), rows.schema.field("stream").type), "range": [part] * len(doors), "hi": [base + int(totals[j]) for j in doors], "target": [out[j + 1] for j in doors], "closed": [closed[j + 1] + 1 for j in doors]}
        ends_of = np.array(sorted((b, r) for r, b in starts[stream].items()))
        at = np.searchsorted(ends_of[:, 0], table["target"], side="left") - 1  # the range that holds the target
        return pa.table(table | {"to": ends_of[np.maximum(at, 0), 1]})

    return piece


def _numbered(limit: int, begun: dict):
    """Shards of a piece's rows. begun: of ranges after a stream's first, the total with which the open shard closes here
    (None: not here), and its number."""

    def piece(stream, part, rows) -> pa.Table:
        tokens = rows["tokens"].to_numpy()
        totals, ends = _ends(tokens, limit)
        shard, s, at = np.zeros(len(tokens), np.int64), 0, 0
        if (stream, part) in begun:
            close, at = begun[stream, part]
            s = len(tokens) if close is None else int(np.searchsorted(totals, close, side="left")) + 1
            shard[:s] = at
            at += 1
        while s < len(tokens):
            shard[s : ends[s]] = at
            s, at = ends[s], at + 1
        return rows.append_column("shard", pa.array(shard))

    return piece


def shards(rows: DataFrame, limit: int, ranges: int | None = None) -> DataFrame:
    """rows (stream, pos, tokens: none negative) with the shard of each: one closes once it holds `limit` tokens, at least 1,
    and the overshoot is forgotten. The driver gets two numbers for each range of a stream that has several, fewer than two
    such a partition. ranges: their number, by default that of shuffle partitions, of which small ones are joined."""
    scratch, kind = Scratch(rows.sparkSession), dict(rows.dtypes)
    spread = rows.select("stream", "pos", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    dealt = scratch.written(spread.repartitionByRange(*([ranges] if ranges else []), "stream", "pos").withColumn("range", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy("stream", "range").agg(F.sum("tokens").alias("sum"))
    many = Window.partitionBy("stream")
    sums = sums.withColumns({"n": F.count(F.lit(1)).over(many), "first": F.coalesce(F.sum("sum").over(many.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).where("n > 1")
    starts: dict = {}
    for r in sums.collect():
        starts.setdefault(r.stream, {})[r.range] = r["first"]
    order = dealt.repartition("stream", "range").sortWithinPartitions("stream", "range", "pos")
    begun = _begun(dealt, starts, limit, scratch) if starts else {}
    schema = f"stream {kind['stream']}, pos {kind['pos']}, tokens long, range int, shard long"
    types = [*(to_arrow_type(rows.schema[c].dataType) for c in ("stream", "pos")), pa.int64(), pa.int32(), pa.int64()]
    arrow = pa.schema(list(zip(["stream", "pos", "tokens", "range", "shard"], types, strict=True)))
    return order.mapInArrow(lambda batches: _pieces(batches, _numbered(limit, begun), arrow), schema).drop("range")


def _begun(dealt: DataFrame, starts: dict, limit: int, scratch: Scratch) -> dict:
    """See _numbered(): what comes into each range of the streams that have several."""
    spark, kind = dealt.sparkSession, dict(dealt.dtypes)
    wanted = spark.createDataFrame([(s,) for s in starts], f"_s {kind['stream']}")
    some = dealt.join(F.broadcast(wanted), F.col("stream").eqNullSafe(F.col("_s")), "left_semi")
    some = some.repartition("stream", "range").sortWithinPartitions("stream", "range", "pos")
    schema = pa.schema([("stream", to_arrow_type(dealt.schema["stream"].dataType)), ("range", pa.int32()), ("hi", pa.int64()), ("target", pa.int64()), ("closed", pa.int64()), ("to", pa.int32())])
    doors = scratch.written(some.mapInArrow(lambda batches: _pieces(batches, _doors(limit, starts), schema), f"stream {kind['stream']}, range int, hi long, target long, closed long, to int"), "doors")
    # the door by which a target closes: the first of its range whose total reaches it
    asked = doors.select("stream", F.col("to").alias("range"), F.col("target").alias("at"), F.lit(None).cast("long").alias("door"), "hi", "closed", F.lit(1).alias("asks"))
    there = doors.select("stream", "range", F.col("hi").alias("at"), F.col("hi").alias("door"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("closed"), F.lit(0).alias("asks"))
    later = Window.partitionBy("stream", "range").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    jump = asked.unionByName(there).withColumn("next", F.min("door").over(later)).where("asks = 1 and next is not null").select("stream", "hi", "next", "closed")
    jump = scratch.written(jump, "jumps-0")
    # a stream's first shard closes at its first total of `limit`
    first = doors.where(F.col("hi") >= limit).groupBy("stream").agg(F.min("hi").alias("hi"))
    reached, k = scratch.written(first.select("stream", "hi", F.lit(0).cast("long").alias("shard")), "reached-0"), 0
    while True:
        further = jump.withColumnRenamed("stream", "s").join(reached.select("stream", F.col("hi").alias("h"), "shard"), F.col("s").eqNullSafe(F.col("stream")) & (F.col("hi") == F.col("h")))
        further = further.select("stream", F.col("next").alias("hi"), (F.col("shard") + F.col("closed")).alias("shard"))
        grown = scratch.written(reached.unionByName(further).distinct(), f"reached-{k + 1}")
        if grown.count() == reached.count():
            break
        reached, k = grown, k + 1
        on = jump.select(F.col("stream").alias("s"), F.col("hi").alias("h"), F.col("next").alias("n"), F.col("closed").alias("c"))
        jump = scratch.written(jump.join(on, F.col("stream").eqNullSafe(F.col("s")) & (F.col("next") == F.col("h"))).select("stream", "hi", F.col("n").alias("next"), (F.col("closed") + F.col("c")).alias("closed")), f"jumps-{k}")
    met = reached.join(doors.select(F.col("stream").alias("s"), F.col("hi").alias("h"), "range", "closed"), F.col("stream").eqNullSafe(F.col("s")) & (F.col("hi") == F.col("h")))
    by: dict = {}
    for r in met.select("stream", "range", "hi", "shard", "closed").collect():  # one for each range at most
        by.setdefault(r.stream, {})[r.range] = (r.hi, r.shard, r.closed)
    out = {}
    for s, parts in starts.items():
        number = 0
        for part in sorted(parts):
            hi, shard, closed = by.get(s, {}).get(part, (None, number, 0))
            out[s, part] = (None if hi is None else hi - parts[part], shard)
            number = shard + closed
    return out
