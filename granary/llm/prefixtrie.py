"""The trie of conversations' turns, by distributed MSD radix partitioning.

Turns become dictionary ids. A bucket holds the conversations that share a prefix; it begins as all conversations. In
rounds, each large bucket goes on along what all its members still share and is then dealt out by the next turn;
ends and pieces of these steps are DataFrame operations, however many members a bucket has. A bucket of one conversation
is a chain, whatever its length, and its rows are its nodes. Buckets of at most LOCAL_TURNS further turns are local:
multikey quicksort finishes them, and its recursion emits their nodes. What nodes sum over their subtrees goes up from
the last round to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ledger import running_total
from .common import Scratch, joined_evenly, table
from .resample import CRC_SQL, crc_sql

LOCAL_TURNS = 1000  #: a bucket of at most so many turns is finished in one task
PILE = 50_000  #: so many turns of local buckets are taken at once
CHUNK = 1 << 20  #: bytes of joined ids in a row on their way to a digest
SHARE, HEADS = 5, 9  #: conversations whose ids agree but for the remainder by SHARE have 0 to HEADS - 1 first turns in common
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id, with their number within it in this partition, and the partition's number."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        index = []
        for c in batch.column("conv_id").to_pylist():
            n = n + 1 if c == last else 1
            last = c
            index.append(n)
        columns = [*(batch.column(c) for c in ("conv_id", "key", "bytes")), pa.array([part] * len(index), pa.int32()), pa.array(index, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "key", "bytes", "part", "idx"])


def encoded(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos, tid, bytes: each turn's place from 1 on, the id of its role and text, its text's UTF-8 bytes.

    Equal role and text have one id; they are told by SHA-256. A conversation may hold most turns: places are counted in
    ranges of (conv_id, turn), and what earlier ranges hold is added, for at most one conversation a range.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = scratch.written(dealt.mapInArrow(_indexed, "conv_id long, key binary, bytes long, part int, idx long"), "ranked")
    held = ranked.groupBy("conv_id", "part").agg(F.max("idx").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = held.select("conv_id", "part", before.alias("before")).where("before > 0")  # one row for each range at most
    keys = scratch.written(ranked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("tid", F.monotonically_increasing_id()), "keys")
    ids = joined_evenly(ranked, keys, "key", "n").join(F.broadcast(carried), ["conv_id", "part"], "left")
    own = scratch.written(ids.select("conv_id", (F.col("idx") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "bytes"), "own")
    scratch.drop("ranked", "keys")
    return own


def rebuilt(own: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (c, len) and rows (c, p, tid, bytes, len): each conversation c with the first h turns of conversation
    c - c % SHARE in place of its own first h; h is the CRC-32 of c in decimal modulo HEADS."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % SHARE).alias("base"), h)
    convs = scratch.written(convs, "sizes")
    bases = convs.select(F.col("conv_id").alias("base"), F.least("n", F.lit(HEADS)).alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = scratch.written(convs.select("conv_id", "n", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    late = joined_evenly(own, convs, "conv_id", "n").where("pos > h").select(F.col("conv_id").alias("c"), (F.col("k") + F.col("pos") - F.col("h")).alias("p"), "tid", "bytes", "len")
    heads = own.where(F.col("pos") < HEADS).join(convs.select(F.col("conv_id").alias("c"), F.col("base").alias("conv_id"), "h", "len"), "conv_id")  # fewer than 2 SHARE rows of HEADS - 1 turns a key
    rows = late.unionByName(heads.where("pos <= h").select("c", F.col("pos").alias("p"), "tid", "bytes", "len"))
    return convs.select(F.col("conv_id").alias("c"), "len"), scratch.written(rows, "rebuilt")


def multikey(first: list[int], upto: list[int], tid: list[int], tops: list[tuple[int, int]], emit, ends) -> None:
    """Multikey quicksort of sequences tid[first[i]:upto[i]], i in ranges `tops` that each share their first id.

    emit(parent, members, k, at) is called for each group that shares k ids, parents first, and gives the node's number;
    `at` is a place of its last id. ends(node, members) gets those that end there. The stack holds what is left to sort.
    """
    stack = []
    for lo, hi in tops:
        group = list(range(lo, hi))
        stack.append((group, 1, emit(-1, group, 1, first[lo])))
    while stack:
        group, k, node = stack.pop()
        if len(group) == 1:  # a chain
            i = group[0]
            for at in range(first[i] + k, upto[i]):
                k += 1
                node = emit(node, group, k, at)
            ends(node, group)
            continue
        digit = lambda i, k=k: tid[first[i] + k] if first[i] + k < upto[i] else -1
        a, b, c = digit(group[0]), digit(group[len(group) // 2]), digit(group[-1])
        pivot = sorted((a, b, c))[1]
        less, same, more = [], [], []
        for i in group:
            d = digit(i)
            (same if d == pivot else less if d < pivot else more).append(i)
        for part in (less, more):
            if part:
                stack.append((part, k, node))
        if pivot < 0:
            ends(node, same)
        else:
            stack.append((same, k + 1, emit(node, same, k + 1, first[same[0]] + k)))


class _Pile:
    """Whole local buckets of sorted rows (bucket, c, p), and the nodes that quicksort finds in them."""

    NAMES = ("bucket", "c", "p", "tid", "bytes", "parent_conv")

    def __init__(self, columns: list[list[int]]) -> None:
        bucket, self.c, depth, tid, self.bytes, above = columns
        starts = [i for i in range(len(bucket)) if not i or bucket[i] != bucket[i - 1] or self.c[i] != self.c[i - 1]]
        self.first, upto = starts, [*starts[1:], len(bucket)]
        marks = [k for k, i in enumerate(starts) if not k or bucket[i] != bucket[i - 1]]
        tops = list(zip(marks, [*marks[1:], len(starts)], strict=True))
        self.nodes: list[list] = []
        self.top, self.depth, self.above, self.bucket = {}, depth, above, bucket
        multikey(starts, upto, tid, tops, self.emit, self.ends)

    def emit(self, parent: int, members: list[int], k: int, at: int) -> int:
        conv, n = min(self.c[self.first[i]] for i in members), len(members)
        above = self.nodes[parent][0] if parent >= 0 else self.above[at]
        if parent >= 0:
            self.nodes[parent][4] += 1
        top = self.bucket[at] if parent < 0 else None
        self.nodes.append([conv, self.depth[at], above, n, 0, 0, (n - 1) * self.bytes[at], NO_ENDS, top, parent])
        return len(self.nodes) - 1

    def ends(self, node: int, members: list[int]) -> None:
        ids = sorted(self.c[self.first[i]] for i in members)
        self.nodes[node][7] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

    def finished(self) -> list[list]:
        for node in reversed(self.nodes):  # parents come before their children
            if not node[4]:
                node[5] = 1
            if node[9] >= 0:
                up = self.nodes[node[9]]
                up[5] += node[5]
                up[6] += node[6]
        return self.nodes


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of local buckets, sorted by bucket, c and p, as nodes; a bucket's first node carries its number."""
    kinds = [*[pa.int64()] * 7, pa.string(), pa.int64()]
    names = [*(x.split()[0] for x in NODE.split(", ")), "bucket"]

    def nodes(columns: list[list[int]]) -> pa.RecordBatch:
        done = list(zip(*(n[:9] for n in _Pile(columns).finished()), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(done, kinds, strict=True)], names)

    held: list[list[int]] = [[] for _ in _Pile.NAMES]
    for batch in batches:
        for x, name in zip(held, _Pile.NAMES, strict=True):
            x += batch.column(name).to_pylist()
        bucket = held[0]
        if len(bucket) >= PILE:
            cut = len(bucket)
            while cut and bucket[cut - 1] == bucket[-1]:
                cut -= 1
            if cut:
                yield nodes([x[:cut] for x in held])
                held = [x[cut:] for x in held]
    if held[0]:
        yield nodes(held)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and c: their decimal ids, comma-joined, in rows of about CHUNK bytes."""
    part, number, last, ids, size = TaskContext.get().partitionId(), 0, None, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([(part << 32) + number], pa.int64()), pa.array([",".join(ids)])], ["bucket", "at", "ids"])

    for batch in batches:
        for bucket, c in zip(batch.column("bucket").to_pylist(), batch.column("c").to_pylist(), strict=True):
            if ids and (bucket != last or size >= CHUNK):
                yield row()
                number, ids, size = number + 1, [], 0
            last = bucket
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by bucket and place: the SHA-256 of each bucket's, comma-joined; one chunk is held."""
    last, digest = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([digest.hexdigest()])], ["bucket", "ends_sha256"])
    for batch in batches:
        for bucket, ids in zip(batch.column("bucket").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if bucket != last:
                if digest:
                    yield done()
                last, digest = bucket, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if digest:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """bucket, ends_sha256 of rows bucket, c, however many a bucket has: a digest is sequential, so its task reads what a
    bucket has as text in megabyte rows, made by ranges of c."""
    text = ends.repartitionByRange("bucket", "c").sortWithinPartitions("bucket", "c").mapInArrow(_chunks, "bucket long, at long, ids string")
    return text.repartition("bucket").sortWithinPartitions("bucket", "at").mapInArrow(_digests, "bucket long, ends_sha256 string")


def trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The contract's columns for every node of the rebuilt conversations (conv_id, turn, role, text).

    Null turns come first; turns of equal number are ordered by the SHA-256 of role and text, repeated rows are turns of
    their own. Null role or text is empty. Rows without a conv_id belong to no conversation. An empty table gives no rows;
    further columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession)
    members, rows = rebuilt(encoded(conversations, scratch), scratch)
    if members.isEmpty():
        return conversations.sparkSession.createDataFrame([], NODE)
    buckets = members.agg(F.min("c").alias("conv"), F.count(F.lit(1)).alias("n"), F.sum("len").alias("turns"))
    buckets = scratch.written(buckets.select(F.lit(0).cast("long").alias("bucket"), "conv", "n", "turns", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("long").alias("parent_conv")), "buckets-0")
    members, rows = members.withColumn("bucket", F.lit(0).cast("long")), rows.withColumn("bucket", F.lit(0).cast("long"))
    segments, dealt = [], []
    while True:
        k = len(segments)
        shared, live = _along(buckets, rows, scratch, k)
        ends = joined_evenly(members, shared[0].select("bucket", "e", "n"), "bucket", "n").where("len = e").select("bucket", "c")
        digests = scratch.written(end_digests(ends), f"ends-{k}")
        children, some, rest = _dealt(shared[0], live, scratch, k, local_turns)
        segments.append((*shared, digests, children))
        dealt.append((some, rest))
        buckets, members, rows = (x.where("kind = 'large'") for x in (children, some, rest))
        if buckets.isEmpty():
            break
    return _nodes(segments, dealt, scratch)


def _along(buckets: DataFrame, rows: DataFrame, scratch: Scratch, k: int) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
    """Large buckets with the depth e up to which all members agree, the steps (bucket, p, bytes) there, and what is
    left of the rows."""
    stats = rows.groupBy("bucket", "p").agg(F.min("tid").alias("a"), F.max("tid").alias("b"), F.count(F.lit(1)).alias("there"), F.min("bytes").alias("step"))
    stats = scratch.written(stats, f"stats-{k}")
    odd = (F.col("a") != F.col("b")) | (F.col("there") != F.col("n"))
    upto = joined_evenly(stats, buckets.select("bucket", "n", "turns"), "bucket", "turns").groupBy("bucket").agg(F.min(F.when(odd, F.col("p"))).alias("odd"), F.max("p").alias("last"))
    upto = buckets.join(upto, "bucket", "left").withColumn("e", F.coalesce(F.col("odd") - 1, "last", "depth")).drop("odd", "last")
    upto = scratch.written(upto, f"segments-{k}")
    steps = joined_evenly(stats, upto.select("bucket", "e", "turns"), "bucket", "turns").where("p <= e").select("bucket", "p", F.col("step").alias("bytes"))
    live = joined_evenly(rows, upto.select("bucket", "e", "conv", "turns"), "bucket", "turns").where("p > e")
    return (upto, steps), scratch.written(live.select("bucket", "c", "p", "tid", "bytes", "len", "e", "conv"), f"live-{k}")


def _dealt(upto: DataFrame, live: DataFrame, scratch: Scratch, k: int, local_turns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next buckets, one for each bucket and turn after what it shares; their members; the members' further rows.

    kind: single (one member), local (few turns) or large. Bucket numbers are unique over all rounds.
    """
    heads = live.where("p = e + 1")
    children = heads.groupBy(F.col("bucket").alias("parent"), "tid").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("conv"), F.min("bytes").alias("bytes"), F.min("p").alias("depth"), F.min("conv").alias("parent_conv"), F.sum(F.col("len") - F.col("p")).alias("turns"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("turns") + F.col("n") <= local_turns, "local").otherwise("large")
    children = scratch.written(children.withColumns({"bucket": F.monotonically_increasing_id() + F.lit((k + 1) << 54), "kind": kind}), f"buckets-{k + 1}")
    which = children.select(F.col("parent").alias("bucket"), "tid", "n", F.col("bucket").alias("child"), "kind", "parent_conv")
    some = joined_evenly(heads.drop("conv"), which, ["bucket", "tid"], "n").select(F.col("child").alias("bucket"), "c", "len", "kind", "p", "tid", "bytes", "parent_conv")
    some = scratch.written(some, f"members-{k + 1}")
    rest = joined_evenly(live.where("p > e + 1").drop("bucket", "len", "conv"), some.select("bucket", "c", "len", "kind", "parent_conv"), "c", "len")
    return children, some, scratch.written(rest.select("bucket", "c", "p", "tid", "bytes", "len", "kind", "parent_conv"), f"rows-{k + 1}")


def _nodes(segments: list[tuple], dealt: list[tuple], scratch: Scratch) -> DataFrame:
    """All nodes: of local buckets, of single conversations, and of what large buckets share."""
    union = lambda kind, name: _union([x.where(f"kind = '{kind}'") for pair in dealt for x in (pair if name == "all" else pair[:1])])
    every = union("local", "all").repartition("bucket").sortWithinPartitions("bucket", "c", "p")
    local = scratch.written(every.select(*_Pile.NAMES).mapInArrow(_local, f"{NODE}, bucket long"), "local")
    chain = [x.where("kind = 'single'").select("bucket", "c", "p", "len", F.col("parent_conv") if first else F.col("c").alias("parent_conv")) for pair in dealt for first, x in zip((True, False), pair, strict=True)]
    last = F.col("p") == F.col("len")
    one = F.lit(1).cast("long")
    chain = _union(chain).select(
        F.col("c").alias("conv_id"), F.col("p").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    names, out = chain.columns, [local.select(*chain.columns), chain]
    below = local.where("bucket is not null").select("bucket", "n_leaves", "saved_tokens")
    large = None
    for k in reversed(range(len(segments))):
        upto, steps, digests, children = segments[k]
        known = below if large is None else below.unionByName(large)
        under = children.join(known, "bucket", "left").groupBy(F.col("parent").alias("bucket"))
        under = under.agg(F.count(F.lit(1)).alias("n_children"), F.sum(F.coalesce("n_leaves", F.lit(1))).alias("n_leaves"), F.sum(F.coalesce("saved_tokens", F.lit(0))).alias("under"))
        seg = upto.join(under, "bucket", "left").join(digests, "bucket", "left").na.fill(0, ["n_children", "under"]).na.fill(1, ["n_leaves"]).na.fill(NO_ENDS, ["ends_sha256"])
        places = running_total(upto.select("bucket", F.col("depth").alias("p"), "bytes").unionByName(steps), "bucket", "p", "bytes")
        places = scratch.written(places, f"places-{k}")
        seg = scratch.written(seg.drop("bytes").join(places.groupBy("bucket").agg(F.sum("bytes").alias("chain"), F.count(F.lit(1)).alias("steps")), "bucket"), f"known-{k}")
        nodes = joined_evenly(places, seg, "bucket", "steps").withColumn("down", F.col("chain") - F.col("before"))
        last, top = F.col("p") == F.col("e"), F.col("p") == F.col("depth")
        nodes = nodes.select(
            "bucket", F.col("conv").alias("conv_id"), F.col("p").alias("depth"), F.when(top, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("under") + (F.col("n") - 1) * F.col("down")).alias("saved_tokens"),
            F.when(last, F.col("ends_sha256")).otherwise(NO_ENDS).alias("ends_sha256"), top.alias("top"),
        )
        nodes = scratch.written(nodes, f"nodes-{k}")
        large = nodes.where("top").select("bucket", "n_leaves", "saved_tokens")
        out.append(nodes.select(*names))
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x.select(*whole.columns))
    return whole


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
WITH {CRC_SQL.strip()},
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
  sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, n, conv_id - conv_id % {SHARE} AS base, {crc_sql("conv_id::VARCHAR")} % {HEADS} AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, pos AS p, key, bytes FROM k JOIN t ON t.conv_id = k.base WHERE pos <= h UNION ALL SELECT k.conv_id, k + pos - h, key, bytes FROM k JOIN t USING (conv_id) WHERE pos > h),
m AS (SELECT conv_id, 0 AS p, '' AS path, 0 AS bytes FROM k UNION ALL SELECT conv_id, p, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY p), bytes FROM r),
l AS (SELECT conv_id, p, sha256(path) AS node, lag(sha256(path)) OVER w AS parent, bytes, p = max(p) OVER (PARTITION BY conv_id) AS ends FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
n AS (SELECT node, any_value(parent) AS parent, any_value(p) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) * (count(*) - 1) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM l GROUP BY node),
f AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT DISTINCT a.node AS node, b.node AS under FROM l a JOIN l b ON a.conv_id = b.conv_id AND b.p >= a.p),
s AS (SELECT u.node, count(*) FILTER (f.node IS NULL) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u JOIN n ON n.node = u.under LEFT JOIN f ON f.node = u.under GROUP BY u.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s USING (node) LEFT JOIN f USING (node) LEFT JOIN n above ON above.node = n.parent
"""
