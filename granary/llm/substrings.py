"""Removal of byte strings that occur more than once in the corpus, by longest previous factors.

A string of `length` bytes at a place of a text is repeated when its longest previous or next factor has `length`
bytes at least: the longest string there that also starts earlier, or later. Factors come from suffix order, by
previous and next smaller positions (suffixes.py). All suffixes of a corpus can't be put in one order cheaply, so
they are ordered in blocks between which no two can agree in `length` bytes: of the windows of `length` bytes each
picks the smallest hash among its `GRAM`-byte strings (its anchor), so that equal windows pick equal anchors at equal
places, and a block holds the stretches of windows of one anchor. Equal stretches are counted before and stand in
their block once. Blocks of more than `BLOCK` bytes, as hot passages in ever new surroundings make them, are parted
further, by whole windows: a block is then one window's string, which is repeated when it stands there twice.

Passages of words are found the same way, in texts written as `MARK` bytes a word (repeated_words).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, Scratch, as_bytes, joined_evenly, table
from .suffixes import SuffixOrder

LENGTH = 400
GRAM = 200
PIECE = 1 << 22  #: window starts of a long text that are worked on at once
BLOCK = 1 << 20  #: bytes of stretches in a block, and in the blocks that are ordered at once
WORDS = 51  #: words of a repeated passage
MARK = 4  #: bytes of a word's hash
_PLACE = np.uint64((1 << 23) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def stretches(text: bytes, rolling: RollingHash, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: first window, number of windows, anchor's hash, hash of the run's bytes."""
    last = len(text) - length + 1
    for at in range(0, last, PIECE):
        n = min(PIECE, last - at)
        prefix = rolling.prefix(np.frombuffer(text, np.uint8, n + length - 1, at))
        places = np.arange(n + length - gram)
        grams = rolling.of(prefix, places, places + gram)
        anchor = sliding_least((grams & ~_PLACE) | places.astype(np.uint64), length - gram + 1) & _PLACE
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.concatenate((first, [n])))
        yield first + at, count, grams[anchor[first].astype(np.int64)], rolling.of(prefix, first, first + count - 1 + length)


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for batch in batches:
            row: list[np.ndarray] = []
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for i, text in enumerate(as_bytes(batch.column("text"))):
                for runs in stretches(text, rolling, length, gram):
                    row.append(np.full(len(runs[0]), i))
                    for p, x in zip(parts, runs, strict=True):
                        p.append(x)
            if row:
                who = pa.array(np.concatenate(row))
                kinds = (np.int32, np.int32, np.int64, np.int64)
                found = [pa.array(np.concatenate(p).astype(k)) if k is np.int32 else pa.array(np.concatenate(p).view(k)) for p, k in zip(parts, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(who), batch.column("u").take(who), *found], ["id", "u", "s", "m", "f", "h"])

    return run


def _bytes_of(length: int):
    """Stretches with their bytes, from texts and their stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, u, text, runs in zip(batch.column("id").to_pylist(), batch.column("u").to_pylist(), as_bytes(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                for r in runs:
                    part = text[r["s"] : r["s"] + r["m"] - 1 + length]
                    rows.append((r["f"], doc_id, u, r["s"], r["c"], part))
                    size += len(part)
                    if size >= BLOCK:
                        yield _records(rows, batch.schema.field("id").type)
                        rows, size = [], 0
            if rows:
                yield _records(rows, batch.schema.field("id").type)

    return run


def _records(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int64(), id_type, pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["f", "id", "u", "s", "c", "part"])


def repeated_windows(parts: list[bytes], length: int, later_only: bool) -> list[np.ndarray]:
    """For each stretch which of its windows are repeated within these blocks, from their longest factors.

    later_only: those with a previous factor alone; the first stays.
    """
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    counts = sizes - length + 1
    first = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) - np.repeat(first - (ends - sizes), counts)
    previous, following = SuffixOrder(np.frombuffer(b"".join(parts), np.uint8), at, np.repeat(ends, counts), length).factors()
    hit = previous >= length if later_only else np.maximum(previous, following) >= length
    return np.split(hit, first[1:])


def _factors(length: int, later_only: bool):
    """u, a, b: spans of repeated windows, of stretches that come by block and in the order of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, block = 0, None

        def judged() -> pa.RecordBatch:
            out: list[list[int]] = [[], [], []]
            hits = repeated_windows([p for *_, p in held], length, later_only)
            for (u, s, c, _), hit in zip(held, hits, strict=True):
                if c > 1 and not later_only:
                    continue  # all of it goes anyway
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])))).reshape(-1, 2)
                for a, b in edges.tolist():
                    for o, x in zip(out, (u, s + a, s + b - 1 + length), strict=True):
                        o.append(x)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["u", "a", "b"])

        for batch in batches:
            for f, u, s, c, part in zip(*(batch.column(n).to_pylist() for n in ("f", "u", "s", "c", "part")), strict=True):
                if f != block and size >= BLOCK:
                    yield judged()
                    held, size = [], 0
                block = f
                held.append((u, s, c, part))
                size += len(part)
        if held:
            yield judged()

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for batch in batches:
            for doc_id, u, text, runs in zip(batch.column("id").to_pylist(), batch.column("u").to_pylist(), as_bytes(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                for r in runs:
                    prefix = rolling.prefix(np.frombuffer(text, np.uint8, r["m"] + length - 1, r["s"]))
                    at = np.arange(r["m"])
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * r["m"], batch.schema.field("id").type), pa.array(np.full(r["m"], u)), pa.array((at + r["s"]).astype(np.int32)), pa.array(rolling.of(prefix, at, at + length).view(np.int64)), pa.array(np.full(r["m"], r["c"], np.int32))], ["id", "u", "s", "w", "c"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 100_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return grouped


def marks(text: bytes, rolling: RollingHash) -> bytes:
    """MARK bytes for each word; words are what blanks and control characters of ASCII part."""
    block = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], block > 32, [False]))
    begin, end = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T
    parts: list[bytes] = []
    at = 0
    while at < len(begin):
        first = begin[at]
        to = max(at + 1, int(np.searchsorted(end, first + PIECE, "right")))
        prefix = rolling.prefix(block[first : end[to - 1]])
        parts.append(rolling.of(prefix, begin[at:to] - first, end[at:to] - first).astype(f"<u{MARK}").tobytes())
        at = to
    return b"".join(parts)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = RollingHash()
    for batch in batches:
        marked = pa.array([marks(t, rolling) for t in as_bytes(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), marked, batch.column("u")], ["doc_id", "text", "u"])


def _words_within(words: int):
    """u, n_repeated_words: whole words in those spans that hold `words` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            for runs in batch.column("spans").to_pylist():
                spans = [(-(-r["a"] // MARK), r["b"] // MARK) for r in runs]
                whole = np.array([x for x in spans if x[1] - x[0] >= words], np.int64).reshape(-1, 2)
                counts.append(int(covered(whole.max(initial=0), whole[:, 0], whole[:, 1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array(counts, pa.int64())], ["u", "n_repeated_words"])

    return run


def repeated_words(rows: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """u, n_repeated_words: of texts of rows (doc_id, text, u), the words in strings of `words` words that also start anywhere else.

    Texts without any may be left out. Words are compared by 32 bits of their hash, in case and with punctuation.
    """
    marked = rows.mapInArrow(_marks, f"doc_id {dict(rows.dtypes)['doc_id']}, text binary, u long").where(F.octet_length("text") >= MARK * words)
    spans = repeated_spans(scratch.written(marked, "marks"), scratch, MARK * words, MARK * max(1, words // 3))
    return spans.mapInArrow(_words_within(words), "u long, n_repeated_words long")


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps)[:-1] > 0


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = as_bytes(batch.column("text")), batch.column("spans").to_pylist()
        at = 0
        while at < len(texts):
            rows, size, begin = [], 0, at
            while at < len(texts) and size < PIECE:
                text, runs = texts[at], spans[at]
                n, kept = 0, text
                if runs:
                    gone = covered(len(text), np.array([r["a"] for r in runs]), np.array([r["b"] for r in runs]))
                    n = int(np.count_nonzero(np.diff(np.concatenate(([False], gone))) & gone))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), bool(n), kept.decode(errors="replace")))
                size += len(text)
                at += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
            more = [n for n in batch.schema.names if n == "n_repeated_words"]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] + [batch.column(n).slice(begin, at - begin) for n in more]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, at - begin), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", "text", *more])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and u, a 64-bit hash of both: rows that repeat both share it."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(2)).alias("u"))


def repeated_spans(rows: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, later_only: bool = False) -> DataFrame:
    """u, spans (a, b): the bytes to go from each text of rows (doc_id, text, u) that loses any.

    Frequent anchors, stretches and windows are joined by broadcasts of fewer than MANY keys (joined_evenly).
    """
    order = F.col("doc_id") if later_only else F.lit(0)
    long_ = rows.where(F.octet_length("text") >= length).select(order.alias("id"), "u", "text")
    kind = dict(long_.dtypes)["id"]
    count = F.count(F.lit(1)).alias("n")
    runs = scratch.written(long_.mapInArrow(_anchors(length, gram), f"id {kind}, u long, s int, m int, f long, h long"), "runs")
    often = scratch.written(runs.groupBy("f").agg(count).where("n > 1"), "often")
    some = scratch.written(joined_evenly(runs, often, "f", "n").drop("n"), "some")
    scratch.drop("runs", "often")
    classes = scratch.written(some.groupBy("f", "h").agg(count, F.min(F.struct("id", "u", "s", "m")).alias("one")), "classes")
    sizes = classes.groupBy("f").agg(F.count_if(F.col("n") == 1).alias("lone"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("one.m") + F.lit(length - 1)).alias("bytes"))
    blocks = scratch.written(sizes.where("kinds > 1").where(F.lit(later_only) | (F.col("lone") > 0)).select("f", "kinds", (F.col("bytes") > BLOCK).alias("hot")), "blocks")
    open_ = scratch.written(joined_evenly(classes, blocks, "f", "kinds").select("f", "hot", "one.*", F.least(F.col("n"), F.lit(2)).cast("int").alias("c")), "open")
    copies = scratch.written(classes.where("n > 1").select("f", "h", "n", F.col("one.u").alias("first_u"), F.col("one.s").alias("first_s")), "copies")
    is_first = (F.col("u") == F.col("first_u")) & (F.col("s") == F.col("first_s"))
    equal = joined_evenly(some, copies, ["f", "h"], "n").where(~(F.lit(later_only) & is_first))
    equal = equal.select("u", F.col("s").alias("a"), (F.col("s") + F.col("m") - 1 + length).alias("b"))

    def asked(hot: bool) -> DataFrame:
        runs = open_.where("hot" if hot else "not hot").groupBy("u").agg(F.collect_list(F.struct("f", "s", "m", "c")).alias("runs"))
        return long_.join(runs, "u").dropDuplicates(["u"]).select("id", "u", "text", "runs")

    parts = asked(False).mapInArrow(_bytes_of(length), f"f long, id {kind}, u long, s int, c int, part binary")
    by_block = parts.repartition("f").sortWithinPartitions("f", "id", "u", "s").select("f", "u", "s", "c", "part")
    found = by_block.mapInArrow(_factors(length, later_only), "u long, a long, b long")
    windows = scratch.written(asked(True).mapInArrow(_windows(length), f"id {kind}, u long, s int, w long, c int"), "windows")
    first = F.min(F.struct("id", "u", "s"))
    same = windows.groupBy("w").agg(F.sum("c").alias("n"), first.alias("one")).where("n > 1")
    same = scratch.written(same.select("w", "n", F.col("one.u").alias("first_u"), F.col("one.s").alias("first_s")), "same")
    hot = joined_evenly(windows, same, "w", "n").where(~is_first if later_only else F.col("c") == 1)
    hot = hot.select("u", F.col("s").cast("long").alias("a"), (F.col("s") + length).cast("long").alias("b"))
    return equal.unionByName(found).unionByName(hot).groupBy("u").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


_TABLES = ("some", "classes", "blocks", "copies", "open", "windows", "same")


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, later_only: bool = False, words: int = 0) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text), whether it loses any byte, and the text that is left.

    Null texts count as empty. Texts shorter than `length` bytes lose nothing. Rows that repeat doc_id and text are
    copies of each other. An empty table gives no rows; further columns are ignored. Bytes in blocks are compared;
    equal stretches are told by two 64-bit hashes, windows of hot blocks by one. Bytes that are no longer a
    character, where a span ends within one, are replaced in the text, not in kept_sha256.

    later_only: the first copy of a string stays, by doc_id and place; rows that repeat doc_id and text keep or lose
    it together, and different texts of one doc_id stand in the order of a hash.

    words: if given, n_repeated_words follows (see repeated_words). It removes nothing, and first copies count too.
    """
    rows = keyed(docs)
    scratch = Scratch(docs.sparkSession)
    spans = scratch.written(repeated_spans(rows, scratch, length, gram, later_only), "spans")
    scratch.drop(*_TABLES)
    kind = dict(docs.dtypes)["doc_id"]
    joined, columns = rows.join(spans, "u", "left"), ["doc_id", "text", "spans"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean, text string"
    if words:
        counts = scratch.written(repeated_words(rows, scratch, words), "words")
        scratch.drop("marks", *_TABLES)
        joined = joined.join(counts, "u", "left").withColumn("n_repeated_words", F.coalesce("n_repeated_words", F.lit(0)))
        columns, schema = [*columns, "n_repeated_words"], f"{schema}, n_repeated_words long"
    return joined.select(*columns).mapInArrow(_remove, schema)


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), words=WORDS)
