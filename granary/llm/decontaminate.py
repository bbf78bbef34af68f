"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton's states are sets of word sequences of the items. A document's words are streamed through it; at
each word the automaton holds the length of the longest item passage that ends there. A document word is hit
when it lies in an occurrence of a window: `window` consecutive words of an item, or a whole shorter item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, table

WINDOW = 13
#: Words of test items in one automaton, which driver and tasks hold; more items are matched in further passes.
BLOCK_WORDS = 200_000

#: Word bytes are digits, letters (lower-cased) and all bytes of non-ASCII characters; other bytes part words.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton over word ids; built once for each block of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.names = [-1], [0], [k for k, _ in items]
        self.short: dict[int, set[int]] = {}
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in ws] for _, ws in items]
        self.sizes = [len(x) for x in coded]
        self.least = min([window, *(len(x) for x in coded if x)])
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: items of which a window ends in the state
        self.items: dict[int, set[int]] = {}
        for k, seq in enumerate(coded):
            state = 0
            for i, c in enumerate(seq):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.items.setdefault(self._at(state, window), set()).add(k)
            if seq and len(seq) < window:
                self.short.setdefault(self._at(state, len(seq)), set()).add(k)

    def _at(self, state: int, n: int) -> int:
        """The state of the last n words of what `state` holds."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, out: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(out)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def runs(self, ws: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Stretches of words that items know, long enough for a window; elsewhere the automaton is in its root."""
        if len(ws) < self.least or not self.ids:
            return
        ids = np.array(list(map(self.ids.get, ws, [-1] * len(ws))))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        for a, b in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] >= self.least]:
            yield int(a), int(b), ids[a:b]

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches of words (start, end), and the items of which windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nexts, links, lengths, window, short = self.next, self.link, self.length, self.window, self.short

        def hit(a: int, b: int) -> None:
            while spans and spans[-1][1] >= a:
                a = min(a, spans.pop()[0])
            spans.append((a, b))

        for start, _, ids in self.runs(ws):
            state, n = 0, 0
            for i, c in enumerate(ids.tolist(), start + 1):
                while state and c not in nexts[state]:
                    state = links[state]
                    n = lengths[state]
                if c in nexts[state]:
                    state, n = nexts[state][c], n + 1
                if n >= window:
                    found |= self.items[self._at(state, window)]
                    hit(i - window, i)
                if short:
                    s = state
                    while s > 0:
                        for k in short.get(s, ()):
                            if (m := self.sizes[k]) <= n:
                                found.add(k)
                                hit(i - m, i)
                        s = links[s]
        return spans, found


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The stated query set in blocks of at most `limit` words (or one item); the driver holds one at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        ws = words((r[1] or "").encode())
        if block and size + len(ws) > limit:
            yield block
            block, size = [], 0
        if ws:
            block.append((r[0], ws))
            size += len(ws)
    yield block


HITS = "struct<n_words: long, span_start: array<long>, span_end: array<long>, items: array<string>>"


def _matcher(items: list[tuple[str | None, list[bytes]]], window: int, name: str):
    """Adds what a block of items finds to the column `name` (HITS), or makes that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = Automaton(items, window)
        longs = pa.list_(pa.int64())
        for batch in batches:
            before = batch.column(name).to_pylist() if name in batch.schema.names else [None] * batch.num_rows
            out: list[list] = [[], [], [], []]
            for text, had in zip(as_bytes(batch.column("text")), before, strict=True):
                ws = words(text)
                spans, found = sam.match(ws)
                starts, ends, names = [a for a, _ in spans], [b for _, b in spans], {sam.names[k] for k in found}
                if had:
                    starts, ends, names = had["span_start"] + starts, had["span_end"] + ends, names.union(had["items"])
                for o, x in zip(out, (len(ws), starts, ends, sorted(names, key=lambda n: (n is None, n))), strict=True):
                    o.append(x)
            hits = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), longs, longs, pa.list_(pa.string())), strict=True)], ["n_words", "span_start", "span_end", "items"])
            rest = [n for n in batch.schema.names if n != name]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), hits], [*rest, name])

    return run


def marked(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """docs with what the items hit in each row's text, in a column of this name (HITS).

    Each block of items is one pass over the rows; between passes the rows are written, so that at any time driver
    and tasks hold one block, and each row of docs gives one row, whatever its doc_id and the number of blocks.
    """
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{name}` {HITS}"
    scratch, rows = None, docs
    for k, items in enumerate(blocks(benchmark, limit)):
        if k:
            scratch = scratch or Scratch(docs.sparkSession)
            rows = scratch.written(rows, f"pass-{k}")
            scratch.drop(f"pass-{k - 1}")
        rows = rows.mapInArrow(_matcher(items, window, name), kinds)
    return rows


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hit word spans and items (each once) of every row of docs (doc_id, text).

    Null and empty texts have no words. Items that are null or have no words match nothing; an item without an
    item_id hits words too, and stands as null in the list; an empty benchmark hits nothing, an empty table gives no
    rows. Further columns of either table are ignored.
    """
    return marked(docs.select("doc_id", "text"), benchmark, "hits", window, limit).select("doc_id", "hits.*")


def union_length(starts: str, ends: str) -> F.Column:
    """Number of words in the union of spans, in any order."""
    spans = F.array_sort(F.arrays_zip(F.col(starts).alias("a"), F.col(ends).alias("b")))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["upto"]))).cast("bigint").alias("n"), F.greatest(acc["upto"], s["b"]).alias("upto"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """The contract's columns: contaminated when at least one word in `one_in` is hit."""
    m = matches(docs, benchmark, window).withColumn("n_hit", union_length("span_start", "span_end"))
    return m.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, cut_spans: bool = False) -> DataFrame:
    """docs without the contaminated rows, all columns as they were. Null and empty texts stay, as do repeated rows.

    cut_spans: hit words of the rows that stay are removed too, with the separators between them.
    """
    name = "hits"
    while name in docs.columns:
        name = f"_{name}"
    rows = marked(docs, benchmark, name, window)
    n_hit = union_length(f"{name}.span_start", f"{name}.span_end")
    rows = rows.where((n_hit == 0) | (one_in * n_hit < F.col(f"{name}.n_words")))
    return rows.mapInArrow(_cutter(name), ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)) if cut_spans else rows.select(*docs.columns)


def _cutter(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True):
                if text and hits["span_start"]:
                    hit = np.zeros(hits["n_words"] + 1, np.int64)
                    np.add.at(hit, hits["span_start"], 1)
                    np.add.at(hit, hits["span_end"], -1)
                    text = without(text.encode(), np.cumsum(hit)[:-1] > 0).decode()
                texts.append(text)
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select([n for n in batch.schema.names if n != name])

    return run


def without(text: bytes, hit: np.ndarray) -> bytes:
    """text less the words marked as hit, and less the separators between two such words."""
    import re

    out, upto = [], 0
    spans = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])))).reshape(-1, 2)
    for a, b in edges:
        out.append(text[upto : spans[a][0]])
        upto = spans[b - 1][1]
    return b"".join([*out, text[upto:]])


def op5_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ITEM_WORDS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP5_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
dw AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, win)),
words_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""
