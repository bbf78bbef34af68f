"""Document fingerprints by invertible Bloom lookup tables.

A text's paragraphs are hashed into the cells of a small table. Subtracting two texts' tables cancels what they
share; peeling the rest recovers the digests of the paragraphs that differ. When peeling sticks, both tables are
built again with more cells.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table

CELLS = 32  #: cells of the stored fingerprint, a multiple of HASHES
HASHES = 4
GROWTH = 4
#: Paragraphs end at line ends; here also after marks that close a clause, so that short texts have several.
PARAGRAPH = re.compile(rb"[^\n.,;:!?]+[.,;:!?]*")
ROWS_IN_RANGE = 500  #: rows of one range of doc_id, those that are worked on in order
MAX_RANGES = 65_536

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PARTS = np.arange(HASHES, dtype=np.uint64)[:, None]
_SALTS = mix(np.arange(1, 1 + HASHES, dtype=np.uint64))


def digests(text: bytes) -> np.ndarray:
    """Distinct 64-bit digests of paragraphs; the k-th repetition of one is a paragraph of its own.

    A text of which nothing but marks and line ends is left is one paragraph.
    """
    parts = [p.strip() for p in PARAGRAPH.findall(text)]
    seen: dict[bytes, int] = {}
    out = []
    for p in parts or [text]:
        if p or not parts:
            n = seen[p] = seen.get(p, -1) + 1
            out.append(hash64(p if not n else p + b"\n%d" % n))
    return np.array(out or [hash64(text)], np.uint64)


def hash64(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") or 1


class Table:
    """Cells: how many digests, their exclusive or, and the exclusive or of their checks."""

    def __init__(self, keys: np.ndarray, cells: int, sign: np.ndarray | None = None) -> None:
        self.cells = cells
        self.count, self.keys, self.checks = np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        if len(keys):
            self.put(keys, np.ones(len(keys), np.int64) if sign is None else sign)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """HASHES cells of each key, one in each part of the table; all first ones, then all second ones..."""
        part = self.cells // HASHES
        at = mix(keys + _SALTS[:, None]) % np.uint64(part)
        at += _PARTS * np.uint64(part)
        return at.ravel().view(np.int64)

    def put(self, keys: np.ndarray, sign: np.ndarray) -> None:
        at = self.places(keys)
        np.add.at(self.count, at, np.concatenate([sign] * HASHES))
        np.bitwise_xor.at(self.keys, at, np.concatenate([keys] * HASHES))
        np.bitwise_xor.at(self.checks, at, np.concatenate([mix(keys ^ _GOLD)] * HASHES))

    def minus(self, other: Table) -> Table:
        out = Table(np.zeros(0, np.uint64), self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests and the side (1 or -1) of what differs, or None when some can't be told."""
        keys, signs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _ in range(4 * self.cells + 4):
            pure = np.flatnonzero((np.abs(self.count) == 1) & (mix(self.keys ^ _GOLD) == self.checks))
            if not len(pure):
                break
            k, first = np.unique(self.keys[pure], return_index=True)
            s = self.count[pure][first]
            keys.append(k)
            signs.append(s)
            self.put(k, -s)
        if self.count.any() or self.keys.any():
            return None
        return np.concatenate(keys), np.concatenate(signs)

    def text(self) -> str:
        return f"{self.cells}:" + b"".join(a.astype(t).tobytes() for a, t in ((self.count, "<i4"), (self.keys, "<u8"), (self.checks >> np.uint64(32), "<u4"))).hex()


def difference(a: np.ndarray, b: np.ndarray, cells: int = CELLS, first: tuple[Table, Table] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in a, and only in b, by subtracting and peeling tables, larger ones after each failure.

    From 4 cells a digest on a failure leaves nothing to be saved by a sketch, and the sets are compared.
    """
    while True:
        less = first[0].minus(first[1]) if first else Table(np.concatenate([a, b]), cells, np.repeat([1, -1], [len(a), len(b)]))
        got = less.peel()
        if got is not None:
            return got[0][got[1] > 0], got[0][got[1] < 0]
        cells, first = GROWTH * cells, None
        if cells > 4 * GROWTH * (len(a) + len(b)) + 64:
            return np.setdiff1d(a, b), np.setdiff1d(b, a)


def likeness(a: np.ndarray, b: np.ndarray, first: tuple[Table, Table] | None = None) -> float:
    """Shared digests over all of both, from the recovered difference."""
    only_a, only_b = difference(a, b, first=first)
    shared = (len(a) - len(only_a) + len(b) - len(only_b)) / 2
    return float(shared / (shared + len(only_a) + len(only_b)))


def fingerprint(text: str, cells: int = CELLS) -> str:
    return Table(digests(text.encode()), cells).text()


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following one."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and doc_id, each range closed by its follower's first row (tail)."""
    held: tuple | None = None  # range, doc_id, text, digests, table

    def known(r: int, doc_id, text: str) -> tuple:
        d = digests(text.encode())
        return r, doc_id, text, d, Table(d, CELLS)

    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(n).to_pylist() for n in ("range", "tail", "doc_id", "text")]
        for r, tail, doc_id, text in zip(*columns, strict=True):
            if held is not None and held[0] != r:
                raise ValueError(f"range {held[0]} has no follower")
            now = known(r, doc_id, text or "")
            if held is not None and held[0] == r:
                _, old_id, old, d, t = held
                new = edited(old, now[2])
                e = digests(new.encode())
                te = Table(e, CELLS)
                rows.append((old_id, len(old), hashlib.sha256(new.encode()).hexdigest(), t.text(), te.text(), likeness(d, e, (t, te)), likeness(d, now[3], (t, now[4]))))
            held = None if tail else now
        kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    if held is not None:
        raise ValueError(f"range {held[0]} has no follower")


def compared(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text).

    Null texts count as empty; the empty text has one empty paragraph. Rows of null doc_id come before all
    others, rows of equal doc_id are in order of their texts, within one task. The only row of a table is its own follower. An
    empty table gives no rows; further columns are ignored. doc_id must be of an integer type; others raise TypeError.

    doc_id is cut into ranges; the first rows of a range, all those with its lower bound, go to the range before
    too, where the first of them follows the last row, so that no range waits for another. The quantiles are
    doubles and only place the ranges; the bounds themselves are doc_ids of the table.
    """
    spark = docs.sparkSession
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be an integer: its order says which document is next")
    rows = docs.select("doc_id", "text")
    ids = docs.select("doc_id")
    n, = ids.agg(F.count("doc_id")).first()
    first, greatest = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    ranges = max(1, min(MAX_RANGES, n // ROWS_IN_RANGE))
    probe = [i / ranges for i in range(1, ranges)]
    near = sorted({min(max(int(x), first), greatest) for x in ids.where("doc_id is not null").approxQuantile("doc_id", probe, 1 / (4 * ranges))}) if probe else []
    cuts = _lowest(ids, near)[1:]
    placed = rows.withColumn("range", _place(F.col("doc_id"), cuts)).withColumn("tail", F.lit(False))
    tails = placed.where(F.col("doc_id").isin(cuts)).withColumn("range", F.col("range") - 1).withColumn("tail", F.lit(True))
    has_null = bool(ids.where("doc_id is null").take(1))
    lowest = rows.where(F.col("doc_id").isNull() if has_null or first is None else F.col("doc_id") == F.lit(first))
    last = lowest.orderBy("text").limit(1).withColumn("range", F.lit(len(cuts))).withColumn("tail", F.lit(True))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = placed.unionByName(tails).unionByName(last).repartition(parts, "range").sortWithinPartitions("range", "tail", "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    return dealt.mapInArrow(_judge, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _lowest(ids: DataFrame, near: list[int]) -> list[int]:
    """The lowest doc_id of each range that the places in `near` part, in order; ranges without one are left out."""
    if not near:
        return []
    return sorted(r[0] for r in ids.where("doc_id is not null").groupBy(_place(F.col("doc_id"), near)).agg(F.min("doc_id").alias("m")).select("m").collect())


def _place(x: F.Column, cuts: list[int]) -> F.Column:
    """How many of the sorted cuts are at most x: binary search in a literal array; of null, 0."""
    if not cuts:
        return F.lit(0)
    values = F.lit(cuts)
    ends = F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("b"))

    def halve(acc, _):
        middle = ((acc["a"] + acc["b"]) / 2).cast("int")
        upper = F.struct((middle + 1).alias("a"), acc["b"].alias("b"))
        return F.when(acc["a"] >= acc["b"], acc).when(F.element_at(values, middle + 1) <= x, upper).otherwise(F.struct(acc["a"].alias("a"), middle.alias("b")))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), ends, halve, lambda acc: acc["a"])
    return F.coalesce(F.when(x.isNotNull(), found), F.lit(0))


def op6_invertible_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
