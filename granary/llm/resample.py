"""Importance resampling of documents towards a target distribution.

Words are hashed into buckets; a bucket's gain says how much more frequent it is in the target than in the corpus. A
document's weight is the mean gain of its words, taken from one array of gains; with a Gumbel key of the document's own
added to it, the documents of highest score are a draw without replacement in proportion to the exponential weights.

The draw is an external merge. Each partition's eligible documents are a sorted run. A histogram of scores, which
are integers of bounded size, gives the draw count and the score it ends at; what is below never moves. The rest is
cut into ranges of score, and in each range a tournament tree merges the pieces of all runs, so that no task gets
all drawn documents however many are drawn. Ranks go on from range to range and stop at the exact count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
SLICE = 500_000  #: words whose gains are looked up at once
RANGE_ROWS = 100_000  #: about so many drawn rows are merged by one task


def buckets_of(text: F.Column) -> F.Column:
    """Buckets of a text's words in their order, as an array of smallints; null texts have none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(WORD), 0)
    return F.transform(words, lambda w: (F.crc32(w.cast("binary")) % BUCKETS).cast("smallint"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each bucket in one partition: an array of numbers whatever its size."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["bucket", "n"])


def histogram(hashed: DataFrame) -> np.ndarray:
    """Occurrences of each bucket; BUCKETS numbers at most come to the driver."""
    counts = np.zeros(BUCKETS, np.int64)
    for r in hashed.select("buckets").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket; S and T are the sums of s and t."""
    over, under = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * over / ((s + 1) * under))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("buckets")
            words, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
            n, total, a = np.diff(offsets), np.zeros(len(offsets) - 1, np.int64), 0
            while a < len(n):  # rows of about SLICE words at a time
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
                ends = np.zeros(offsets[b] - offsets[a] + 1, np.int64)
                np.cumsum(gain[words[offsets[a] : offsets[b]]], out=ends[1:])
                at = offsets[a : b + 1] - offsets[a]
                total[a:b] = ends[at[1:]] - ends[at[:-1]]
                a = b
            weight = np.floor_divide(total, np.maximum(n, 1))
            kept = [batch.column("doc_id"), batch.column("rid"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", "rid", "n_features", "weight"])

    return run


def weighed(hashed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, rid, n_features, weight: the floored mean of gains over each document's features, 0 without any."""
    kind = dict(hashed.dtypes)["doc_id"]
    return hashed.select("doc_id", "rid", "buckets").mapInArrow(_weigher(gain), f"doc_id {kind}, rid long, n_features long, weight long")


def score_of(weight: F.Column, doc_id: F.Column, seed: int = SEED) -> F.Column:
    """weight plus a Gumbel key in thousandths that depends on seed and doc_id alone; a null doc_id counts as ''."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


class Tournament:
    """A tree of losers over sorted runs: each match is played once a level when its run moves on.

    runs: iterators of keys, each ascending; next() gives (key, run) of the smallest; equal keys come by lower run.
    """

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.size = runs, 1
        while self.size < len(runs):
            self.size *= 2
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1]

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        while self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run], run
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.size) // 2
            while node:
                if self._beats(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of runs, one run after the other, each by falling score and rising doc_id: merged, with places from 1 on."""
    rows = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
    if not rows or not rows.num_rows:
        return
    run, score = (rows.column(c).to_numpy() for c in ("run", "score"))
    ids = rows.column("doc_id").to_pylist()
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]]).tolist()
    falling = (-score).tolist()
    piece = lambda a, b: ((falling[i], ids[i] is None, ids[i], i) for i in range(a, b))
    order = [key[-1] for key, _ in Tournament([piece(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])]
    rows = rows.take(pa.array(order, pa.int64())).drop_columns(["run", "rid"])
    rows = rows.append_column("part", pa.array(np.full(len(order), TaskContext.get().partitionId(), np.int32)))
    yield from rows.append_column("place", pa.array(np.arange(1, len(order) + 1))).to_batches()


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """scored (a written table: doc_id, rid, n_features, weight, score, run) with rank, null where a row isn't drawn.

    Of the N rows of at least `least` features floor(percent N / 100) are drawn, by falling score, ties by rising doc_id
    (null last); repeated rows tie in any order. The driver gets one number for each score that occurs: scores are
    integers, and logarithms of 63-bit counts and 32-bit keys bound them to some 200,000 values.
    """
    scratch = Scratch(scored.sparkSession)
    eligible = F.col("n_features") >= least
    counts = sorted(((r.score, r.n) for r in scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    want = sum(n for _, n in counts) * percent // 100
    if not want:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    last, upto = counts[0][0], 0
    for last, n in counts:  # noqa: B007
        upto += n
        if upto >= want:
            break
    moving = eligible & (F.col("score") >= last)
    names = ["doc_id", "n_features", "weight", "score"]
    kinds = ", ".join(f"{n} {t}" for n, t in scored.dtypes if n in names)
    pieces = scored.where(moving).select(*names, "run", "rid").repartitionByRange(-(-upto // range_rows), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "rid")
    pieces = pieces.sortWithinPartitions("run", F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    merged = scratch.written(pieces.mapInArrow(_merged, f"{kinds}, part int, place long"), "merged")
    sizes = {r.part: r.n for r in merged.groupBy("part").agg(F.max("place").alias("n")).collect()}  # a number for each range
    before, firsts = 0, {}
    for part in sorted(sizes):
        firsts[part] = before
        before += sizes[part]
    first = F.element_at(F.lit(np.array([firsts.get(p, 0) for p in range(max(firsts) + 1)], np.int64)), F.col("part") + 1)
    rank = F.when(first + F.col("place") <= want, first + F.col("place"))
    rest = scored.where(~moving).select(*names, F.lit(None).cast("long").alias("rank"))
    return merged.select(*names, rank.alias("rank")).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, seed: int = SEED, percent: int = PERCENT, least: int = LEAST_WORDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) for every row of docs (doc_id, text); target: text.

    Null and empty texts have no features: weight 0, and are never drawn where `least` is positive. Repeated rows
    stay, each with a rank of its own if drawn; equal scores are ranked by smaller doc_id. An empty table gives no rows;
    an empty target makes all weights tell against frequent words. Further columns, of either table, are ignored.
    Words are hashed once and kept as two bytes each, so texts are read once and a long text is an array of numbers.
    """
    scratch = Scratch(docs.sparkSession)
    hashed = scratch.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), buckets_of(F.col("text")).alias("buckets")), "hashed")
    aim = histogram(target.select(buckets_of(F.col("text")).alias("buckets")))
    scores = weighed(hashed, gains(histogram(hashed), aim)).withColumn("score", score_of(F.col("weight"), F.col("doc_id"), seed))
    runs = scores.withColumn("run", F.spark_partition_id()).sortWithinPartitions(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    scored = scratch.written(runs, "runs")
    scratch.drop("hashed")
    return drawn(scored, percent, least, range_rows)


def sample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents' doc_id and rank."""
    return resampled(docs, target, **how).where("rank is not null").select("doc_id", "rank")


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The CRC-32 of a blob's bytes, by a table of 256 remainders made from the polynomial.
CRC_SQL = """
bits AS (SELECT range AS i, range AS v, 0 AS k FROM range(256)),
steps AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM bits),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps)
"""


def crc_sql(column: str) -> str:
    """CRC-32 of a text column's UTF-8 bytes; needs crc.t of CRC_SQL."""
    pairs = f"list_transform(range(octet_length(encode({column}))), lambda k: ('0x' || substr(hex(encode({column})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {pairs}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


OP13_SQL = rf"""
WITH {CRC_SQL.strip()},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY ALL),
h AS (SELECT w, {crc_sql("w")} % {BUCKETS} AS k FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT k, sum(n)::BIGINT AS s FROM dw JOIN h USING (w) GROUP BY k), t AS (SELECT k, sum(n)::BIGINT AS t FROM bw JOIN h USING (w) GROUP BY k),
totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::BIGINT AS a, coalesce((SELECT sum(t) FROM t), 0)::BIGINT AS b),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (a + {BUCKETS}) / ((s + 1)::DOUBLE * (b + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (k), totals),
x AS (SELECT r, sum(n)::BIGINT AS n, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN h USING (w) JOIN g USING (k) GROUP BY r),
y AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (r)),
z AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM y),
e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {PERCENT} // 100 THEN rank END AS rank FROM z LEFT JOIN e USING (r)
"""
