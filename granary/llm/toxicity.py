"""Toxicity by maximum-scoring segments.

Tokens get log-odds between toxic and clean labelled texts, smoothed by a Dirichlet prior in proportion to the
whole training corpus. A linear scan (Ruzzo and Tompa) finds all maximal-scoring segments of a text; extreme-value
(Karlin and Altschul) statistics tell how surprising each is in a clean text of that length, and the significant
ones are summed to the document's score.

A token is a whole word, lower-cased: a run of letters, parted by white space, digits and all punctuation. In scripts
that write no blanks between words each pair of neighbouring characters is a token. A word that the training texts
hardly know is scored by the most telling of its character n-grams, ends marked.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

# Parameters of the model.
PRIOR = 1000.0  #: total pseudo-count of the Dirichlet prior
MIN_Z = 4.0  #: root of the likelihood ratio from which a word's log-odds count
MIN_GRAM_Z = 5.0  #: the same for an n-gram, whose words in one text are not independent
MIN_GRAM_ODDS = 3.0  #: and from which log-odds: an n-gram stands for words that were not seen
GRAMS = (3, 4, 5, 6)  #: lengths of n-grams
KNOWN = 10  #: training texts with a word from which the word speaks for itself
MIN_COUNT = 3  #: occurrences below which a token tells nothing
DRIFT = -0.05  #: score of a token that tells nothing
CAP = 6.0  #: largest size of a token's score
ALPHA = 0.05  #: expected chance segments at which a passage still counts as significant
FOLDS = 5
TRAIN_ROWS = 50_000  #: labelled rows, about, that the token model is fitted on

#: Scripts without blanks between words: Thai to Lao, Myanmar, Khmer, kana, CJK ideographs.
UNPARTED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(r"[^\W\d_]+")
PARTS = re.compile(f"[{UNPARTED}]+|[^{UNPARTED}]+")
HAS_UNPARTED = re.compile(f"[{UNPARTED}]")


def fold(doc_id: str = "doc_id", folds: int = FOLDS) -> F.Column:
    """crc32 of doc_id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def tokens(text: str) -> list[str]:
    """All tokens of a text in order."""
    words = WORD.findall(text.lower())
    if not HAS_UNPARTED.search(text):
        return words
    out = []
    for w in words:
        for part in PARTS.findall(w):
            out += [part[i : i + 2] for i in range(max(1, len(part) - 1))] if HAS_UNPARTED.match(part) else [part]
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic texts, clean texts that hold it), summed within a batch."""
    for batch in batches:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            by[toxic].update(set(tokens(text or "")))
        names = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][w] for w in names], pa.int64()), pa.array([by[0][w] for w in names], pa.int64())], ["token", "t", "c"])


def _rated(counts: DataFrame) -> DataFrame:
    """token, odds, z, n from counts (token, t, c): smoothed log-odds and the root of the likelihood ratio.

    Without tokens of both kinds of texts there are none.
    """
    nt, nc = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c")).first())
    if not nt or not nc:
        return counts.limit(0).select("token", F.lit(0.0).alias("odds"), F.lit(0.0).alias("z"), F.col("t").alias("n"))
    n = F.col("t") + F.col("c")
    prior = n * (PRIOR / (nt + nc))
    t, c = F.col("t") + prior, F.col("c") + prior
    odds = F.log(t / (nt + PRIOR - t)) - F.log(c / (nc + PRIOR - c))
    part = lambda x, share: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (n * share))).otherwise(0.0)
    z = F.sqrt(2 * F.greatest(F.lit(0.0), part("t", nt / (nt + nc)) + part("c", nc / (nt + nc))))
    return counts.select("token", F.greatest(F.lit(-CAP), F.least(F.lit(CAP), odds)).alias("odds"), z.alias("z"), n.alias("n"))


class Model:
    """Scores of words, of n-grams with their z, and the words that speak for themselves. All come from at most about
    TRAIN_ROWS texts, which bounds them."""

    def __init__(self, words: dict[str, float], grams: dict[str, tuple[float, float]], known: frozenset[str]) -> None:
        self.words, self.grams, self.known = words, grams, known

    def score(self, word: str) -> float:
        if (own := self.words.get(word)) is not None:
            return own
        if word in self.known or not self.grams:
            return DRIFT
        marked, best = f"^{word}$", (0.0, DRIFT)
        for n in GRAMS:
            for i in range(len(marked) - n + 1):
                if (hit := self.grams.get(marked[i : i + n])) and hit[0] > best[0]:
                    best = hit
        return best[1]


def train(labelled: DataFrame) -> Model:
    """Token scores from all rows of labelled (text, toxic). A token counts once in a text, an n-gram once for each
    text and word of it."""
    scratch = Scratch(labelled.sparkSession)
    words = labelled.mapInArrow(_counts, "token string, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    words = scratch.written(words, "words")
    frequent = scratch.written(_rated(words.where(F.col("t") + F.col("c") >= MIN_COUNT)).where((F.col("z") >= MIN_Z) | (F.col("n") >= KNOWN)), "frequent")
    marked = F.concat(F.lit("^"), "token", F.lit("$"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - n + 1)), lambda i: F.substring(marked, i, F.lit(n)))
    each = words.select("t", "c", F.explode(F.array_distinct(F.concat(*(F.when(F.length(marked) >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in GRAMS)))).alias("token"))
    grams = scratch.written(each.groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") + F.col("c") >= MIN_COUNT), "grams")
    grams = _rated(grams).where((F.col("z") >= MIN_GRAM_Z) & (F.col("odds") >= MIN_GRAM_ODDS))
    found, parts = frequent.collect(), grams.collect()
    scratch.drop("words", "frequent", "grams")
    return Model({r.token: r.odds for r in found if r.z >= MIN_Z}, {r.token: (r.z, r.odds) for r in parts}, frozenset(r.token for r in found if r.z < MIN_Z))


def segments(positions: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time.

    positions: where the scores are positive; scores: of all places.
    """
    upto = np.concatenate(([0.0], np.cumsum(scores)))
    out: list[list] = []  # start, end, sum before, sum at the end
    for p in positions.tolist():
        new = [p, p + 1, float(upto[p]), float(upto[p + 1])]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(a, b, y - x) for a, b, x, y in out]


def karlin(histogram: list[tuple[float, float]]) -> float:
    """lambda: the positive root of sum p exp(lambda s) = 1 over the clean texts' token scores."""
    total = sum(n for _, n in histogram)
    if not total or not any(s > 0 and n for s, n in histogram) or sum(s * n for s, n in histogram) >= 0:
        return 1.0
    f = lambda x: sum(n / total * math.exp(x * s) for s, n in histogram) - 1
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(0.05, min(high, 5.0))


class Scorer:
    """Scores texts; remembers the scores of words."""

    def __init__(self, model: Model, scale: float = 1.0) -> None:
        self.model, self.scale = model, scale
        self.seen: dict[str, float] = {}

    def scores(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        try:
            return np.fromiter(map(seen.__getitem__, words), float, len(words))
        except KeyError:
            if len(seen) > 200_000:
                seen.clear()
            out = []
            for w in words:
                x = seen.get(w)
                if x is None:
                    x = self.model.score(w)
                    if len(w) <= 64:
                        seen[w] = x
                out.append(x)
            return np.array(out, float)

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and segments with their scores, of a whole text."""
        words = tokens(text)
        s = self.scores(words)
        return len(words), segments(np.flatnonzero(s > 0), s)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, int]:
        """Sum over significant segments of -ln of the expected number of chance segments, and their number.

        Without a significant segment: that of the best one, below zero.
        """
        e = [self.scale * s - math.log(max(n, 1)) for _, _, s in found]
        good = [x for x in e if x >= -math.log(ALPHA)]
        return (sum(good), len(good)) if good else (max([*e, -math.log(max(n, 1)) - 5.0]) + math.log(ALPHA), 0)


def _texts(batch: pa.RecordBatch) -> Iterable[str]:
    return (x or "" for x in batch.column("text").to_pylist())


def _scorer(model: Model, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, scale)
        for batch in batches:
            found = [scorer.evidence(*scorer.passages(t)) for t in _texts(batch)]
            others = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in others), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.int64())], [*(n for n, _ in others), "evidence", "n_segments"])

    return run


def _background(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            s = np.concatenate([np.zeros(0), *(scorer.scores(tokens(t)) for t in _texts(batch))])
            values, n = np.unique(np.round(s * 20).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n, pa.int64())], ["s", "n"])

    return run


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of a sample of about `most` labelled rows of the training folds, chosen by a hash of doc_id;
    equal texts of one label once. Rows without a label of 0 or 1 don't count.

    The sample's ids are few enough to be broadcast, so that no text is shuffled.
    """
    given = labels.where(F.col("toxic").isin(0, 1) & (fold() != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = most / max(most, given.count())
    given = given.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h")).join(F.broadcast(given), "doc_id")
    once = Scratch(docs.sparkSession).written(hashed.groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic"), "sample")
    return docs.select("doc_id", "text").join(F.broadcast(once), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, float]:
    """Token scores and the Karlin lambda of clean training texts."""
    rows = labelled_rows(docs, labels)
    model = train(rows)
    seen = rows.where("toxic = 0").select("text").mapInArrow(_background(model), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return model, karlin([(r.s / 20, float(r.n)) for r in seen.collect()])  # at most 40 * CAP + 2 rows


def scored(docs: DataFrame, labels: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """The contract's columns for every row of target (docs where none is given), and evidence, n_segments.

    Null and empty texts have no token and the lowest evidence. The threshold is the evidence that best parts
    toxic from clean training rows with the fewest errors; ties go to the lower one. Without labels of both kinds
    nothing is toxic: every score is below 0.5. Repeated rows stay; further columns are ignored; an empty table gives
    no rows. Several labels of one doc_id all count.
    """
    model, scale = fit(docs, labels)
    target = docs if target is None else target
    kind = dict(target.dtypes)["doc_id"]
    got = Scratch(docs.sparkSession).written(target.select("doc_id", "text").mapInArrow(_scorer(model, scale), f"doc_id {kind}, evidence double, n_segments long"), "evidence")
    line = threshold(got, labels)
    score = 1 / (1 + F.exp(-(F.col("evidence") - line) / 2))
    return got.select("doc_id", (fold() == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "evidence", "n_segments")


def threshold(got: DataFrame, labels: DataFrame) -> float:
    """From a histogram of the training rows' evidence in steps of a quarter, -40 to 400."""
    step = F.greatest(F.lit(-160), F.least(F.lit(1600), F.floor(F.col("evidence") * 4)))
    kept = labels.where(F.col("toxic").isin(0, 1) & (fold() != 0)).select("doc_id", "toxic")
    bins = sorted((int(r.k), int(r.t), int(r.n)) for r in got.join(kept, "doc_id").groupBy(step.alias("k")).agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect())
    toxic, clean = sum(t for _, t, _ in bins), sum(n - t for _, t, n in bins)
    if not toxic or not clean:
        return 1e6
    best, line, t0, c0 = -1, 0.0, 0, 0
    for i, (k, t, n) in enumerate(bins):
        if (gain := toxic - t0 + c0) > best:
            best, line = gain, (k + (bins[i - 1][0] + 1 if i else k)) / 8
        t0, c0 = t0 + t, c0 + n - t
    return line


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that aren't toxic, all columns as they were. docs' doc_id names the labelled rows.

    Null and empty texts stay, as do all rows where labels of both kinds are lacking; an empty table stays empty.
    Texts are scored once and written with their evidence; they are not shuffled.
    """
    model, scale = fit(docs, labels)
    name = "evidence"
    while name in docs.columns:
        name = f"_{name}"
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, scale)
        for batch in batches:
            found = [scorer.evidence(*scorer.passages(t))[0] for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    got = Scratch(docs.sparkSession).written(docs.mapInArrow(run, f"{kinds}, `{name}` double"), "scored")
    line = threshold(got.select("doc_id", F.col(name).alias("evidence")), labels)
    return got.where(F.col(name) < line).select(*docs.columns)


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
