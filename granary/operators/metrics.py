"""Evaluation metrics over token tables."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import Vocabulary
from ..functions.udfs import rouge_l
from ..plans.lineage import Scratch
from .ledger import first_n, running_total


def ngrams(ids: Column, n: int) -> Column:
    size = F.size(ids)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda k: F.slice(ids, k, n))).otherwise(F.slice(F.transform(ids, lambda x: F.array(x)), 1, 0))


def distinct_n(ids: Column, n: int) -> Column:
    """Distinct n-grams over all; 0.0 without any.

    N-grams are compared as strings, each token behind its length, as Spark finds distinct strings by hashing and
    distinct arrays by comparing all pairs.
    """
    named = F.transform(ids, lambda x: F.concat(F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")))

    def share(a: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(a) - n + 1)
        grams = a if n == 1 else F.transform(at, lambda k: F.concat(*(F.element_at(a, k + i) for i in range(n))))
        return F.when(F.size(a) >= n, F.size(F.array_distinct(grams)) / (F.size(a) - n + 1)).otherwise(F.lit(0.0))

    return T.bound(named, share)


def repetition(ids: Column, n: int = 2) -> Column:
    """Share of n-grams seen earlier; 0.0 without any."""
    return F.when(F.size(ids) >= n, 1 - distinct_n(ids, n)).otherwise(F.lit(0.0))


def loops(ids: Column, least: int = 2) -> Column:
    """Whether the end is three times the same phrase of at least `least` tokens.

    Phrases are compared only where the last tokens of all three agree.
    """

    def ends_so(a: Column) -> Column:
        part = lambda p, k: F.slice(a, F.size(a) - k * p + 1, p)
        last = lambda p, k, i: F.get(a, F.size(a) - 1 - k * p - i)

        def equal(p: Column) -> Column:
            ends = [(last(p, 0, i) == last(p, k, i)) for i in range(least) for k in (1, 2)]
            return reduce(Column.__and__, [*ends, part(p, 2) == part(p, 1), part(p, 3) == part(p, 1)])

        lengths = F.sequence(F.lit(least), F.greatest(F.lit(least), F.floor(F.size(a) / 3).cast("int")))
        return F.when(F.size(a) < 3 * least, F.lit(False)).otherwise(F.exists(lengths, equal))

    return T.bound(ids, ends_so)


def generation_summary(rows: DataFrame, by: str, ids: str = "ids") -> DataFrame:
    """Means over the rows of a group. Repetition is what distinct bigrams leave, so they are found once."""
    found = lambda c: F.struct(distinct_n(c, 1).alias("d1"), distinct_n(c, 2).alias("d2"), (F.size(c) > 1).alias("some"), loops(c).cast("int").alias("l"))
    each = rows.select(by, F.inline(F.array(T.bound(F.col(ids), found))))
    return each.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("some"), 1 - F.col("d2")).otherwise(0.0)), 6).alias("repetition"), F.round(F.avg("d1"), 6).alias("distinct_1"),
        F.round(F.avg("d2"), 6).alias("distinct_2"), F.round(F.avg("l"), 6).alias("loops"),
    )


def exact_match(rows: DataFrame, by: str) -> DataFrame:
    """Strict: equal after trimming. Lenient: the answer begins with what is expected. Never pooled over groups."""
    p, e = F.trim("predicted"), F.trim("expected")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((p == e).cast("int")), 6).alias("strict"), F.round(F.avg(p.startswith(e).cast("int")), 6).alias("lenient"))


def seed_means(rows: DataFrame, by: str, value: str, digits: int = 4) -> DataFrame:
    """Mean over seeds of values that were rounded first, rounded again."""
    return rows.groupBy(by).agg(F.round(F.avg(F.round(value, digits)), digits).alias(value))


#: Items of rows that are counted together: bounds the arrays of a task.
ITEMS = 1 << 19


def _clipped(group: np.ndarray, items: list[np.ndarray], sizes: list[np.ndarray], order: int) -> np.ndarray:
    """matches (clipped by row), hyps and refs by group and n. group: a number for each row; items, sizes: small numbers
    for the words or characters of hypotheses and of references, row after row, and how many each row has.

    An n-gram is one number of its row and items, as digits; where these don't fit, what came so far is numbered anew.
    """
    sizes_ = np.concatenate(sizes)
    codes, side = np.concatenate(items).astype(np.uint64), np.repeat(np.array([0, 1], np.uint64), [len(x) for x in items])
    left = np.repeat(np.cumsum(sizes_), sizes_) - np.arange(len(codes))  # items from here to the row's end
    key = np.repeat(np.tile(np.arange(len(group), dtype=np.uint64), 2), sizes_)
    owner, span, kinds, at = group, 1, int(codes.max(initial=0)) + 1, np.arange(len(codes))
    out = np.zeros((int(group.max(initial=-1)) + 1, order, 3), np.int64)
    for n in range(1, order + 1):
        whole = left[at] >= n
        at, key = at[whole], key[whole]
        if not len(at):
            break
        if len(owner) * span * kinds >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            owner, span, key = owner[seen // np.uint64(span)], 1, key.astype(np.uint64)
        key, span = key * np.uint64(kinds) + codes[at + n - 1], span * kinds
        grams = np.sort(key * np.uint64(2) + side[at])
        first = np.flatnonzero(np.diff(grams >> np.uint64(1), prepend=grams[0] >> np.uint64(1)) != 0)
        first = np.concatenate([[0], first])
        refs = np.add.reduceat((grams & np.uint64(1)).astype(np.int64), first)
        hyps = np.diff(first, append=len(grams)) - refs
        of = owner[(grams[first] >> np.uint64(1)) // np.uint64(span)]
        for k, x in enumerate((np.minimum(hyps, refs), hyps, refs)):
            np.add.at(out[:, n - 1, k], of, x)
    return out


def _coded(x: pa.Array, y: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Items of two arrays of strings, or of lists of words, as small numbers, and how many each row has; null has none."""
    if pa.types.is_string(x.type) or pa.types.is_large_string(x.type):
        items = [np.frombuffer("".join(a.drop_null().to_pylist()).encode("utf-32-le"), np.uint32) for a in (x, y)]
        number = np.zeros(max(int(a.max(initial=0)) for a in items) + 1, np.int64)
        for a in items:
            number[a] = 1
        number = np.cumsum(number) - 1
        items, size = [number[a] for a in items], pc.utf8_length
    else:
        parts = [a.flatten() for a in (x, y)]
        both = pa.concat_arrays(parts).dictionary_encode(null_encoding="encode").indices.to_numpy()
        items, size = np.split(both, [len(parts[0])]), pc.list_value_length
    return items, [pc.fill_null(size(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (x, y)]


def _matched(rows: DataFrame, by: str, hyp: str, ref: str, order: int) -> DataFrame:
    """by, n, matches (clipped by row), hyps, refs: n-gram counts summed over the rows of a group. hyp, ref: arrays of
    words, or strings, whose items are characters. Rows without a reference don't count.

    A row's n-grams meet in its own task, by sorting; only sums are shuffled.
    """
    rows = rows.where(F.col(ref).isNotNull()).select(F.col(by).alias("_by"), F.col(hyp).alias("_x"), F.col(ref).alias("_y"))

    def sums(batches):
        for batch in batches:
            size = pc.list_value_length if pa.types.is_list(batch.column("_x").type) or pa.types.is_large_list(batch.column("_x").type) else pc.utf8_length
            ends = np.cumsum(sum(pc.fill_null(size(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_x", "_y")))
            start = 0
            while start < batch.num_rows:
                upto = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ITEMS, side="right")))
                part, start = batch.slice(start, upto - start), upto
                groups = part.column("_by").dictionary_encode(null_encoding="encode")
                found = _clipped(groups.indices.to_numpy().astype(np.int64), *_coded(part.column("_x"), part.column("_y")), order)
                g, n = np.nonzero(found.sum(2))
                made = [groups.dictionary.take(pa.array(g)), pa.array(n + 1, pa.int32()), *(pa.array(found[g, n, k]) for k in range(3))]
                yield pa.RecordBatch.from_arrays(made, ["_by", "n", "matches", "hyps", "refs"])

    each = rows.mapInArrow(sums, f"_by {rows.schema['_by'].dataType.simpleString()}, n int, matches long, hyps long, refs long")
    found = each.groupBy("_by", "n").agg(*(F.sum(c).alias(c) for c in ("matches", "hyps", "refs")))
    return found.withColumnRenamed("_by", by)


def bleu(rows: DataFrame, by: str, hyp: str = "hyp", ref: str = "ref", order: int = 4) -> DataFrame:
    """Corpus BLEU of word arrays: clipped matches and totals are summed over a group before the geometric mean.

    An order without matches makes 0. One reference a row.
    """
    m = _matched(rows, by, hyp, ref, order).groupBy(by).agg(
        F.count_if((F.col("matches") > 0)).alias("alive"),
        F.avg(F.log(F.when(F.col("matches") > 0, F.col("matches") / F.col("hyps")).otherwise(1.0))).alias("mean"),
        F.max(F.when(F.col("n") == 1, F.col("hyps"))).alias("hl"), F.max(F.when(F.col("n") == 1, F.col("refs"))).alias("rl"),
    )
    brevity = F.when(F.col("hl") >= F.col("rl"), 1.0).otherwise(F.exp(1 - F.col("rl") / F.nullif("hl", F.lit(0))))
    return m.select(by, F.round(F.when(F.col("alive") == order, 100 * brevity * F.exp("mean")).otherwise(0.0), 6).alias("bleu"))


def chrf(rows: DataFrame, by: str, hyp: str = "hyp", ref: str = "ref", order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF of strings: character n-grams without white space, F of precision and recall, mean over orders.

    References are one string a row, not streams of characters.
    """
    chars = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    got = _matched(rows.withColumns({"_h": chars(F.col(hyp)), "_r": chars(F.col(ref))}), by, "_h", "_r", order)
    p, r = F.col("matches") / F.nullif("hyps", F.lit(0)), F.col("matches") / F.nullif("refs", F.lit(0))
    f = F.coalesce((1 + beta**2) * p * r / F.nullif(beta**2 * p + r, F.lit(0.0)), F.lit(0.0))
    both = (F.col("hyps") > 0) & (F.col("refs") > 0)
    return got.groupBy(by).agg(F.round(F.coalesce(100 * F.avg(F.when(both, f)), F.lit(0.0)), 6).alias("chrf"))


def rouge(rows: DataFrame, by: str, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Mean ROUGE-L F1 of word arrays in any script."""
    return rows.groupBy(by).agg(F.round(F.avg("_f"), 6).alias("rouge_l")) if "_f" in rows.columns else rouge(rows.withColumn("_f", rouge_l(hyp, ref)), by, hyp, ref)


def fertility(rows: DataFrame, by: str, tokens: str = "n_tokens", words: str = "n_words", unknown: str = "n_unk") -> DataFrame:
    """Tokens a word over lines with words, and unknown tokens over all; ratios of sums."""
    return rows.groupBy(by).agg(*_fertility(tokens, words, unknown))


def _fertility(tokens: str | Column, words: str | Column, unknown: str | Column) -> tuple[Column, Column]:
    t, w, u = (F.col(c) if isinstance(c, str) else c for c in (tokens, words, unknown))
    return (
        F.round(F.sum(F.when(w > 0, t)) / F.nullif(F.sum(w), F.lit(0)), 6).alias("fertility"),
        F.round(F.sum(u) / F.nullif(F.sum(t), F.lit(0)), 6).alias("unk_rate"),
    )


def vocabulary_sweep(rows: DataFrame, text: str, candidates: dict[str, Vocabulary]) -> DataFrame:
    """vocabulary, size, fertility, unk_rate of each candidate over all rows, which are read once."""
    w = T.rough_tokens(F.col(text))
    ids = {name: v.encode(F.col(text)) for name, v in candidates.items()}
    each = rows.select(w.alias("w"), *(i.alias(f"ids {name}") for name, i in ids.items()))
    named = [F.struct(F.lit(n).alias("vocabulary"), F.lit(v.size).alias("size"), F.col(f"`ids {n}`").alias("ids"), F.lit(v.unknown).alias("unknown")) for n, v in candidates.items()]
    long_ = each.select("w", F.inline(F.array(*named)))
    unknown = F.size(F.filter("ids", lambda i: i == F.col("unknown")))
    return long_.groupBy("vocabulary", "size").agg(*_fertility(F.size("ids"), F.col("w"), unknown))


def character_coverage(texts: DataFrame, text: str, coverage: float = 0.9995) -> DataFrame:
    """char, n: the most frequent characters, without white space, up to the one that reaches the coverage; ties by
    code point. The table of characters is small, whatever the texts: Unicode bounds it."""
    chars = texts.select(F.explode(F.split(text, "")).alias("char")).where(~F.col("char").rlike(r"(?U)^\s*$")).groupBy("char").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col("n").desc(), "char").rowsBetween(Window.unboundedPreceding, -1)
    rows = chars.withColumns({"_before": F.coalesce(F.sum("n").over(order), F.lit(0)), "_all": F.sum("n").over(Window.partitionBy())})
    return rows.where(F.col("_before") < F.col("_all") * coverage).select("char", "n")


def window_losses(losses: DataFrame, by: str, length: int) -> DataFrame:
    """Sum of losses and number of tokens over the full windows of each stream; what is left after the last goes.

    losses (by, pos, loss): the loss of the token at pos, from 1 on; the first token of a stream is not predicted.
    """
    n = losses.groupBy(by).agg((F.max("pos") + 1).alias("_n"))
    full = losses.where("pos >= 1").join(n, by).where(F.col("pos") <= F.floor((F.col("_n") - 1) / length) * length)
    return full.groupBy(by).agg(F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("tokens"))


def sampled_loss(losses: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """loss, tokens, perplexity over windows of a stream (pos, loss) that begin at `starts` (start): each predicts
    the `length` tokens after its first; a window counts as often as it is drawn."""
    wanted = starts.select(F.explode(F.sequence(F.col("start") + 1, F.col("start") + length)).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("_k"))
    got = losses.join(wanted, "pos").agg(F.sum(F.col("loss") * F.col("_k")).alias("loss"), F.sum("_k").alias("tokens"))
    return got.select(F.round(F.col("loss") / F.col("tokens"), 6).alias("loss"), "tokens", F.round(F.exp(F.col("loss") / F.col("tokens")), 4).alias("perplexity"))


def drawn_places(starts: DataFrame, by: str, length: int) -> DataFrame:
    """by, pos, k: the tokens that windows at `starts` (by, start) predict, `length` each, and how often."""
    return starts.select(by, F.explode(F.sequence(F.col("start") + 1, F.col("start") + length)).alias("pos")).groupBy(by, "pos").agg(F.count(F.lit(1)).alias("k"))


def random_starts(sizes: DataFrame, draws: int, length: int, seed: int = 0) -> DataFrame:
    """sizes (any key, n: tokens of a stream) with `draws` starts of windows anywhere in it that have `length` tokens and one more; a
    stream without room for one has none. The i-th start is a multiplicative hash of i and seed, scaled to the stream."""
    share = F.pmod((F.col("_i") + seed * draws) * 2654435761 + 97, F.lit(1 << 32))
    rows = sizes.where(F.col("n") > length).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("_i"))
    return rows.withColumn("start", F.shiftright(share * (F.col("n") - length), 32)).drop("_i")


def windows(n: int, length: int) -> int:
    """Full windows of a stream, each with a target after it; the rest is dropped."""
    return max(0, (n - 1) // length)


def perplexity(totals: DataFrame) -> DataFrame:
    """totals (loss sum, tokens, bytes): cross-entropy, perplexity, bits a byte. Bytes are those of the whole text."""
    ce = F.col("loss") / F.nullif("tokens", F.lit(0))
    return totals.withColumns({"cross_entropy": F.round(ce, 6), "perplexity": F.round(F.exp(ce), 6), "bits_per_byte": F.round(ce * math.log2(math.e) * F.col("tokens") / F.nullif("bytes", F.lit(0)), 6)})


def with_unigram_loss(tokens: DataFrame, token: str, many: int = 1024) -> DataFrame:
    """tokens with the loss of each under an add-one unigram model of all of them: a stand-in for a neural scorer.

    Words are counted first. Those that make up more than a many-th of all tokens, fewer than `many`, take their loss
    from a map, and their rows are spread over the join in which the others find theirs.
    """
    counts = Scratch(tokens.sparkSession).written(tokens.groupBy(token).agg(F.count(F.lit(1)).alias("_c")), "counts")
    total, kinds = counts.agg(F.sum("_c"), F.count(F.lit(1))).first()
    loss = -F.log((F.col("_c") + 1) / F.lit(float((total or 0) + kinds)))
    losses = counts.select(F.col(token).alias("_word"), loss.alias("_loss"))
    hot = [x for r in counts.where(F.col("_c") * many > (total or 0)).select(token, loss).collect() if r[0] is not None for x in r]
    common = F.create_map(*map(F.lit, hot)) if hot else F.create_map().cast("map<string,double>")
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*tokens.columns), F.lit(many)).cast("string"))
    rows = tokens.withColumn("_common", F.get(F.array(F.element_at(common, F.col(token))), 0) if hot else F.lit(None).cast("double"))
    rows = rows.withColumn("_word", F.when(F.col("_common").isNotNull(), spread).otherwise(F.col(token)))
    return rows.join(losses, "_word", "left").select(*tokens.columns, F.coalesce("_common", "_loss").alias("loss")).where(F.col(token).isNotNull())


def unigram_model(docs: DataFrame, by: str, words: Column) -> tuple[DataFrame, DataFrame]:
    """Losses of words (w, loss) under an add-one unigram model of all documents, and sums (by, loss, tokens) over the groups'
    tokens, from counts alone: no row a token is shuffled, however often a word occurs."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.written(docs.select(by, F.explode(words).alias("w")).groupBy(by, "w").agg(F.count(F.lit(1)).alias("n")), "counts")
    total, kinds = counts.agg(F.sum("n"), F.countDistinct("w")).first()
    losses = counts.groupBy("w").agg((-F.log((F.sum("n") + 1) / F.lit(float((total or 0) + kinds)))).alias("loss"))
    losses = scratch.written(losses, "losses")
    sums = counts.join(losses, "w").groupBy(by).agg(F.sum(F.col("n") * F.col("loss")).alias("loss"), F.sum("n").alias("tokens"))
    return losses, sums


def placed(docs: DataFrame, by: str, order: str, words: Column) -> DataFrame:
    """by, order, n, before: where each document's words begin in its group's stream."""
    return Scratch(docs.sparkSession).written(running_total(docs.select(by, order, F.size(words).cast("long").alias("n")), by, order, "n", "before"), "placed")


def words_at(docs: DataFrame, by: str, order: str, words: Column, places: DataFrame, wanted: DataFrame, block: int = 1024) -> DataFrame:
    """wanted (a small table: by, pos, further columns) with w, the word at that place of the group's stream.

    Places meet in blocks of the stream, and only documents with a wanted word give rows. (by, order) names a document.
    """
    blocks = F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("n") - 1) / block))
    held = places.where("n > 0").select(by, order, "n", "before", F.explode(blocks).alias("_block"))
    asked = wanted.withColumn("_block", F.floor(F.col("pos") / block))
    met = held.join(F.broadcast(asked), [by, "_block"]).where("pos >= before and pos < before + n")
    met = met.select(by, order, *(c for c in wanted.columns if c != by), (F.col("pos") - F.col("before")).cast("int").alias("_at"))
    met = Scratch(docs.sparkSession).written(met, "met")
    texts = docs.select(by, order, words.alias("_words")).join(F.broadcast(met), [by, order])
    return texts.select(*wanted.columns, F.get("_words", F.col("_at")).alias("w"))


def unigram_losses(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """A stand-in for a neural scorer: add-one unigram losses, summed by group. Columns: by, loss, tokens, bytes."""
    w = docs.select(by, F.explode(F.split(F.trim(text), r"\s+")).alias("w")).where("w <> ''").groupBy(by, "w").agg(F.count(F.lit(1)).alias("n"))
    all_ = w.groupBy("w").agg(F.sum("n").alias("c"))
    total = all_.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
    loss = F.col("n") * -F.log((F.col("c") + 1) / (F.col("total") + F.col("kinds")))
    sums = w.join(all_, "w").crossJoin(F.broadcast(total)).groupBy(by).agg(F.sum(loss).alias("loss"), F.sum("n").alias("tokens"))
    return sums.join(docs.groupBy(by).agg(F.sum(F.octet_length(text)).alias("bytes")), by)


def masked_loss(rows: DataFrame, by: str) -> DataFrame:
    """Sum of loss where the mask is set over its sum, which counts 1 at least."""
    return rows.groupBy(by).agg(F.round(F.sum(F.col("loss") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1)), 6).alias("loss"))


def epoch_loss(rows: DataFrame) -> DataFrame:
    """Mean of the batches' means, whatever their sizes."""
    return rows.groupBy("epoch", "batch").agg(F.avg("loss").alias("l")).groupBy("epoch").agg(F.round(F.avg("l"), 6).alias("loss"))


def attention_summary(p: DataFrame) -> DataFrame:
    """p (example, layer, head, q, k, p): entropy and distance of each head, means over queries after the first,
    then over examples."""
    rows = p.where("k <= q and q >= 1")
    by_q = rows.groupBy("example", "layer", "head", "q").agg(F.sum(-F.col("p") * F.log(F.col("p") + 1e-12)).alias("h"), F.sum(F.col("p") * (F.col("q") - F.col("k"))).alias("d"))
    by_e = by_q.groupBy("example", "layer", "head").agg(F.avg("h").alias("h"), F.avg("d").alias("d"))
    return by_e.groupBy("layer", "head").agg(F.round(F.avg("h"), 6).alias("entropy"), F.round(F.avg("d"), 6).alias("distance"))


def shares(scores: Column) -> Column:
    """Scores over their sum."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.flatten(F.transform(F.array(total), lambda s: F.transform(scores, lambda x: x / s)))


def head_summary(heads: DataFrame) -> DataFrame:
    """attention_summary() of whole heads: example, layer, head, p (array of each query's weights of its keys)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    later = F.filter("p", lambda _, q: q >= 1)
    h = F.transform(later, lambda w: total(F.transform(w, lambda x: -x * F.log(x + 1e-12))))
    d = F.transform(later, lambda w: total(F.transform(w, lambda x, k: x * (F.size(w) - 1 - k))))
    n = F.nullif(F.size("p") - 1, F.lit(0))
    each = heads.select("example", "layer", "head", (total(h) / n).alias("h"), (total(d) / n).alias("d"))
    return each.groupBy("layer", "head").agg(F.round(F.avg("h"), 6).alias("entropy"), F.round(F.avg("d"), 6).alias("distance"))


def layer_means(heads: DataFrame) -> DataFrame:
    return heads.groupBy("layer").agg(F.round(F.avg("entropy"), 6).alias("entropy"), F.round(F.avg("distance"), 6).alias("distance"))


def even_starts(total: DataFrame, n: int, length: int) -> DataFrame:
    """Starts of n windows spread evenly over all full ones of a stream: i, start. total: one row, n tokens."""
    full = F.floor((F.col("n") - 1) / length)
    return total.select(F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))), "n").select(F.col("pos").cast("long").alias("i"), (F.floor(F.col("pos") * full / n) * length).alias("start"))


def batch_starts(step: Column, b: Column, batch: int, length: int, n: int) -> Column:
    """Where sequence b of a step's batch starts in a stream of n tokens."""
    return (step * batch * length) % (n - length - 1) + b * length


def best_epoch(log: DataFrame, patience: int) -> DataFrame:
    """epoch, loss: the best one (the first of equals) that a run with early stopping sees, and where it stops."""
    w = Window.partitionBy("run").orderBy("epoch")
    rows = log.withColumn("best", F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("fell", F.when((F.col("loss") == F.col("best")) & (F.col("loss") < F.coalesce(F.lag("best").over(w), F.lit(float("inf")))), F.col("epoch")))
    rows = rows.withColumn("at", F.max("fell").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stop = rows.groupBy("run").agg(F.coalesce(F.min(F.when(F.col("epoch") - F.col("at") >= patience, F.col("epoch"))), F.max("epoch")).alias("stopped"))
    return rows.join(stop, "run").where("epoch = stopped").select("run", F.col("at").alias("best_epoch"), F.col("best").alias("best_loss"), "stopped")


def smallest_within(rows: DataFrame, size: str, loss: str, tolerance: float = 0.02) -> DataFrame:
    """The smallest size whose loss is within a tolerance of the best."""
    best = rows.agg(F.min(loss).alias("_b"))
    return rows.crossJoin(F.broadcast(best)).where(F.col(loss) <= F.col("_b") + tolerance).agg(F.min(size).alias(size), F.min_by(loss, size).alias(loss))


def fastest_sound(rows: DataFrame, baseline: int = 32, slack: float = 1.05) -> DataFrame:
    """Batch size of the highest throughput whose loss is at most the baseline's times slack."""
    base = rows.agg(F.coalesce(F.max(F.when(F.col("batch") == baseline, F.col("loss"))), F.min_by("loss", "pos")).alias("_b"))
    return rows.crossJoin(F.broadcast(base)).where(F.col("loss") <= F.col("_b") * slack).agg(F.max_by("batch", "tok_s").alias("batch"), F.max("tok_s").alias("tok_s"))


def best_rate(steps: DataFrame, band: int = 10) -> DataFrame:
    """Learning rate of the lowest mean over the last steps among those whose loss fell and stayed finite."""
    ends = (("first", F.col("step")), ("last", F.col("step").desc()))
    means = [first_n(steps, "lr", order, band).groupBy("lr").agg(F.avg("loss").alias(name)) for name, order in ends]
    bad = steps.groupBy("lr").agg(F.count_if(F.isnan("loss") | (F.abs("loss") == float("inf"))).alias("bad"))
    got = means[0].join(means[1], "lr").join(bad, "lr")
    return got.where("bad = 0 and last < first").agg(F.min_by("lr", "last").alias("lr"), F.round(F.min("last"), 6).alias("loss"))


def learning_rate(step: Column, peak: float, low: float | None, warmup: int, total: int) -> Column:
    """Linear warm-up, then cosine down to the low rate; without a low rate, constant."""
    done = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    after = F.lit(peak) if low is None else low + 0.5 * (1 + F.cos(F.lit(math.pi) * done)) * (peak - low)
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(after)
