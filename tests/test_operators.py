import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.operators import folds, ledger, metrics, reasoning
from granary.plans import corpus
from granary.presets import LATIN
from granary.sources import files


def ids(spark, *rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "id int, ids array<int>").orderBy("id")


def test_generation_metrics(spark):
    rows = ids(spark, [1, 2, 1, 2, 1, 2], [1, 2, 3, 4, 5], [1, 1, 1, 1], [9, 8, 7, 5, 6, 5, 6, 5, 6], [1])
    c = F.col("ids")
    got = rows.select(metrics.repetition(c).alias("r"), metrics.distinct_n(c, 1).alias("d"), metrics.loops(c).alias("l")).collect()
    assert [round(x.r, 6) for x in got[:2]] == [0.6, 0.0]
    assert got[2].d == 0.25
    assert [x.l for x in got] == [True, False, False, True, False]
    assert (got[4].r, got[4].d) == (0.0, 1.0)


def test_perplexity_and_bits(spark):
    got = metrics.perplexity(spark.createDataFrame([(100.0, 100, 50)], "loss double, tokens long, bytes long")).first()
    assert (got.perplexity, got.bits_per_byte) == (round(math.e, 6), round(2 * math.log2(math.e), 6))
    assert metrics.windows(7 * 256 + 50, 256) == 7


def test_attention(spark):
    rows = [(0, 0, h, q, k, (1 / (q + 1) if h == 0 else float(k == q))) for h in (0, 1) for q in range(4) for k in range(q + 1)]
    got = {r["head"]: r for r in metrics.attention_summary(spark.createDataFrame(rows, "example int, layer int, head int, q int, k int, p double")).collect()}
    assert got[0].entropy > got[1].entropy
    assert abs(got[1].entropy) < 1e-6 and got[1].distance == 0


def test_exact_match(spark):
    rows = spark.createDataFrame([("s", "a", "a"), ("s", "a b", "a"), ("s", "xa", "a")], "split string, predicted string, expected string")
    got = metrics.exact_match(rows, "split").first()
    assert (got.strict, got.lenient) == (0.333333, 0.666667)


def test_bleu_and_chrf_of_equal_texts(spark):
    rows = spark.createDataFrame([("g", list("abcde"), list("abcde"), "abc", "abc")], "g string, hyp array<string>, ref array<string>, h string, r string")
    assert metrics.bleu(rows, "g").first().bleu == 100
    assert metrics.chrf(rows, "g", "h", "r").first().chrf == 100


def test_first_wins_across_sources_and_every_segment_has_one_disposition(spark):
    rows = spark.createDataFrame([("b", 0, "x", "same text"), ("a", 5, "x", "same text"), ("a", 7, "y", "123"), ("c", 1, "y", None)], "source string, pos long, bucket string, text string")
    got = {(r.source, r.pos): r.disposition for r in corpus.judged(rows, LATIN).collect()}
    assert got == {("b", 0): "duplicate", ("a", 5): "kept", ("a", 7): "impure", ("c", 1): "impure"}
    assert corpus.judged(rows.limit(0), LATIN).count() == 0


def test_shard_closes_and_forgets_its_overshoot(spark):
    rows = spark.createDataFrame([("s", i, 3) for i in range(5)], "s string, pos long, t long")
    assert [r.shard for r in ledger.shards(rows, "s", "pos", "t", 5).orderBy("pos").collect()] == [0, 0, 1, 1, 2]


def test_row_that_crosses_the_cap_stays(spark):
    rows = spark.createDataFrame([("s", i, 3) for i in range(5)], "s string, pos long, t long")
    assert ledger.token_prefix(rows, "s", "pos", "t", 5).count() == 2
    assert ledger.token_prefix(rows, "s", "pos", "t", None).count() == 5


def test_retries(spark):
    rows = spark.createDataFrame([("a", 0, True), ("b", 0, False), ("b", 1, True), ("c", 0, False), ("c", 1, False), ("d", 0, False)], "key string, pos int, ok boolean")
    assert {r.key: (r.tries, r.state) for r in ledger.retry_plan(rows).collect()} == {"a": (1, "done"), "b": (2, "done"), "c": (2, "given_up"), "d": (1, "retry")}


def test_listing_stops_after_two_empty_pages(spark):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate([True, False, None, True, False, None, False, True])], "s string, page int, full boolean")
    assert sorted(r.page for r in ledger.before_empty_run(rows, "s", "page", "full").collect()) == [0, 1, 2, 3, 4, 5]


def test_consecutive_rows(spark):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate("aabba")], "s string, i int, v string")
    assert [r.v for r in ledger.consecutive_distinct(rows, "s", "i", "v").orderBy("i").collect()] == list("aba")


def test_early_stop(spark):
    log = spark.createDataFrame([(0, i, v) for i, v in enumerate([3.0, 2.0, 2.0, 2.5, 1.0])], "run int, epoch int, loss double")
    got = metrics.best_epoch(log, 2).first()
    assert (got.best_epoch, got.best_loss, got.stopped) == (1, 2.0, 3)


def test_reasoning_holds_out_entities_forms_and_chains(spark):
    sizes = {"train": 200, "val": 30, "test_seen": 30, "test_unseen_entity": 30, "test_unseen_wording": 20}
    rows = reasoning.dataset(spark, sizes, seed=1).collect()
    assert {s: sum(r.split == s for r in rows) for s in sizes} == sizes
    key = lambda r: (r.domain, tuple(r.entities), r.direction, r.has_tie)
    assert len({key(r) for r in rows}) == len(rows)
    held = {n for _, h in reasoning.pools(1).values() for n in h}
    for r in rows:
        assert (set(r.entities) <= held) == (r.split == "test_unseen_entity")
        assert (r.premise_form_id == 3) == (r.split == "test_unseen_wording")
        assert not (r.has_tie and r.num_entities == 3)
        assert (r.answer == "equal") == (r.has_tie and r.num_entities == 2) == (r.direction == "equal")
    assert 0.03 < sum(r.has_tie for r in rows) / len(rows) < 0.2


def test_training_triple(spark):
    rows = spark.createDataFrame([([5, 6, 7], [8, 9])], "p array<int>, a array<int>")
    got = rows.select(reasoning.training_triple(F.col("p"), F.col("a"), 64).alias("t")).first().t
    assert (len(got.x), len(got.y), sum(got.mask)) == (63, 63, 3)
    assert [y for y, m in zip(got.y, got.mask, strict=True) if m] == [8, 9, 2]
    with pytest.raises(Exception, match="more than 4"):
        rows.select(reasoning.training_triple(F.col("p"), F.col("a"), 4)).collect()


def test_batches_have_numbers_of_their_own(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    got = reasoning.shuffled(rows, "k", 7, seed=3, parts=5).collect()
    sizes = Counter(r.batch for r in got)
    assert len(got) == 500 and max(sizes.values()) == 7 and sorted(sizes) == list(range(len(sizes)))
    assert sum(n < 7 for n in sizes.values()) <= 5
    assert {(r.k, r.batch) for r in got} == {(r.k, r.batch) for r in reasoning.shuffled(rows.repartition(3), "k", 7, seed=3, parts=5).collect()}


def test_examples_cover_all_tokens(spark):
    got = reasoning.examples_of(ids(spark, range(25), []), "ids", 10).collect()
    assert [(r.id, r.part, r.ids) for r in got] == [(0, 0, list(range(10))), (0, 1, list(range(10, 20))), (0, 2, list(range(20, 25))), (1, 0, [])]


def test_running_total_of_a_hot_source(spark):
    rows = [("hot", i, i % 5) for i in range(3000)] + [("a", 1, 2), ("a", 2, None), ("a", 3, 4)]
    got = ledger.running_total(spark.createDataFrame(rows, "s string, pos long, t long").repartition(7), "s", "pos", "t").collect()
    sums, want = Counter(), {}
    for s, p, t in rows:
        want[s, p] = sums[s]
        sums[s] += t or 0
    assert {(r.s, r.pos): r.before for r in got} == want


def test_crawl_ends_after_so_many_documents(spark):
    edges = spark.range(1, 40).selectExpr("id div 3 as parent", "id as child")
    roots = spark.range(1).withColumnRenamed("id", "node")
    whole = ledger.reachable(edges, roots)
    assert whole.count() == 40 and whole.columns == ["node", "depth"]
    part = ledger.reachable(edges, roots, documents=8).collect()
    assert sorted(r.node for r in part) == list(range(8)) and all(r.cut for r in part)
    assert not ledger.reachable(edges, roots, documents=40).first().cut


def test_loops_and_distinct_ngrams_of_long_texts(spark):
    r = random.Random(5)
    texts = [[r.choice("abcdefgh") for _ in range(3000)] for _ in range(3)] + [["a"] * 3000, ["ab", "c"], ["a", "bc"]]
    texts[0] += texts[0][-700:] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, ids array<string>")
    got = rows.select("id", metrics.distinct_n(F.col("ids"), 2).alias("d"), metrics.loops(F.col("ids")).alias("l")).orderBy("id").collect()
    for x, t in zip(got, texts, strict=True):
        pairs = list(zip(t, t[1:]))
        assert abs(x.d - len(set(pairs)) / len(pairs)) < 1e-12
        assert x.l == any(t[-3 * p : -2 * p] == t[-2 * p : -p] == t[-p:] for p in range(2, len(t) // 3 + 1))


def test_text_scan_in_registry_order(spark, tmp_path):
    for d, t in (("one", "a\n\nb"), ("two", "b\n \nc")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f.txt").write_text(t)
    got = files.text_segments(spark, [("s2", str(tmp_path / "two"), "manual"), ("gone", str(tmp_path / "gone"), "manual"), ("s1", str(tmp_path / "one"), "downloaded")])
    assert [(r.source, r.pos, r.text) for r in got.orderBy("source_rank", "pos").collect()] == [("s2", 0, "b"), ("s2", 1, "c"), ("s1", 0, "a"), ("s1", 1, "b")]


def test_wiki_dump(spark, tmp_path):
    import bz2

    page = "<page><title>{}</title><ns>{}</ns>{}<revision><text>{}</text></revision></page>"
    xml = "<mediawiki>" + page.format("A", 0, "", "text") + page.format("B", 1, "", "talk") + page.format("C", 0, '<redirect title="A"/>', "#REDIRECT [[A]]") + "</mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    assert [r.title for r in files.wiki_pages(spark, str(tmp_path / "d.xml.bz2")).collect()] == ["A"]
    assert [r.title for r in files.wiki_pages(spark, str(tmp_path / "d.xml.bz2"), by_text=True).collect()] == ["A"]


def test_stream_is_drained_once(spark, tmp_path):
    from granary.streaming import collect

    spark.createDataFrame([("k1", "good words here"), ("k2", "123")], "key string, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        collect.collected(spark, str(tmp_path / "in"), "key string, text string", LATIN, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out/raw")).count() == 2
    assert [r.key for r in spark.read.parquet(str(tmp_path / "out/clean")).collect()] == ["k1"]
    assert {r.key: r.status for r in spark.read.parquet(str(tmp_path / "out/ledger")).collect()} == {"k1": "done", "k2": "filtered_below_min_words"}


def test_section_upsert():
    assert files.upsert_section("# r\n## a\n1\n## b\n2\n", "a", "9") == "# r\n## a\n9\n## b\n2\n"


def test_common_subsequences_of_long_texts():
    import time

    from granary.functions.udfs import common_length

    r = random.Random(1)
    for _ in range(300):
        x, y = ([r.choice("abcde") for _ in range(r.randint(0, 30))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for w in x:
            corner = 0
            for j, v in enumerate(y, 1):
                corner, row[j] = row[j], corner + 1 if w == v else max(row[j], row[j - 1])
        assert common_length(x, y) == row[-1]
    x, y = ([r.randrange(500) for _ in range(20_000)] for _ in range(2))
    start = time.process_time()
    assert common_length(x, y) > 1000 and time.process_time() - start < 1


def test_losses_of_hot_words_and_draws_over_whole_streams(spark):
    words = [("hot" if i % 3 else f"w{i % 50}") if i % 7 else "\x001" for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate(words)), "pos long, w string").repartition(5)
    n = Counter(words)
    for many in (2, 40, 1024):
        got = {(r.pos, r.w): r.loss for r in metrics.with_unigram_loss(rows, "w", many).collect()}
        assert len(got) == 3000 and all(abs(got[i, w] + math.log((n[w] + 1) / (3000 + len(n)))) < 1e-12 for i, w in enumerate(words))
    assert metrics.with_unigram_loss(rows.limit(0), "w").count() == 0
    sizes = spark.createDataFrame([("a", 100_000), ("b", 65), ("c", 64)], "s string, n long")
    starts = metrics.random_starts(sizes, 200, 64).collect()
    a = sorted(r.start for r in starts if r.s == "a")
    assert len(a) == 200 and a[0] < 10_000 and 90_000 < a[-1] <= 99_935 and len(set(a)) > 190
    assert {r.start for r in starts if r.s == "b"} == {0} and not [r for r in starts if r.s == "c"]


@pytest.mark.parametrize(("limit", "most"), [(1, 3), (7, 3), (40, 12), (5000, 12)])
def test_shards_of_streams_over_many_ranges(spark, limit, most):
    r = random.Random(limit)
    rows = [("hot", i, r.choice([0, 1, most, None])) for i in range(2500)] + [(f"s{i % 9}", i, r.randint(0, most)) for i in range(200)] + [("even", i, 1) for i in range(700)] + [(None, i, 2) for i in range(90)]
    table = spark.createDataFrame(rows, "s string, k long, t int").selectExpr("s as stream", "k as pos", "cast(t as long) as tokens").repartition(5)
    got = folds.shards(table, limit, ranges=13).collect()
    state, want = {}, {}
    for s, k, t in rows:
        shard, held = state.get(s, (0, 0))
        want[s, k] = shard
        held += t or 0
        state[s] = (shard + 1, 0) if held >= limit else (shard, held)
    assert {(x.stream, x.pos): x.shard for x in got} == want and len(got) == len(rows)


def test_caps_cut_groups_before_the_shuffle(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'a', 'b') as s", "id")
    capped = ledger.first_n(rows, "s", "id", 7)
    assert "WindowGroupLimit" in (plan := capped._jdf.queryExecution().executedPlan().toString()).split("Exchange", 1)[1], plan
    assert sorted(r.id for r in capped.collect()) == sorted([*range(0, 21, 3), *[i for i in range(20) if i % 3][:7]])


def test_losses_by_counts_equal_those_by_tokens(spark):
    r = random.Random(6)
    docs = [(i, "ab"[i % 3 == 0], " ".join(r.choice(["x", "x", "x", "y", f"w{r.randint(0, 30)}"]) for _ in range(r.choice([0, 1, 5, 60])))) for i in range(60)]
    table = spark.createDataFrame(docs, "d long, s string, text string").repartition(4)
    words = F.filter(F.split("text", " "), lambda x: x != "")
    streams = {k: [w for _, s, t in docs if s == k for w in t.split()] for k in "ab"}
    tokens = spark.createDataFrame([(k, i, w) for k, ws in streams.items() for i, w in enumerate(ws)], "s string, pos long, w string")
    losses, sums = metrics.unigram_model(table, "s", words)
    each = metrics.with_unigram_loss(tokens, "w").select("s", "pos", "loss")
    by_token = {r.s: (r.n, r.loss) for r in each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss")).collect()}
    assert {r.s: r.tokens for r in sums.collect()} == {k: len(v) for k, v in streams.items()}
    assert all(abs(r.loss - by_token[r.s][1]) < 1e-9 for r in sums.collect())
    wanted = spark.createDataFrame([(k, p, 1) for k in "ab" for p in {0, 1, 17, len(streams[k]) - 1, len(streams[k])}], "s string, pos long, k int")
    places = metrics.placed(table, "s", "d", words)
    got = {(r.s, r.pos): r.w for r in metrics.words_at(table, "s", "d", words, places, wanted, block=16).collect()}
    assert got == {(k, p): streams[k][p] for k in "ab" for p in {0, 1, 17, len(streams[k]) - 1}}
    full = {r.s: (r.loss, r.tokens) for r in metrics.window_losses(each, "s", 50).collect()}
    left = {k: sum(1 for p in range(len(v)) if p == 0 or p > (len(v) - 1) // 50 * 50) for k, v in streams.items()}
    assert {k: n for k, (_, n) in full.items()} == {k: len(v) - left[k] for k, v in streams.items()}
    one = metrics.sampled_loss(each.where("s = 'a'"), spark.createDataFrame([(3,), (3,), (9,)], "start long"), 20).first()
    assert one.tokens == 60 and losses.count() == len({w for v in streams.values() for w in v})


def test_clipped_ngrams_equal_counters_and_are_not_shuffled(spark):
    import random
    from collections import Counter

    import numpy as np

    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), *("".join(draw.choices("xyz\u00e9\U00010330", k=draw.randrange(30))) for _ in range(2))) for _ in range(60)] + [("a", None, "xy"), ("b", "xy", None), ("c", "", "")]
    want = {}
    for g, x, y in rows:
        for n in range(1, 7) if y is not None else ():
            a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (x or "", y))
            if a or b:
                had = want.get((g, n), (0, 0, 0))
                want[g, n] = (had[0] + sum((a & b).values()), had[1] + sum(a.values()), had[2] + sum(b.values()))
    df = spark.createDataFrame(rows, "g string, x string, y string").repartition(3)
    for cols in (df, df.select("g", *(F.filter(F.split(c, ""), lambda v: v != "").alias(c) for c in "xy"))):
        got = metrics._matched(cols, "g", "x", "y", 6)
        assert {(r.g, r.n): (r.matches, r.hyps, r.refs) for r in got.collect()} == want
        assert "MapInArrow" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan
    wide = [np.array([1 << 40, 5, 1 << 40, 5, 7]), np.array([5, 1 << 40, 5, 7])]  # numbers that don't fit as digits
    assert metrics._clipped(np.array([0]), wide, [np.array([5]), np.array([4])], 3).tolist() == [[[4, 5, 4], [3, 4, 3], [2, 3, 2]]]
    assert metrics.bleu(spark.createDataFrame([("g", [], ["a"])], "g string, hyp array<string>, ref array<string>"), "g").first().bleu == 0
