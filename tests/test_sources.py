"""Files, sinks, listings, vocabularies and streams, on small fixtures."""

import bz2
import lzma
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.tokens import Vocabulary
from granary.operators import metrics
from granary.plans import corpus
from granary.presets import ACCENTED, LATIN
from granary.sources import commits, files, listings, segments, sinks, tokenfiles
from granary.streaming import collect

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def test_multistream_ranges_become_pages(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><revision><text>{}</text></revision></page>"
    parts = [page.format("A", 0, "one") + page.format("B", 0, "#redirect [[A]]"), page.format("C", 0, "two") + page.format("D", 2, "no"), "x"]
    chunks = [bz2.compress(p.encode()) for p in parts[:2]] + [b"broken"]
    at = [0, len(chunks[0]), len(chunks[0]) + len(chunks[1]), sum(map(len, chunks))]
    (tmp_path / "d.bz2").write_bytes(b"".join(chunks))
    ranges = spark.createDataFrame(list(zip(at, at[1:])), "start long, end long")
    got = files.multistream_chunks(ranges, str(tmp_path / "d.bz2"))
    assert [r.xml is None for r in got.orderBy("start").collect()] == [False, False, True]
    assert sorted((r.start, r.title, r.text) for r in files.chunk_pages(got).collect()) == [(0, "A", "one"), (at[1], "C", "two")]
    index = files.multistream_index(spark.createDataFrame([("12:3:a:b",)], "value string")).first()
    assert (index.offset, index.page_id, index.title) == (12, 3, "a:b")


def test_compressed_lines_and_token_files(spark, tmp_path):
    (tmp_path / "a.xz").write_bytes(lzma.compress("".join(f"line {i}\r\n" for i in range(25)).encode() + b"\xff end"))
    got = [r.line for r in files.xz_text(spark, str(tmp_path / "a.xz"), lines=10).collect()]
    assert got == [*(f"line {i}" for i in range(25)), "� end"]
    np.arange(70000, 70025).astype("<u2").tofile(tmp_path / "t.bin")
    rows = files.token_files(spark, str(tmp_path / "t.bin"), 10).orderBy("pos").collect()
    assert [(r.pos, len(r.ids)) for r in rows] == [(0, 10), (1, 10), (2, 5)] and rows[2].ids[-1] == 70024 % 65536


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "k long, t string, v double")
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"k":1,"t":"a","v":null}', '{"k":2,"t":"b","v":0.5}']
    sinks.write_report(rows.groupBy().agg(F.struct(F.max("k").alias("k")).alias("m")), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ['{"m":{"k":2}}']
    for i in range(2):
        sinks.append_csv(spark.createDataFrame([(i, 0.1 * i, 0.2, 0.3, 1.0)], "step long, train_loss double, val_loss double, lr double, elapsed_s double"), str(tmp_path / "c"))
    assert sorted(r.step for r in files.loss_log(spark, str(tmp_path / "c")).collect()) == [0, 1]
    sinks.append_log(spark.sql("select timestamp'2020-01-02 03:04:05' as at, 'done' as message"), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["- [2020-01-02 03:04:05] done"]


def token_rows(n=400, seed=1):
    r = random.Random(seed)
    return [(i, [r.randrange(65536) for _ in range(r.choice([0, 1, 7, 50, 200]))]) for i in range(n)]


def test_token_stream_round_trip(spark, tmp_path):
    rows = token_rows()
    stream = [x for _, ids in rows for x in ids]
    df = spark.createDataFrame([*rows, (None, None)], "pos int, ids array<int>").repartition(7)
    tokenfiles.write_tokens(df, f"{tmp_path}/t", "pos")
    tokenfiles.write_tokens(spark.createDataFrame([(1, [1, 65535]), (0, [3])], "k int, ids array<long>"), f"{tmp_path}/t", "k", mode="append")
    stream += [3, 1, 65535]
    for window, size in ((10, 64), (1, 4000), (1000, 1 << 20), (7, 1), (100_000, 10)):
        read = tokenfiles.read_tokens(spark, f"{tmp_path}/t", window, range_bytes=size)
        got = sorted((r.pos, r.ids) for r in read.collect())
        assert got == [(a, stream[a : a + window]) for a in range(0, len(stream), window)]
    got = sorted((r.pos, r.ids) for r in tokenfiles.read_tokens(spark, f"{tmp_path}/t", 16, more=1, range_bytes=100, **{"from": 100, "to": 900}).collect())
    assert got == [(a, stream[a : a + 17]) for a in range(112, 900, 16)]
    tokenfiles.write_tokens(df.limit(0), f"{tmp_path}/t", "pos")
    assert tokenfiles.read_tokens(spark, f"{tmp_path}/t").count() == 0
    assert not [f for f in os.listdir(f"{tmp_path}/t") if f.endswith(".bin")]


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    np.arange(1_000_000).astype("<u2").tofile(tmp_path / "t.bin")
    read = tokenfiles.read_tokens(spark, str(tmp_path / "t.bin"), 1000, range_bytes=100_000)
    assert read.rdd.getNumPartitions() == 20
    assert read.select(F.sum(F.size("ids")), F.count_if(F.element_at("ids", 1) == F.col("pos") % 65536)).first()[:] == (1_000_000, 1000)
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole 16-bit"):
        tokenfiles.read_tokens(spark, str(tmp_path / "odd.bin")).collect()


def test_failed_jobs_and_attempts_leave_no_tokens(spark, tmp_path):
    rows = spark.createDataFrame(token_rows(60), "pos int, ids array<int>").repartition(4)
    tokenfiles.write_tokens(rows, f"{tmp_path}/t", "pos")
    before = sorted(os.listdir(f"{tmp_path}/t"))
    for bad in (70000, -1, None):
        for mode in ("append", "overwrite"):
            with pytest.raises(Exception, match="16 bits"):
                tokenfiles.write_tokens(rows.withColumn("ids", F.when(F.col("pos") == 31, F.array(F.lit(bad).cast("int"))).otherwise(F.col("ids"))), f"{tmp_path}/t", "pos", mode=mode)
    assert sorted(os.listdir(f"{tmp_path}/t")) == before and not os.listdir(f"{tmp_path}/t/_jobs")
    writer = tokenfiles.Writer(f"{tmp_path}/t", False)  # a job that ends between its files and its manifest
    (tmp_path / "t/_jobs" / writer.job / "part-x.bin").write_bytes(b"xx")
    assert sum(e["bytes"] for e in commits.listed(f"{tmp_path}/t")) == 2 * rows.select(F.sum(F.size("ids"))).first()[0]


def test_channel_listings(spark):
    rows = spark.createDataFrame([(1, " a1 \r\n\nb2\nc3"), (2, ""), (3, None), (4, " \n\t")], "k int, body string")
    assert {r.k: r.ids for r in rows.select("k", listings.channel_ids(F.col("body")).alias("ids")).collect()} == {1: ["a1", "b2", "c3"], 2: None, 3: None, 4: None}


def test_listings_of_odd_responses(spark):
    pages = spark.createDataFrame([("a", 0, '{"data": [{"u": "1"}]}'), ("a", 40, None), ("a", 80, '{"data": [{"u": "3"}]}'), ("b", 0, "oops"), ("c", 0, '{"data": [{"u": "4"}, {"u": null}]}'), ("c", 4000, '{"data": [{"u": "5"}]}')], "c string, offset long, body string")
    got = listings.api_items(pages, "c", "data array<struct<u: string>>", "data", 2000).collect()
    assert sorted((r.c, r.offset, r.item.u) for r in got if r.item.u) == [("a", 0, "1"), ("c", 0, "4")]
    cdx = '[["original","timestamp","statuscode","mimetype"],["http://a/x?y","1","200","text/html"],["http://a/x/","2","200","text/html"],["http://a/x","3","404","text/html"],["http://a/tag/","4","200","text/html"],["http://a/i","5","200",null]]'
    got = listings.archived_pages(spark.createDataFrame([("s", cdx), ("t", None), ("u", "[]")], "by string, body string"), "/tag/").collect()
    assert [(r.by, r.key, r.timestamp) for r in got] == [("s", "http://a/x", "2")]
    html = "<table><a href='/file/d/7/v'> <b>One</b> </a><a href=\"/file/d/7/w\">Again</a><a href=/file/d/8/>Two</a><a>none</a></table>"
    pages = spark.createDataFrame([(0, html), (1, None)], "pos int, html string")
    assert {(r.key, r.title) for r in listings.first_titles(pages, "/file/d/([^/]+)/").collect()} == {("7", "One"), ("8", "Two")}
    assert [r.href for r in listings.titled(pages, "TWO").collect()] == ["/file/d/8/"]
    got = spark.createDataFrame([("loadWordRange(this, 'a', 'b', 2, 0) loadWordRange(this,'c','d',3,1)",)], "h string").select(listings.word_ranges(F.col("h"), 2).alias("r")).first().r
    assert [(x.first, x.last) for x in got] == [("a", "b")]


def test_vocabularies(spark):
    import os

    if not os.path.exists(PIECES):
        pytest.skip("no vocabulary files")
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["The river ran.", "", None, "ñandú 日本", "a  b\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    v = Vocabulary(PIECES)
    got = {r.i: r for r in rows.select("i", v.encode(F.col("t")).alias("ids")).withColumn("p", v.pieces(F.col("ids"))).withColumn("back", v.decode(F.col("ids"))).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == (None if t is None else theirs.encode(t))
        assert got[i].back == (None if t is None else theirs.decode(theirs.encode(t)))
    assert got[0].p == theirs.encode("The river ran.", out_type=str)
    path = "/opt/tokenizers/byte_bpe_50k.json"
    t = Tokenizer.from_file(path)
    w = Vocabulary(path)
    assert [r.x for r in rows.where("t is not null").select("i", w.encode(F.col("t")).alias("x")).orderBy("i").collect()] == [t.encode(x, add_special_tokens=False).ids for x in texts if x is not None]
    import public_tokenizers

    ranks = Vocabulary("/opt/tokenizers/byte_bpe_50k.tiktoken", public_tokenizers.PATTERN)
    assert {r.ok for r in rows.where("t is not null").select((ranks.decode(ranks.encode(F.col("t"))) == F.col("t")).alias("ok")).collect()} == {True}
    sweep = {r.vocabulary: r for r in metrics.vocabulary_sweep(rows, "t", {"p": v, "w": w}).collect()}
    n = [(len(theirs.encode(x)), len(x.split()), sum(i == theirs.unk_id() for i in theirs.encode(x))) for x in texts if x is not None]
    assert sweep["p"].fertility == round(sum(a for a, b, _ in n if b) / sum(b for _, b, _ in n), 6) and sweep["p"].unk_rate == round(sum(u for *_, u in n) / sum(a for a, *_ in n), 6)
    assert sweep["w"].size == t.get_vocab_size()


def test_repeated_words_collapse(spark):
    texts = ["a a a b", "no no", "xa a a", "one one one one two two two", "a\n a\ta", "", "abab ab ab"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.collapse_repeats(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [re.sub(r"(\S+)(?:\s+\1){2,}", r"\1", t) for t in texts]


def test_kept_texts_and_normal_form(spark):
    rows = spark.createDataFrame([("b", 0, "same text", "m"), ("a", 1, "same text", "m"), ("a", 2, "été encore", "m"), ("a", 3, None, "m")], "source string, pos long, text string, bucket string")
    got = {(r.source, r.pos): r.clean for r in corpus.kept_texts(rows, LATIN).collect()}
    assert got == {("a", 1): "same text"}
    low = corpus.cleaned(spark.createDataFrame([("a", 0, "  café bien entendu  \n\n")], "source string, pos long, text string"), ACCENTED).first()
    assert low.clean == "  café bien entendu  " and low.dropped_lines == 0


def test_streams(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    days = [[("x", at(1), "a"), ("x", at(2), "a")], [("y", at(50), "b"), ("x", at(3), "c")], [("z", "2024-01-01 03:00:00", "d")]]
    src = str(tmp_path / "in")
    seen: list[tuple] = []
    for k, part in enumerate(days):
        spark.createDataFrame([(e, t, x) for e, t, x in part], "event_type string, ts string, text string").selectExpr("event_type", "cast(ts as timestamp) ts", "text").coalesce(1).write.mode("append").parquet(src)
        for name, f, mode in (("counts", collect.event_counts, "append"), ("texts", collect.distinct_stream, "append")):
            stream = f(spark.readStream.schema("event_type string, ts timestamp, text string").parquet(src))
            q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True)
            q.foreachBatch(lambda df, n, name=name: seen.extend((name, r) for r in df.collect())).start().awaitTermination()
    assert sorted(r.text for n, r in seen if n == "texts") == ["a", "b", "c", "d"]
    closed = {(r.event_type, r.window.start.hour, r.n) for n, r in seen if n == "counts"}
    assert closed == {("x", 0, 3), ("y", 0, 1)}


ODD_TEXTS = [
    b"one\ntwo\n\nthree\n \t\n\nfour\r\nfive\r\n\r\nsix", b"", b"\n\n\n", b"\n x \n\n y", b"a\n\nb\n\n", b"one segment\nof lines\nonly\n", b"\r\ra\r\rb\rc",
    "é\u00a0ü\n\u00a0\n\nß\n\n\u00a0\n\nend".encode(), b"bad \xff bytes\n\n\xe2\x82", b"x\n" * 20, b"\x1c\n\n\x1cz",
]


@pytest.mark.parametrize("split", [1, 3, 1 << 20])
def test_segments_of_files_cut_anywhere(spark, tmp_path, split):
    for i, t in enumerate(ODD_TEXTS):
        (tmp_path / f"f{i:02d}.txt").write_bytes(t)
    want = [(r.path.split("/")[-1], r.pos, r.text) for r in files.text_segments(spark, [("s", str(tmp_path), "b")]).collect()]
    got = [(r.path.split("/")[-1], r.pos, r.text) for r in segments.file_segments(spark, str(tmp_path), split_bytes=split).collect()]
    assert sorted(got) == sorted(want) and len(want) > 15


def test_first_value_is_that_of_the_recursive_search(spark):
    from granary.functions import udfs
    from granary.sources.articles import first_value

    r = random.Random(9)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice([1, None, "text", '{"k":1}', True, 2.5, "", [], {}])
        if r.random() < 0.4:
            return [tree(depth - 1) for _ in range(r.randint(0, 3))]
        return {x: tree(depth - 1) for x in r.sample(["k", "zz", "a", "m", "ü"] if r.random() < 0.3 else ["zz", "a", "m", "ü"], r.randint(0, 3))}

    import json

    blobs = [json.dumps(tree(6), ensure_ascii=i % 2 == 0) for i in range(300)] + ['{"k":', "", "k", '"k"', '{"k":{"b":[1, 2]}}x', '{"a":{"k":{"z":1,"a":[{"q":"x"}]}}}', None]
    rows = spark.createDataFrame(list(enumerate(blobs)), "id long, blob string").repartition(3)
    want = {r.id: r.found for r in rows.select("id", udfs.find_key("k")("blob").alias("found")).collect() if r.found is not None}
    got = {r.id: r.found for r in first_value(rows, "id", "blob", "k").collect()}
    assert set(got) == set(want) and len(want) > 60

    def value(x):
        try:
            return json.loads(x)
        except ValueError:
            return x

    assert all(value(got[i]) == (v if isinstance(v := json.loads(want[i]), int | float | list | dict) else value(v)) for i in want)


def test_each_page_has_its_own_layer_or_ocr_and_runs_go_on(spark):
    from granary.presets import ASSAMESE

    good, poor = "কখগ ৰৱ ঘঙচ", "only latin letters"
    pages = [("a", 1, good, None), ("a", 2, poor, "চছজ র"), ("a", 3, None, "ঝঞ"), ("b", 1, poor, None), ("b", 2, good + "\nlatin line", "x")]
    table = spark.createDataFrame(pages, "file string, page long, layer string, ocr string")
    ledger = spark.createDataFrame([("a", 1, 0, 1)], "file string, last_page long, ocr_pages long, text_pages long")
    got = corpus.page_texts(table, ledger, ASSAMESE)
    rows = {(r.file, r.page): (r.used_ocr, r.raw, r.clean) for r in got.collect()}
    assert rows == {("a", 2): (True, "চছজ ৰ", "চছজ ৰ"), ("a", 3): (True, "ঝঞ", "ঝঞ"), ("b", 1): (True, "", ""), ("b", 2): (False, good + "\nlatin line", good)}
    assert sorted(map(tuple, corpus.page_ledger(ledger, got).collect())) == [("a", 3, 2, 1), ("b", 2, 1, 1)]
    assert corpus.page_texts(table, corpus.page_ledger(ledger, got), ASSAMESE).count() == 0
