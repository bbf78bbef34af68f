import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import udfs, wikitext
from granary.presets import ASSAMESE, DEVANAGARI, LATIN
from granary.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


def ratio(t):
    letters = [c for c in t if c.isalpha()]
    return sum("ऀ" <= c <= "ॿ" for c in letters) / len(letters) if letters else 0.0


def test_script_ratio_counts_letters_only(spark):
    for t in ("", "12 !", "हिन्दी", "abc हिन्दी", "ক abc", "हिं"):
        assert abs(one(spark, t, lambda c: T.script_ratio(c, DEVANAGARI)) - ratio(t)) < 1e-12
    assert one(spark, None, lambda c: T.script_ratio(c, DEVANAGARI)) == 0.0


def test_a_line_at_the_threshold_stays_and_drops_are_counted(spark):
    got = one(spark, "ab কখ\n\nabc ক\n  কখ  \n12", lambda c: T.clean(c, ASSAMESE))
    assert (got.text, got.dropped) == ("ab কখ\nকখ", 2)


def test_plain_cleaning_keeps_white_space_in_lines(spark):
    assert one(spark, " हिन्दी \nabc", lambda c: T.clean(c, DEVANAGARI)).text == " हिन्दी "


def test_markers_need_thirty_characters(spark):
    few, many = "ক" * 29, "ক" * 30
    assert one(spark, few, lambda c: T.likely_language(c, ASSAMESE))
    assert not one(spark, many, lambda c: T.likely_language(c, ASSAMESE))
    assert one(spark, "ৰ" + "ক" * 199, lambda c: T.likely_language(c, ASSAMESE))


def test_tokens_split_at_unicode_white_space(spark):
    for t in ("a b c", "a\x1cb", "", "  ", "x"):
        assert one(spark, t, T.rough_tokens) == len(t.split())
    assert one(spark, None, T.rough_tokens) == 0


def test_blank_lines_part_segments(spark):
    got = one(spark, "a\nb\n \t\nc\n\n\n\nd", files.segments)
    assert list(got) == ["a\nb", "c", "d"]


def test_runs_of_three_words_collapse(spark):
    assert one(spark, "a a b b b c", T.collapse_repeats) == "a a b c"


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\n00:01 --> 00:02\n<c>hello</c>\nhello\nworld\nhello"
    assert one(spark, vtt, T.caption_text) == "hello\nworld\nhello"


def test_wikitext(spark):
    t = "<!-- x -->'''Bold''' [[a|b]] [[c]] {{t|{{u}}}}\n== Head ==\n* item<ref>r</ref> [http://x y z] [[File:a.jpg|[[q]] cap]]&amp;"
    assert one(spark, t, udfs.wiki_prose) == "Bold b c \nHead\nitem y z &"
    assert one(spark, "a {{x}} [[b|c]]", udfs.wiki_strip) == "a   c"
    assert one(spark, None, udfs.wiki_prose) is None


def test_wiki_markup_by_fixtures():
    prose = [
        ("{{a {{b|{{c}}}} d}}x{|\n| {| inner |}\n|}y", "xy"), ("open {{ a {{b}} c", "open  a  c"), ("[[a|b|c]] [[d]] [[e|]]", "b|c d e"),
        ("[[Category:X]][[image: a.png|thumb|[[b]] and [[c|d]]]]z", "z"), ("[[ns:a]]", "ns:a"), ("[https://x.y a b] [http://x]!", "a b !"),
        ("'''''b''''' it's ''i''", "b it's i"), ("=== H ===\n=\n** item\n#:;x\n;", "H\n=\nitem\nx"), ("a<br/>b<span class='x'>c</span> 1 < 2", "abc 1 < 2"),
        ("&lt;b&gt; &amp;amp;", "<b> &amp;"), ("a<!-- x --> b <!-- y", "a b <!-- y"), ("a<ref name=q/>b<ref>\nlong {{t}}</ref>c", "abc"), ("a\n\n\n\nb ]] }", "a\n\nb"), ("", ""),
    ]
    assert [wikitext.prose(t) for t, _ in prose] == [want for _, want in prose]
    strip = [("a{{t|{{u}}}}b", "a b"), ("[[ns:a]] [[x:y|z]] [[p]]", "a z p"), ("[http://x] [http://x l]", "  l"), (" * i\n== H ==", "i\nH"), ("a<br>&amp;", "a &amp;"), ("{|\n|a\n|}b", " b"), ("a<ref>x</ref>b<ref n/>", "a b ")]
    assert [wikitext.stripped(t) for t, _ in strip] == [want for _, want in strip]


def test_names_of_urls(spark):
    assert one(spark, "http://A.b/c?d=1", T.slug) == "http_a_b_c_d_1"
    assert one(spark, "http://a.b/c//?d", T.canonical_url) == "http://a.b/c"


def test_nfc_and_digests(spark):
    t = "é"
    assert one(spark, t, udfs.nfc) == unicodedata.normalize("NFC", t)
    assert 0 <= one(spark, t, udfs.blake2b_bucket) < 100
    assert re.fullmatch("[0-9a-f]{32}", one(spark, t, udfs.blake2b_128))
    assert one(spark, None, udfs.nfc) is None


def test_container_with_unclosed_tags(spark):
    page = "<div><article class='m'><p>One<br><p>Two <b>three</b><script>x</script></article>after"
    assert one(spark, page, udfs.container_text("article.m")) == "One\nTwo\nthree"
    assert one(spark, page, udfs.container_text("main")) is None


def test_first_key_in_depth_first_order(spark):
    assert one(spark, '{"a":[{"b":{"articleData":1}}],"articleData2":2}', udfs.find_key()) == "1"
    assert one(spark, "{", udfs.find_key()) is None


def test_impossible_json_path_gives_null(spark):
    page = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"ssrPageContent":{"content":"<p>x"}}}}</script>'
    assert one(spark, page, files.next_data) == "<p>x"
    assert one(spark, "<html>", files.next_data) is None


def test_latin_preset_splits(spark):
    assert one(spark, 99, lambda c: T.split_name(c), "int") == "test"
    assert LATIN.min_ratio == 0.95


def test_table_functions_equal_the_column_forms(spark):
    from granary.functions import udtfs
    from granary.operators import metrics
    from granary.sources import files

    udtfs.register(spark)
    texts = ["one\ntwo\n\nthree\n \t\n\nfour\r\nfive\r\n\r\nsix", "", None, "\n\n\n", "\n x \n\n y", "a\u00a0\n\n\u00a0\n\nb", "x"]
    spark.createDataFrame(list(enumerate(texts)), "id int, body string").createOrReplaceTempView("udtf_texts")
    got = spark.sql("SELECT id, s.pos, s.text FROM udtf_texts, LATERAL segments(body) s")
    want = spark.table("udtf_texts").select("id", F.posexplode(files.segments(F.col("body"))).alias("pos", "text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 9
    spark.createDataFrame([(k, i, f"t{i % (k + 1)}") for k in range(5) for i in range(2 * k)], "k int, i int, t string").createOrReplaceTempView("udtf_tokens")
    for n in (1, 2, 3):
        got = spark.sql(f"SELECT k, i, gram FROM ngrams({n}, TABLE(udtf_tokens) PARTITION BY k ORDER BY i)")
        arrays = spark.table("udtf_tokens").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]).alias("ids"))
        want = arrays.select("k", F.posexplode(metrics.ngrams(F.col("ids"), n)).alias("i", "gram")).select("k", (F.col("i") + n - 1).alias("i"), "gram")
        assert sorted((r.k, r.i, tuple(r.gram)) for r in got.collect()) == sorted((r.k, r.i, tuple(r.gram)) for r in want.collect())
    for bad in ("SELECT * FROM ngrams(0, TABLE(udtf_tokens) PARTITION BY k)", "SELECT * FROM segments(1)"):
        with pytest.raises(Exception, match=r"ngrams\(\)|segments\(\)"):
            spark.sql(bad).collect()


def test_vocabularies_get_a_batch_in_bounded_pieces():
    import pyarrow as pa

    from granary.functions import tokens

    class Spelled:
        most = 0

        def encode(self, texts):
            self.most = max(self.most, sum(len(t.encode()) for t in texts))
            return [list(map(ord, t)) for t in texts]

        def decode(self, ids):
            self.most = max(self.most, len(ids))
            return "".join(map(chr, ids))

    texts = ["ab\u00e9" * 5, None, "", "x" * 90, *["abcd"] * 100, None]
    codec = Spelled()
    ids = udfs.by_pieces(pa.array(texts), lambda t: tokens._encoded(codec, t), pa.list_(pa.int32()), 100)
    assert ids.to_pylist() == [None if t is None else list(map(ord, t)) for t in texts] and codec.most <= 100
    assert udfs.by_pieces(ids, lambda r: tokens._decoded(codec, r), pa.string(), 100).to_pylist() == texts and codec.most <= 100
    assert [len(p) for p in udfs.pieces(pa.array(["x" * 9, "y", None, "z"]), 2)] == [1, 3]
    assert udfs.by_pieces(ids[:0], lambda r: tokens._decoded(codec, r), pa.string()).to_pylist() == []


def test_references_without_semicolon_stay_if_asked(spark):
    page = "<article><h1>a&amp</h1>b &lt;c&#62; &notit; &AMP; & &&amp;amp;</article>"
    assert one(spark, page, udfs.container_text("article", unclosed=False)) == "a&amp\nb <c> &notit; & & &&amp;"
    assert one(spark, "<article>a&amp</article>", udfs.container_text()) == "a&"


def test_upper_case_by_letter(spark):
    assert one(spark, "stra\u00dfe \u01f0 \ufb01 \u1fb3x", T.upper_by_letter) == "STRA\u1e9eE \u01f0 \ufb01 \u1fbcX"
    assert one(spark, "h\u00e9", T.upper_by_letter) == "H\u00c9" and one(spark, None, T.upper_by_letter) is None


def test_article_and_ocr_queries_equal_their_sql_on_cut_references_and_sharp_s(spark, tmp_path):
    import duckdb

    from granary import catalog

    spark.createDataFrame([(i, f"<html><article><h1>a&{'amp' * (i % 2)}</h1>b &amp; c</article></html>") for i in range(5)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "\u00df \u00e4 \u043f\u0440"), (2, "abc"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("pages", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("article_text", "article_bodies", "text_layer_or_ocr"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall())


def test_captions_and_markers_are_computed_once(spark):
    assert str(T.caption_text(F.col("t"))).count("split(t") == 1
    assert str(T.likely_language(F.col("t"), ASSAMESE)).count("regexp_replace") == 1
    lines = "\n".join(["a", "a", "", "b", "a"])
    assert one(spark, lines, T.caption_text) == "a\nb\na"
    assert one(spark, "a\u00c0\u00d7\u00ff 1", lambda c: T.count_of(c, "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff")) == 3


def test_string_functions_hold_a_batch_as_arrow(spark):
    import tracemalloc

    import pyarrow as pa

    batch = pa.array(["\u0100" + "x" * 9999] * 2000)  # 20 MB, 40 MB as Python strings
    tracemalloc.start()
    assert udfs.nfc.func(batch).equals(batch)
    assert tracemalloc.get_traced_memory()[1] < 12 << 20
    tracemalloc.stop()
