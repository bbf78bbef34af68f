"""Scans and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs

BLANK_LINES = r"\n(?:[^\S\n]*\n)+"
EXAMPLE = "domain string, num_entities int, entities array<string>, premise_form_id int, question_form_id int, direction string, has_tie boolean, prompt string, answer string"
PAGE = "title string, ns int, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"


def segments(text: Column) -> Column:
    """Blocks of a file between lines that are empty but for white space."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), BLANK_LINES), T.strip), lambda s: s != "")


def text_segments(spark: SparkSession, registry: list[tuple[str, str, str]]) -> DataFrame:
    """source, bucket, source_rank, path, pos, text of *.txt below the registered (source, folder, bucket)s that exist."""
    out = None
    for rank, (source, folder, bucket) in enumerate(registry):
        try:
            files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").format("binaryFile").load(folder)
        except Exception as e:  # a registered folder may be absent
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        content = udfs.decode_replacing(F.col("content"))
        part = files.select("path", F.posexplode(segments(content)).alias("pos", "text"))
        part = part.select(F.lit(source).alias("source"), F.lit(bucket).alias("bucket"), F.lit(rank).alias("source_rank"), "path", "pos", "text")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "source string, bucket string, source_rank int, path string, pos int, text string")


def line_segments(lines: DataFrame, by: str, order: str) -> DataFrame:
    """The same from a table of lines, for files too large to be one row: by, pos, text."""
    from pyspark.sql import Window

    blank = T.strip(F.col("line")) == ""
    island = F.sum(blank.cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("_i", island).where(~blank)
    got = rows.groupBy(by, "_i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda s: s["line"]), "\n").alias("text"))
    return got.select(by, (F.row_number().over(Window.partitionBy(by).orderBy("_i")) - 1).alias("pos"), T.strip(F.col("text")).alias("text"))


def wiki_pages(spark: SparkSession, path: str, by_text: bool = False) -> DataFrame:
    """title, text of articles in a dump (XML, also bz2): main namespace, no redirects, text not empty.

    by_text: redirects are told by the text's first word rather than by their element.
    """
    return _articles(spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path).where("ns = 0"), by_text)


def multistream_index(lines: DataFrame) -> DataFrame:
    """offset, page_id, title from `offset:page_id:title`."""
    p = F.split("value", ":", 3)
    return lines.select(p[0].cast("long").alias("offset"), p[1].cast("long").alias("page_id"), p[2].alias("title"))


def multistream_chunks(ranges: DataFrame, path: str) -> DataFrame:
    """xml of each byte range (start, end) of a multistream dump, from any store that Arrow's file systems read; a
    range that isn't whole bzip2 streams gives null."""

    def run(frames):
        import bz2

        from pyarrow.fs import FileSystem

        store, place = FileSystem.from_uri(path) if "://" in path else (FileSystem.from_uri(f"file://{path}"))
        with store.open_input_file(place) as file:
            for f in frames:
                out = []
                for a, b in zip(f["start"], f["end"], strict=True):
                    try:
                        out.append(bz2.decompress(file.read_at(int(b - a), int(a))).decode("utf-8", "replace"))
                    except (OSError, ValueError):
                        out.append(None)
                yield pd.DataFrame({"start": f["start"], "xml": out})

    return ranges.select("start", "end").mapInPandas(run, "start long, xml string")


def chunk_pages(chunks: DataFrame, by_text: bool = True) -> DataFrame:
    """start, title, text of the articles in multistream chunks (start, xml), told apart as in wiki_pages()."""
    each = chunks.select("start", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<page\b.*?</page>"), 0)).alias("page"))
    pages = each.select("start", F.from_xml("page", PAGE).alias("p")).select("start", "p.*").where("ns = 0")
    return _articles(pages, by_text, "start")


def _articles(pages: DataFrame, by_text: bool, *more: str) -> DataFrame:
    text = F.col("revision.text._VALUE")
    kept = pages.where(~T.is_redirect(text)) if by_text else pages.where("redirect is null")
    return kept.select(*more, "title", text.alias("text")).where("title <> '' and text <> ''")


def examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXAMPLE).json(path)


def loss_log(spark: SparkSession, path: str, schema: str = "step long, train_loss double, val_loss double, lr double, elapsed_s double") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def token_files(spark: SparkSession, path: str, length: int) -> DataFrame:
    """path, pos, ids: windows of `length` tokens of uint16 token files, numbered in each; the last one of a file may be
    short. Files are read by byte ranges."""
    from .tokenfiles import read_tokens

    return read_tokens(spark, path, length, per_file=True).select(F.col("file").alias("path"), F.floor(F.col("pos") / length).alias("pos"), "ids")


def xz_text(spark: SparkSession, path: str, lines: int = 10_000) -> DataFrame:
    """path, line of xz files, decompressed as a stream: a task holds the compressed file and `lines` lines."""

    def run(frames):
        import io
        import lzma
        from itertools import islice

        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                with lzma.open(io.BytesIO(content), "rt", encoding="utf-8", errors="replace", newline="") as text:
                    while part := [x.rstrip("\r\n") for x in islice(text, lines)]:
                        yield pd.DataFrame({"path": p, "line": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, line string")


def complete_pdf(content: Column) -> Column:
    """Begins and ends as a whole PDF file does."""
    tail = F.decode(F.substring(content, F.greatest(F.lit(1), F.octet_length(content) - 1023), F.lit(1024)), "ISO-8859-1")
    return (F.substring(content, F.lit(1), F.lit(4)) == F.unhex(F.lit("25504446"))) & tail.contains("%%EOF")


def sitemap_locations(body: Column, exclude: str | None = None) -> Column:
    found = F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), 1)
    return F.filter(found, lambda u: ~u.rlike(exclude)) if exclude else found


def is_index(body: Column) -> Column:
    """A urlset of which more than half are .xml files counts as an index too."""
    locs = sitemap_locations(body)
    return body.contains("<sitemapindex") | (2 * F.size(F.filter(locs, lambda u: u.endswith(".xml"))) > F.size(locs))


def links(html: Column, pattern: str = r"[^\"' >]+") -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf"(?i)<a\s[^>]*?href\s*=\s*[\"']?({pattern})"), 1))


def next_data(html: Column) -> Column:
    """Article HTML in a page's __NEXT_DATA__; null where it is missing or the page reports a status instead."""
    blob = F.try_parse_json(F.regexp_extract(html, r"(?s)<script[^>]*id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>", 1))
    at = "$.props.pageProps.ssrPageContent.content"
    status = F.try_variant_get(blob, "$.props.pageProps.ssrContentStatus", "string")
    return F.when(status.isNull(), F.nullif(F.try_variant_get(blob, at, "string"), F.lit("")))


def captures(index: Column) -> Column:
    """Rows of a web archive's JSON index without its header: array<array<string>>."""
    rows = F.from_json(index, "array<array<string>>")
    return F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))


def djvu_name(files: Column) -> Column:
    return F.try_element_at(F.filter(files, lambda f: f["format"] == "DjVuTXT"), F.lit(1))["name"]


def chapters(books: DataFrame) -> DataFrame:
    """book (prefix, n) -> codes: `ps`, then 01 to n."""
    numbers = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.lpad(i.cast("string"), 2, "0"))
    return books.select("prefix", F.explode(F.concat(F.array(F.lit("ps")), F.when(F.col("n") > 0, numbers).otherwise(F.array()))).alias("code"))


def retry_delay(attempt: Column, status: Column, base: float, tries: int = 3) -> Column:
    """Seconds until the next attempt: doubled on 429; null: no further attempt."""
    return F.when((status == 429) & (attempt + 1 < tries), base * F.pow(F.lit(2.0), attempt))


def write_splits(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_text(rows: DataFrame, path: str) -> None:
    """One column of texts, a blank line after each."""
    rows.write.mode("overwrite").option("lineSep", "\n\n").text(path)


def recleaned(rows: DataFrame, preset) -> DataFrame:
    """Texts cleaned again, segment by segment, with words before and after."""
    new = udfs.cleaned(F.col("text"), preset)["text"]
    return rows.withColumns({"words_before": T.rough_tokens(F.col("text")), "text": new, "words_after": T.rough_tokens(new)})


def upsert_section(report: str, heading: str, body: str) -> str:
    """A markdown report with the section under `## heading` replaced, or added at its end."""
    out, inside, done = [], False, False
    for line in report.splitlines():
        if line.startswith("## "):
            inside = line[3:].strip() == heading
            if inside and not done:
                out += [line, *body.splitlines()]
                done = True
        if not inside:
            out.append(line)
    return "\n".join(out if done else [*out, f"## {heading}", *body.splitlines()]) + "\n"


