"""What is to be fetched, from stored responses: sitemaps, listings, JSON APIs, archive indexes.

Responses are rows; a body is null where a fetch failed. Fetching itself is no part of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger
from . import files

ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"' >]*)[\"']?[^>]*>(.*?)</a>"


def combined(*found: DataFrame) -> DataFrame:
    """What several ways of discovery found (source, url), each once."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def chosen(rows: DataFrame, sources: list[str] | None, by: str = "source") -> DataFrame:
    """Rows of the named sources; of all where none is named."""
    return rows.where(F.col(by).isin(sources)) if sources else rows


def wanted_urls(rows: DataFrame, skip: str, url: str = "url") -> DataFrame:
    """Rows whose url a skip pattern doesn't find anything in."""
    return rows.where(~F.col(url).rlike(skip))


def sitemap_articles(bodies: DataFrame, exclude: str) -> DataFrame:
    """url of all articles in two levels of sitemaps: url, body of both. Child sitemaps that `exclude` fits are left out."""
    body = F.col("body")
    listed = bodies.where(files.is_index(body)).select(F.explode(files.sitemap_locations(body)).alias("child")).distinct()
    leaves = bodies.where(~files.is_index(body)).join(listed.withColumn("_l", F.lit(True)), F.col("url") == F.col("child"), "left")
    return leaves.where(F.col("_l").isNull() | ~F.col("url").rlike(exclude)).select(F.explode(files.sitemap_locations(body)).alias("url")).distinct()


def api_items(pages: DataFrame, by: str, schema: str, items: str, below: int) -> DataFrame:
    """by, offset, pos, item: items of an offset-paginated JSON API.

    pages (by, offset, body) under `below` count up to the first that is empty, failed or no JSON.
    """
    got = pages.where(F.col("offset") < below).select(by, "offset", F.from_json("body", schema).alias("_j"))
    got = got.select(by, "offset", F.col(f"_j.{items}").alias("_items")).withColumn("_full", F.coalesce(F.size("_items") > 0, F.lit(False)))
    return ledger.before_empty_run(got, by, "offset", "_full", stop=1).where("_full").select(by, "offset", F.posexplode("_items").alias("pos", "item"))


def search_items(pages: DataFrame, by: str, most: int = 10_000) -> DataFrame:
    """by, identifier, found: of an archive's search responses (by, start, body), sorted by identifier; the service
    answers for the first `most` only, so `found` may be larger than the number of rows."""
    schema = "response struct<numFound: long, docs: array<struct<identifier: string>>>"
    got = pages.where(F.col("start") < most).select(by, F.from_json("body", schema).alias("j")).where("j.response.docs is not null")
    return got.select(by, F.explode("j.response.docs.identifier").alias("identifier"), F.col("j.response.numFound").alias("found")).distinct()


def archived_pages(indexes: DataFrame, skip: str) -> DataFrame:
    """by, key, timestamp, original from JSON capture indexes (by, body): HTML pages of status 200, without the urls
    that `skip` finds something in; of equal keys (no query, no slash at the end) the last row wins."""
    key = F.regexp_replace(F.substring_index("original", "?", 1), "/+$", "")
    rows = indexes.select("by", F.posexplode(files.captures(F.col("body"))).alias("pos", "r"))
    rows = rows.select("by", "pos", *(F.get("r", i).alias(n) for i, n in enumerate(("original", "timestamp", "status", "mime"))))
    rows = wanted_urls(rows.where("status = '200' and mime like '%html%'"), skip, "original").withColumn("key", key)
    return ledger.last_per_key(rows.select("by", "key", "pos", "timestamp", "original"), ["by", "key"], F.col("pos")).drop("pos")


def anchors(html: Column) -> Column:
    """array<struct<href, title>> of a page's links, titles without tags."""
    whole = F.regexp_extract_all(html, F.lit(ANCHOR), 0)
    part = lambda x, i: F.regexp_extract(x, ANCHOR, i)
    return F.transform(whole, lambda x: F.struct(part(x, 1).alias("href"), F.trim(F.regexp_replace(part(x, 2), "<[^>]*>", "")).alias("title")))


def first_titles(pages: DataFrame, key: str) -> DataFrame:
    """key, title of listing links (pos, html); the first title of a key wins. key: regex, the key its first group."""
    rows = pages.select("pos", F.posexplode(anchors(F.col("html"))).alias("i", "a")).select("pos", "i", "a.title", F.regexp_extract("a.href", key, 1).alias("key"))
    return ledger.first_per_key(rows.where("key <> ''").select("key", "title", F.struct("pos", "i").alias("at")), ["key"], F.col("at")).drop("at")


def titled(pages: DataFrame, word: str) -> DataFrame:
    """pos, title, href of listing links whose title holds a word, in any case."""
    rows = pages.select("pos", F.explode(anchors(F.col("html"))).alias("a")).select("pos", "a.title", "a.href")
    return rows.where(F.lower("title").contains(word.lower()))


def distinct_in_order(values: Column, fits: str) -> Column:
    """Those of an array that a regex fits, each once, at its first place."""
    return F.array_distinct(F.filter(values, lambda x: x.rlike(fits)))


def word_ranges(html: Column, language: int) -> Column:
    """array<struct<first, last>> of a dictionary's ranges of words, as a page calls them for a language."""
    call = r"loadWordRange\(\s*this\s*,\s*'([^']*)'\s*,\s*'([^']*)'\s*,\s*(\d+)"
    whole = F.regexp_extract_all(html, F.lit(call), 0)
    all_ = F.transform(whole, lambda x: F.struct(F.regexp_extract(x, call, 1).alias("first"), F.regexp_extract(x, call, 2).alias("last"), F.regexp_extract(x, call, 3).cast("int").alias("l")))
    return F.transform(F.filter(all_, lambda r: r["l"] == language), lambda r: F.struct(r["first"], r["last"]))


def dictionary_entries(body: Column) -> Column:
    """Entries of a dictionary's JSON answer, for text.dictionary_prose; null where it reports no success."""
    j = F.from_json(body, "success boolean, data struct<words: array<struct<word: string, meanings: array<struct<text: string>>>>>")
    return F.when(j["success"], j["data"]["words"])


def channel_ids(body: Column) -> Column:
    """Video ids of a channel's listing, one a line; null where it has none."""
    ids = F.filter(F.transform(F.split(body, T.ANY_LINE), T.strip), lambda x: x != "")
    return F.when(F.size(ids) > 0, ids)
