"""Article bodies out of the JSON that pages carry, searched level by level on the JVM.

The search is depth first in the order of the document: a value's place is the array of its positions on the way down,
and of all hits the one of smallest place counts. Only values whose text has the key in it are looked into, and each level
is a table, so neither the depth nor the number of pages makes a plan or a task larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..plans.lineage import Scratch

NEXT_DATA = r"(?s)<script[^>]*id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>"


def page_json(html: Column) -> Column:
    """The JSON text of a page's __NEXT_DATA__ script; null without one."""
    return F.nullif(F.regexp_extract(html, NEXT_DATA, 1), F.lit(""))


def first_value(rows: DataFrame, by: str, blob: str, key: str) -> DataFrame:
    """by, found: the first value of a key in depth-first order of rows' JSON texts (by: unique), as JSON, or as it is if
    it's a string. An object that has the key isn't looked into further, also where the value is null, which is no hit.
    Texts that aren't JSON or lack the key have no row. Of a key that an object repeats the first one counts.
    """
    scratch = Scratch(rows.sparkSession)
    within = F.col("raw").contains(f'"{key}"')
    kind_of = lambda v: F.substring(F.schema_of_variant(v), 1, 1)  # noqa: E731  O(BJECT), A(RRAY) or another
    whole = F.concat(F.lit("["), F.col(blob), F.lit("]"))  # what comes after the value makes this no array of one
    level = rows.select(by, F.array().cast("array<int>").alias("place"), F.from_json(whole, "array<string>").alias("r"), F.from_json(whole, "array<variant>").alias("v")).where("size(r) = 1")
    level = level.select(by, "place", F.get("r", F.lit(0)).alias("raw"), kind_of(F.get("v", F.lit(0))).alias("kind"))
    level = scratch.written(level.where(F.col("kind").isin("O", "A") & within), "level-0")
    hits, depth = None, 0
    while True:
        texts, values = F.from_json("raw", "map<string,string>"), F.from_json("raw", "map<string,variant>")
        objects = level.where("kind = 'O'").select(by, "place", texts.alias("m"), F.map_values(values).alias("v"))
        has = F.map_contains_key("m", F.lit(key))
        here = objects.where(has).select(by, "place", F.element_at("m", F.lit(key)).alias("found")).where("found is not null")
        hits = here if hits is None else hits.unionByName(here)
        deeper = objects.where(~has).select(by, "place", F.posexplode(F.arrays_zip(F.map_values("m").alias("raw"), "v")).alias("i", "c"))
        items = F.arrays_zip(F.from_json("raw", "array<string>").alias("raw"), F.from_json("raw", "array<variant>").alias("v"))
        deeper = deeper.unionByName(level.where("kind = 'A'").select(by, "place", F.posexplode(items).alias("i", "c")))
        deeper = deeper.select(by, F.array_append("place", F.col("i")).alias("place"), F.col("c.raw").alias("raw"), kind_of(F.col("c.v")).alias("kind"))
        depth += 1
        level = scratch.written(deeper.where(F.col("kind").isin("O", "A") & within), f"level-{depth}")
        if level.isEmpty():
            return hits.groupBy(by).agg(F.min_by("found", "place").alias("found"))


def article_bodies(pages: DataFrame, by: str = "page_id", html: str = "html", key: str = "articleData", body: str = "$.data.body", unclosed: bool = True) -> DataFrame:
    """by, text of pages whose JSON has a body below the key's first value: its text nodes, a line each; unclosed: see container_text."""
    blobs = pages.select(by, page_json(F.col(html)).alias("blob")).where(F.col("blob").contains(key))
    found = first_value(blobs, by, "blob", key).select(by, F.get_json_object("found", body).alias("body")).where("body <> ''")
    return found.select(by, udfs.container_text("article", unclosed)(F.concat(F.lit("<article>"), F.col("body"), F.lit("</article>"))).alias("text"))
