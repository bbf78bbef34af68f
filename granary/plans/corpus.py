"""Corpus build: segments -> purity -> language -> first-wins dedup -> hash split -> accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..presets import Preset
from .lineage import Scratch


SALTS = 64  #: copies of a ledger's entry


def cleaned(segments: DataFrame, preset: Preset) -> DataFrame:
    """segments (source, pos, text) with clean, dropped_lines, tokens, early (impure, suspect or null) and fp.

    Text is cleaned once a row: the generator keeps Spark from repeating the expression wherever a column of it is
    used. A preset that wants NFC gets it first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = segments.select("*", F.inline(F.array(F.struct(udfs.cleaned(text, preset).alias("_c")))))
    rows = rows.select(*segments.columns, F.col("_c.text").alias("clean"), F.col("_c.dropped").alias("dropped_lines"))
    exempt = F.col("source").endswith(preset.exempt_suffix)
    early = F.when(F.col("clean") == "", "impure").when(~(exempt | T.likely_language(F.col("clean"), preset)), "suspect")
    rows = rows.withColumns({"tokens": T.rough_tokens(F.when(F.col("clean") == "", F.col("text")).otherwise(F.col("clean"))), "early": early})
    return rows.withColumn("fp", F.when(F.col("early").isNull(), T.fingerprint(F.col("clean"))))


def judged(segments: DataFrame, preset: Preset, order: tuple[str, ...] = ("source", "pos")) -> DataFrame:
    """segments (source, pos, text, ...) without their text, with dropped_lines, tokens, fp and disposition: impure,
    suspect, duplicate or kept.

    Each segment gets exactly one disposition, tested in this order. Of equal clean texts the first in `order` is
    kept. First wins by a minimum per fingerprint joined back, so that one very frequent text is combined
    before the shuffle rather than sorted in one task. Segments are read and cleaned once: what is joined back is a
    narrow table in the shared folder; kept_texts() fetches the texts.
    """
    rows = cleaned(segments, preset).drop("text", "clean")
    rows = Scratch(segments.sparkSession).written(rows, "cleaned")
    first = rows.where("fp is not null").groupBy("fp").agg(F.min(F.struct(*order)).alias("first"))
    rows = rows.join(first, "fp", "left")
    is_first = F.col("first") == F.struct(*order)
    return rows.withColumn("disposition", F.coalesce("early", F.when(is_first, "kept").otherwise("duplicate"))).drop("early", "first")


def kept_texts(segments: DataFrame, preset: Preset) -> DataFrame:
    """source, pos, clean, tokens, split of the kept segments."""
    kept = splits(judged(segments, preset).where("disposition = 'kept'")).select("source", "pos", "tokens", "split")
    return cleaned(segments, preset).select("source", "pos", "clean").join(kept, ["source", "pos"])


def splits(kept: DataFrame) -> DataFrame:
    """Rows of judged() with their split, which the text's fingerprint decides."""
    return kept.withColumn("split", T.split_name(T.bucket_of(F.col("fp"))))


def split_report(kept: DataFrame) -> DataFrame:
    """Documents, tokens and their shares for each split, and `all`."""
    got = splits(kept).rollup("split").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    whole = F.sum(F.when(F.col("split").isNotNull(), F.col("tokens"))).over(Window.partitionBy())
    return got.select(
        F.coalesce("split", F.lit("all")).alias("split"), "documents", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.coalesce(100 * F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)), 6).alias("percent"),
    )


def registered(segments: DataFrame, registry: DataFrame, tiered: str, tier: str = "unverified") -> DataFrame:
    """segments (source, path, ...) of registered sources, with bucket and source_rank of the registry (source, bucket,
    source_rank), a short list of folders, and whether the segment is of the unverified tier: of the source `tiered`,
    in a file that the tier names."""
    name = F.element_at(F.split("path", "/"), -1)
    return segments.join(F.broadcast(registry), "source").withColumn(tier, (F.col("source") == tiered) & name.contains(tier))


def registry_accounting(rows: DataFrame, tier: str = "unverified") -> DataFrame:
    """accounting() with the files scanned and the kept tokens of the unverified tier."""
    more = rows.groupBy("bucket").agg(F.countDistinct("path").alias("files_scanned"), F.coalesce(F.sum(F.when(F.col(tier) & (F.col("disposition") == "kept"), F.col("tokens"))), F.lit(0)).alias(f"{tier}_tokens"))
    return accounting(rows).join(more, "bucket")


def accounting(rows: DataFrame, by: str = "bucket") -> DataFrame:
    """Segments and tokens of each disposition, by bucket."""
    made = [f(F.col("disposition") == d).alias(f"{d}_segments") for d in ("impure", "suspect", "duplicate", "kept") for f in (F.count_if,)]
    made += [F.coalesce(F.sum(F.when(F.col("disposition") == d, F.col("tokens"))), F.lit(0)).alias(f"{d}_tokens") for d in ("impure", "suspect", "duplicate", "kept")]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("scanned"), *made)


def quota(account: DataFrame, target: int, fertility: float) -> DataFrame:
    """From accounting() by bucket: manual share, share of the target, whether hand-collected text makes a fifth of it."""
    total = account.agg(F.sum("kept_tokens").alias("tokens"), F.coalesce(F.sum(F.when(F.col("bucket") == "manual", F.col("kept_tokens"))), F.lit(0)).alias("manual"))
    return total.select(
        "tokens", "manual", F.round(100 * F.col("manual") / F.nullif("tokens", F.lit(0)), 6).alias("manual_percent"),
        F.round(100 * F.col("tokens") / target, 6).alias("target_percent"), (F.col("manual") >= target // 5).alias("quota_met"),
        F.bround(F.col("tokens") * fertility).cast("bigint").alias("estimated_tokens"),
    )


def page_texts(pages: DataFrame, ledger: DataFrame, preset: Preset, least: float = 0.3) -> DataFrame:
    """file, page, used_ocr, raw, clean of the pages (file, page, layer, ocr) that the ledger (file, last_page) doesn't have yet:
    each page's own text layer, or what was recognised on it where the layer is hardly in the script; with letters
    corrected, as it is and cleaned. A page is a row, and meets its file's entry in one of SALTS places, so that a file which
    holds most pages spreads over tasks."""
    entries = ledger.select("file", "last_page", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    left = pages.withColumn("_salt", F.pmod(F.col("page"), F.lit(SALTS)).cast("int")).join(entries, ["file", "_salt"], "left").where(F.col("page") > F.coalesce("last_page", F.lit(0)))
    chosen = T.layer_or_ocr(F.col("layer"), F.coalesce("ocr", F.lit("")), preset, least)
    got = left.select("file", "page", chosen.alias("c")).select("file", "page", "c.used_ocr", T.corrected(F.coalesce("c.text", F.lit("")), preset).alias("raw"))
    return got.withColumn("clean", udfs.cleaned(F.col("raw"), preset)["text"])


def page_ledger(ledger: DataFrame, read: DataFrame) -> DataFrame:
    """The ledger (file, last_page, ocr_pages, text_pages) after pages were read: file, page, used_ocr."""
    new = read.groupBy("file").agg(F.max("page").alias("last_page"), F.count_if("used_ocr").alias("ocr_pages"), F.count_if(~F.col("used_ocr")).alias("text_pages"))
    old = ledger.select(*new.columns)
    return old.unionByName(new).groupBy("file").agg(F.max("last_page").alias("last_page"), F.sum("ocr_pages").alias("ocr_pages"), F.sum("text_pages").alias("text_pages"))
