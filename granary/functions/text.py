"""Text functions as Column expressions, all within code generation or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..presets import Preset

#: Line separators that Java's \R leaves out are added.
ANY_LINE = r"\R|[\x1c-\x1e]"
#: What str.strip() takes for white space.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = r"(?U)[^\s\x1c-\x1f]+"


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it, also in lambdas that run for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(t: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(t, F.lit(WHITE))


def count_of(t: Column, characters: str) -> Column:
    """How many characters of t are in a class; they go in runs, which are fewer than the characters. A negated class of several
    ranges would take Java ten times as long."""
    return bound(t, lambda x: F.length(x) - F.length(F.regexp_replace(x, f"[{characters}]+", "")))


def rough_tokens(t: Column) -> Column:
    """Runs of non-white characters; 0 of null."""
    return F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0))


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(f"({WORD})"), 1)


# What international tokenisation parts from the words around it.
INTERNATIONAL = ((r"(\P{N})(\p{P})", "$1 $2 "), (r"(\p{P})(\P{N})", " $1 $2"), (r"(\p{S})", " $1 "))


def international_words(t: Column) -> Column:
    """Words with punctuation and symbols parted off, but for marks within numbers."""
    for pattern, to in INTERNATIONAL:
        t = F.regexp_replace(t, pattern, to)
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def script_ratio(t: Column, preset: Preset) -> Column:
    """Letters of the script over all letters; 0.0 without letters or text. Combining marks count on neither side."""
    inside = count_of(t, f"[{preset.letters}&&[{preset.script}]]")
    return F.coalesce(inside / F.nullif(count_of(t, preset.letters), F.lit(0)), F.lit(0.0))


def lines_of(t: Column, preset: Preset) -> Column:
    return F.transform(F.split(t, ANY_LINE), strip) if preset.split_all_lines else F.split(t, "\n")


def clean(t: Column, preset: Preset) -> Column:
    """struct(text, dropped): the lines that are in the script, and how many non-blank ones aren't.

    A preset that wants NFC expects `t` to be normalised already; functions.udfs.cleaned does both.
    """
    blank = (lambda x: x == "") if preset.split_all_lines else (lambda x: strip(x) == "")  # lines are stripped already, or not
    full = F.filter(lines_of(t, preset), lambda x: ~blank(x))
    kept = lambda a: F.filter(a, lambda x: script_ratio(x, preset) >= preset.min_ratio)
    both = lambda a, k: F.struct(F.array_join(k, "\n").alias("text"), (F.size(a) - F.size(k)).alias("dropped"))
    return bound(full, lambda a: bound(kept(a), lambda k: both(a, k)))


def token_lines(cleaned: Column) -> Column:
    """Lines of clean() for a tokenizer: stripped, none empty."""
    return F.filter(F.transform(F.split(cleaned["text"], "\n"), strip), lambda x: x != "")


def layer_or_ocr(layer: Column, ocr: Column, preset: Preset, least: float = 0.3) -> Column:
    """struct(text, used_ocr): a file's text layer, or the recognised text where the layer is hardly in the script."""
    poor = script_ratio(F.coalesce(layer, F.lit("")), preset) < least
    return F.struct(F.when(poor, ocr).otherwise(layer).alias("text"), poor.alias("used_ocr"))


def likely_language(t: Column, preset: Preset) -> Column:
    """Markers among all characters of the block are frequent enough, or the block has too few to tell."""
    if not preset.markers:
        return F.lit(True)
    m = F.regexp_count(t, F.lit(f"[{preset.markers}]"))
    return bound(count_of(t, preset.script), lambda n: (n < preset.min_block_chars) | (m / F.nullif(n, F.lit(0)) >= preset.min_marker_ratio))


def corrected(t: Column, preset: Preset) -> Column:
    for a, b in preset.replacements.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


# Letters that become several in upper case, and what stands for them alone: themselves, if nothing does.
_SEVERAL = [c for c in map(chr, range(0xFB20)) if len(c.upper()) > 1 and not 0xD800 <= ord(c) < 0xE000]
_ALONE = ["\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL]


def upper_by_letter(t: Column) -> Column:
    """Upper case of as many characters; only texts with a letter that would become several are read one by one."""
    kept = lambda c: F.translate(c, "".join(_SEVERAL), "".join(_ALONE))
    each = F.transform(F.split(t, ""), lambda c: F.when(F.length(F.upper(c)) > 1, kept(c)).otherwise(F.upper(c)))
    return F.when(t.rlike(f"[{''.join(_SEVERAL)}]"), F.array_join(each, "")).otherwise(F.upper(t))


def fingerprint(t: Column) -> Column:
    return F.sha2(t.cast("binary"), 256)


def bucket(t: Column, buckets: int = 100) -> Column:
    """A stable number below `buckets`, the same wherever and whenever the text is seen."""
    return bucket_of(fingerprint(t), buckets)


def bucket_of(fp: Column, buckets: int = 100) -> Column:
    """The bucket of a text with this fingerprint."""
    return F.conv(F.substring(fp, 1, 15), 16, 10).cast("bigint") % buckets


def split_name(b: Column, train: int = 98, val: int = 99) -> Column:
    return F.when(b < train, "train").when(b < val, "val").otherwise("test")


def collapse_repeats(t: Column) -> Column:
    """A word that stands three or more times in a row is left once."""
    return F.regexp_replace(t, r"(\S+)(?:\s+\1){2,}", "$1")


def caption_text(t: Column) -> Column:
    """Text of WebVTT captions: no headers, cue times and tags; a line equal to the one before it is left out."""
    body = F.filter(F.split(t, ANY_LINE), lambda x: ~x.rlike("^(WEBVTT|Kind:|Language:)") & ~x.contains("-->"))
    plain = F.filter(F.transform(body, lambda x: strip(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")
    return F.array_join(bound(plain, lambda lines: F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1)))), "\n")


def slug(t: Column, most: int = 60) -> Column:
    """Other than letters and digits becomes one _, none at the ends, lower case, then cut."""
    plain = F.regexp_replace(F.regexp_replace(t, "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    return F.substring(F.lower(plain), 1, most)


def hashed_slug(url: Column, most: int = 60) -> Column:
    """A slug that tells apart urls of equal slugs."""
    return F.concat(slug(url, most), F.lit("_"), F.substring(F.sha2(url.cast("binary"), 256), 1, 8))


def path_slug(url: Column, most: int = 40) -> Column:
    """Third part from the end, then the file's name cut short."""
    parts = F.split(F.url_decode(url), "/")
    return F.concat(F.try_element_at(parts, F.lit(-3)), F.lit("_"), F.substring(F.try_element_at(parts, F.lit(-1)), 1, most))


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def dictionary_prose(entries: Column) -> Column:
    """`word: meaning; meaning` a line, from array<struct<word, meanings array<struct<text>>>>; empty ones left out."""
    lines = F.transform(entries, lambda e: F.struct(e["word"].alias("w"), F.filter(F.transform(e["meanings"], lambda m: strip(m["text"])), lambda m: m != "").alias("m")))
    full = F.filter(lines, lambda e: (F.coalesce(e["w"], F.lit("")) != "") & (F.size(e["m"]) > 0))
    return F.array_join(F.transform(full, lambda e: F.concat(e["w"], F.lit(": "), F.array_join(e["m"], "; "))), "\n")


def is_redirect(t: Column) -> Column:
    return strip(t).rlike("(?i)^#REDIRECT")


def number(n: Column) -> Column:
    return F.format_number(n, 0)
