"""The few functions that Spark lacks, as UDFs over Arrow batches."""

from __future__ import annotations

import hashlib
import html
import json
import re
import unicodedata
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from ..presets import Preset
from . import text, wikitext


def pieces(values: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of at most `most` bytes of strings, or items of lists, but of one value at least: what is a Python object at a time."""
    size = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
    ends, start = np.cumsum(pc.fill_null(size(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(values):
        upto = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield values.slice(start, upto - start)
        start = upto


def by_pieces(values: pa.Array, f, kind: pa.DataType, most: int = 1 << 20) -> pa.Array:
    """f of each piece (to an Arrow array, or a list of values of that kind), put together: a batch is held as Arrow alone."""
    return pa.concat_arrays([pa.array([], kind), *(pa.array(f(p), kind) for p in pieces(values, most))])


def _each(kind: str):
    """An Arrow UDF of a function of one string; null stays null."""
    spark_kind, arrow_kind = {"string": (StringType(), pa.string()), "long": (LongType(), pa.int64())}[kind]

    def wrap(f):
        @F.arrow_udf(spark_kind)
        def run(s: pa.Array) -> pa.Array:
            return by_pieces(s, lambda p: [None if x is None else f(x) for x in p.to_pylist()], arrow_kind)

        return run

    return wrap


nfc = _each("string")(lambda t: unicodedata.normalize("NFC", t))
unescape = _each("string")(html.unescape)
wiki_prose = _each("string")(wikitext.prose)
wiki_strip = _each("string")(wikitext.stripped)
percent_encoded = _each("string")(lambda u: quote(u, safe=":/?=&"))
blake2b_128 = _each("string")(lambda t: hashlib.blake2b(t.encode(), digest_size=16).hexdigest())
blake2b_bucket = _each("long")(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % 100)
decode_ignoring = _each("string")(lambda b: bytes(b).decode("utf-8", "ignore"))
decode_replacing = _each("string")(lambda b: bytes(b).decode("utf-8", "replace"))


def cleaned(t: Column, preset: Preset) -> Column:
    """functions.text.clean as one operation: a preset that wants NFC gets it first."""
    return text.clean(nfc(t) if preset.nfc else t, preset)


class _Container(HTMLParser):
    """Text nodes of the first element that a simple selector (tag, .class, #id, tag.class) fits."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    HIDDEN = {"script", "style"}

    def __init__(self, selector: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.mark, self.name = selector.partition("#") if "#" in selector else selector.partition(".")
        self.open: list[str] = []
        self.done, self.hidden, self.found = False, 0, False
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.done or tag in self.VOID:
            return
        if self.open:
            self.open.append(tag)
            self.hidden += tag in self.HIDDEN
        else:
            a = dict(attrs)
            given = {"": True, ".": self.name in (a.get("class") or "").split(), "#": a.get("id") == self.name}[self.mark]
            if (not self.tag or tag == self.tag) and given:
                self.open, self.found = [tag], True

    def handle_endtag(self, tag):
        if self.open and tag in self.open:
            while self.open:
                last = self.open.pop()
                self.hidden -= last in self.HIDDEN
                if last == tag:
                    break
            self.done = not self.open

    def handle_data(self, data):
        if self.open and not self.hidden and not self.done and (t := data.strip()):
            self.parts.append(t)


def unclosed_kept(page: str) -> str:
    """A page whose references without a semicolon (`&amp` where a title was cut) or of unknown names are plain text."""
    named = lambda m: m[0] if m[1] and (m[1][0] == "#" or f"{m[1]};" in html5) else f"&amp;{m[0][1:]}"
    return re.sub(r"&(?:(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)?", named, page)


def container_text(selector: str = "article", unclosed: bool = True):
    """UDF: stripped text nodes of the container, a line each; null where the page has no such container. unclosed: references
    without a semicolon count, as in browsers; else they stay as they are."""

    def read(page: str) -> str | None:
        p = _Container(selector)
        p.feed(page if unclosed else unclosed_kept(page))
        return "\n".join(p.parts) if p.found else None

    return _each("string")(read)


def find_key(key: str = "articleData"):
    """UDF on JSON text: the first value of a key in depth-first order, as JSON; null without it or on bad JSON."""

    def first(x):
        if isinstance(x, dict):
            if key in x:
                return x[key]
            x = x.values()
        elif not isinstance(x, list):
            return None
        return next((got for v in x if (got := first(v)) is not None), None)

    def run(t: str) -> str | None:
        try:
            got = first(json.loads(t))
        except ValueError:
            return None
        return None if got is None else json.dumps(got, ensure_ascii=False)

    return _each("string")(run)


def common_length(x, y) -> int:
    """Length of the longest common subsequence: a row of the table is one number, whose zeros are its steps up."""
    where: dict = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | 1 << i
    whole = (1 << len(x)) - 1
    row = whole
    for w in y:
        if (at := where.get(w)) is not None:
            met = row & at
            row = ((row + met) | (row - met)) & whole
    return len(x) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two word arrays; 0 where either is empty."""
    some = lambda x, y: x is not None and y is not None and len(x) and len(y)
    return pd.Series([2 * common_length(x, y) / (len(x) + len(y)) if some(x, y) else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)
