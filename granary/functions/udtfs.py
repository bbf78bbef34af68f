"""Table functions for SQL: segments of a text, and n-grams over the rows of a partition."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

BREAK = re.compile(r"\n(?:[ \t\x0b\f\r]*\n)+")


@udtf
class Segments:
    """segments(text): pos, text of what blank lines part; files.segments() as a table function."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, StringType):
            raise ValueError("segments() takes one text")
        return AnalyzeResult(StructType([StructField("pos", IntegerType()), StructField("text", StringType())]))

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text is not None:
            parts = (p.strip() for p in BREAK.split(text.replace("\r\n", "\n").replace("\r", "\n")))
            yield from enumerate(p for p in parts if p)


@udtf
class NGrams:
    """ngrams(n, TABLE(t) PARTITION BY key ORDER BY place): key, place of the last item, gram: the n last items of a table of
    key, place and item, for each row that has n - 1 before it in its partition. n items are held, however many rows.

    `n` gives the gram its length and is a constant.
    """

    def __init__(self) -> None:
        self.last: deque | None = None

    @staticmethod
    def analyze(n: AnalyzeArgument, rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) != 3:
            raise ValueError("ngrams() takes a table of a key, a place and an item")
        if not n.isConstantExpression or not isinstance(n.value, int) or n.value < 1:
            raise ValueError("ngrams() takes a constant length of 1 at least")
        key, place, item = rows.dataType.fields
        schema = StructType([key, place, StructField("gram", ArrayType(item.dataType))])
        return AnalyzeResult(schema)

    def eval(self, n: int, row) -> Iterator[tuple]:
        key, place, item = row
        if self.last is None:
            self.last = deque(maxlen=n)
        self.last.append(item)
        if len(self.last) == n:
            yield key, place, list(self.last)


def register(spark: SparkSession) -> None:
    """segments and ngrams for spark.sql()."""
    spark.udtf.register("segments", Segments)
    spark.udtf.register("ngrams", NGrams)
