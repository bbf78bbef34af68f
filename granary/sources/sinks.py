"""Tables written for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written too, so that every line has every field."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A metric report: one nested JSON object in one file. rows: one row of a few numbers."""
    rows.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Rows added to a CSV log; each file has its header, which files.loss_log skips."""
    rows.write.mode("append").csv(path, header=True)


def append_log(lines: DataFrame, path: str) -> None:
    """`- [time] message` lines added to a log. lines: at, message."""
    stamped = F.concat(F.lit("- ["), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.col("message"))
    lines.select(stamped.alias("value")).write.mode("append").text(path)
