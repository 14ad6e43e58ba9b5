"""Change logs: commits with a date and a diff, and the board rows that they add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import instant, lenient_number


def commits(log: DataFrame, since: str | None = None, line: str = "line") -> DataFrame:
    """hash, committed_at from `hash|date` lines. Blank lines go; a date may hold the sign; commits before `since` go."""
    text = F.trim(line)
    cut = log.where((text != "") & F.contains(text, F.lit("|"))).select(F.substring_index(text, "|", 1).alias("hash"), instant(F.expr(f"substring(trim({line}), instr(trim({line}), '|') + 1)")).alias("committed_at"))
    return cut.where(F.col("committed_at") >= instant(F.lit(since))) if since else cut


def exploded(changes: DataFrame, diff: str = "diff_text") -> DataFrame:
    """A row a line, numbered within its commit; null and empty diffs have none."""
    return changes.where(F.length(diff) > 0).select(*[c for c in changes.columns if c != diff], F.posexplode(F.split(diff, "\n")).alias("line_no", "line"))


def added_rows(diffs: DataFrame, line: str = "line") -> DataFrame:
    """The other columns with branch and secs of each added line: semicolons count as commas; blank, header and short lines go; a time
    that doesn't begin with a number is 0."""
    body = F.replace(F.substr(F.col(line), F.lit(2)), F.lit(";"), F.lit(","))
    text = diffs.where(F.col(line).startswith("+") & ~F.col(line).startswith("+++")).withColumn("_body", body)
    parts = text.where((F.col("_body") != "") & (F.col("_body") != "0") & ~F.col("_body").startswith("entry_date,")).withColumn("_parts", F.split("_body", ","))
    other = [c for c in diffs.columns if c != line]
    return parts.where(F.size("_parts") >= 3).select(*other, F.col("_parts")[1].alias("branch"), lenient_number(F.col("_parts")[2]).alias("secs"))


def ingest(log: DataFrame, diffs: DataFrame, since: str | None = None) -> DataFrame:
    """branch, secs, ts (the commit's time), hash, line_no of every row that the log's commits add. diffs: hash, diff_text."""
    met = commits(log, since).join(diffs, "hash")
    return added_rows(exploded(met)).select("branch", "secs", F.col("committed_at").alias("ts"), "hash", "line_no")
