"""Leaderboards: keyed merge, collapse, ranking and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import board_line, plain_number
from ..store import stored


def merge(base: DataFrame, new: DataFrame, key: str, entry: str = "entry_ts", secs: str = "secs", seq: str | None = None) -> DataFrame:
    """An upsert: better times replace old ones, which keep their entry time; unknown keys are added; null and zero results
    are ignored. A union and one aggregation, so the data move once. seq: a column of base by which the last row of each key
    counts, if keys may repeat there."""
    if seq:
        last = base.groupBy(key).agg(F.max_by(F.struct(entry, secs), seq).alias("_last"))
        base = last.select(key, F.col(f"_last.{entry}").alias(entry), F.col(f"_last.{secs}").alias(secs))
    good = new.where(f"{secs} is not null and {secs} <> 0")
    both = base.select(key, entry, secs, F.lit(0).alias("_new")).unionByName(good.select(key, entry, secs, F.lit(1).alias("_new")))
    # the base's row decides the entry time
    return both.groupBy(key).agg(F.min(F.struct("_new", entry))[entry].alias(entry), F.min(secs).alias(secs))


def new_entries(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(base, key, "left_anti")


def collapse(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The last row of each key wins."""
    return rows.groupBy(key).agg(F.max_by(value, seq).alias("secs"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rnk over a whole board, which has a row a contestant. Ranks come from a range-partitioned sort, which is stored once, and the
    partitions' counts, not from one task with all rows."""
    parts = stored(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranked")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return parts.join(F.broadcast(before), "_p").select((F.col("_b") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rnk"), *rows.columns)


def text(rows: DataFrame, key: str, secs: str = "secs") -> DataFrame:
    return rows.select(board_line(F.col(key), F.format_string("%.2f", F.col(secs))).alias("line"))


def with_header(lines: DataFrame, header: str) -> DataFrame:
    """part, line: the header in part 0, the lines in part 1."""
    return lines.sparkSession.createDataFrame([(0, header)], "part int, line string").unionByName(lines.select(F.lit(1).alias("part"), "line"))


def report(rows: DataFrame, entry: str = "entry_date", name: str = "branch_name", secs: str = "time") -> DataFrame:
    """line: the board's file, ascending by time under its header; equal times by entry and name."""
    lines = rows.select(secs, entry, name, board_line(F.col(entry), F.col(name), plain_number(F.col(secs))).alias("line"))
    head = with_header(lines.limit(0), f"{entry},{name},{secs}")
    return head.unionByName(lines.withColumn("part", F.lit(1)), allowMissingColumns=True).orderBy("part", secs, entry, name).select("line")
