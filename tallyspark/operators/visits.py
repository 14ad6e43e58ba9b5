"""Visits per path and day, tidy, nested and as a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import day_of, json_text, url_path
from ..store import stored


def daily(visits: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """path, day, visits. Raw URLs are counted first, so the path is extracted once a URL and day, not once a visit, and the
    second aggregation sees groups only."""
    raw = visits.groupBy(F.col(url).alias("url"), F.col(day).alias("day")).agg(F.count("*").alias("n"))
    return raw.groupBy(url_path(F.col("url")).alias("path"), "day").agg(F.sum("n").alias("visits"))


def of_log(log: DataFrame) -> DataFrame:
    """Daily visits of a log with url and ts texts; days stay texts."""
    return daily(log.select("url", day_of(F.col("ts")).alias("day")))


def of_lines(lines: DataFrame) -> DataFrame:
    """Daily visits of `url,timestamp` lines (one column, timestamps of 25 characters). What stands before the time of day is counted
    as bytes first: one short key a line, cut without a look at its characters. The counts are then dealt out by path, so that
    neither the second sum nor gathering a path's days moves them again; a path has at most a row for each of its URLs and days."""
    value = F.col(lines.columns[0])
    cut = lambda at, size: F.expr(f"cast(substring(k, {at}, {size}) as string)")
    keys = lines.where(F.octet_length(value) > 26).select(F.expr(f"substring(cast(`{lines.columns[0]}` as binary), 1, octet_length(`{lines.columns[0]}`) - 15)").alias("k"))
    raw = keys.groupBy("k").agg(F.count("*").alias("n")).select(url_path(cut(1, "octet_length(k) - 11")).alias("path"), cut("octet_length(k) - 9", 10).alias("day"), "n")
    return raw.repartition("path").groupBy("path", "day").agg(F.sum("n").alias("visits"))


def entries(report: DataFrame) -> DataFrame:
    """path, entries: an array of (day, n) ascending by day. A path has at most one entry a day."""
    return report.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("day").cast("string").alias("day"), F.col("visits").alias("n")))).alias("entries"))


def nested(report: DataFrame) -> DataFrame:
    """path, doc: the days and counts as compact JSON."""
    return entries(report).select("path", F.to_json(F.map_from_entries("entries")).alias("doc"))


def blocks(report: DataFrame) -> DataFrame:
    """path, block: a path's part of the document, four spaces to a level."""
    lines = F.transform("entries", lambda x: F.concat(F.lit('        "'), x["day"], F.lit('": '), x["n"].cast("string")))
    return entries(report).select("path", F.concat(F.lit('    "'), json_text(F.col("path")), F.lit('": {\n'), F.array_join(lines, ",\n"), F.lit("\n    }")).alias("block"))


def first_seen(visits: DataFrame, position: str) -> DataFrame:
    """path, seen: the first position of each path."""
    return visits.groupBy(url_path(F.col("url")).alias("path")).agg(F.min(position).alias("seen"))


def document(report: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """doc: the whole report as one text; paths in the order of `order` (path, seen), else of their names. A report has a block
    for each page, so one row holds it."""
    rows = blocks(report)
    rows = rows.join(order, "path").select("seen", "path", "block") if order is not None else rows.select(F.lit(0).alias("seen"), "path", "block")
    one = rows.agg(F.array_sort(F.collect_list(F.struct("seen", "path", "block"))).alias("b"))
    return one.select(F.when(F.size("b") == 0, F.lit("[]")).otherwise(F.concat(F.lit("{\n"), F.array_join(F.transform("b", lambda x: x["block"]), ",\n"), F.lit("\n}"))).alias("doc"))


def document_lines(report: DataFrame) -> DataFrame:
    """line: the document as sorted texts, without gathering it in a row: a bracket, a text for each path, a bracket."""
    rows = stored(blocks(report), "blocks")
    last = rows.agg(F.max("path")).first()[0]
    lines = rows.select(F.lit(1).alias("part"), "path", F.when(F.col("path") == F.lit(last), F.col("block")).otherwise(F.concat("block", F.lit(","))).alias("line"))
    ends = report.sparkSession.createDataFrame([(0, "", "[]")] if last is None else [(0, "", "{"), (2, "", "}")], "part int, path string, line string")
    return lines.unionByName(ends).orderBy("part", "path").select("line")
