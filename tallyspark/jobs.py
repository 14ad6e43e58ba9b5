"""Whole jobs, file in and file out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import difflog, records, visits
from .sources import files, generate


def parse(spark: SparkSession, log: str, target: str) -> int:
    """Counts a visit log's pages by day and writes the document to a local file; returns its number of paths."""
    lines = files.write_file(visits.document_lines(visits.of_lines(spark.read.text(log))), target)
    return max(0, lines - 2)


def generate_log(spark: SparkSession, uris: DataFrame, rows: int | str, target: str, seed: int = 1772177204) -> None:
    """Writes a seeded visit log to a folder."""
    files.write_lines(generate.lines(generate.visits(spark, uris, rows, seed)), target)


def history(spark: SparkSession, log: DataFrame, diffs: DataFrame, matrix: str, finalists: str, since: str | None = None, excluded: tuple[str, ...] = ()) -> int:
    """From commits and their diffs to the files of the finalists and of their history; returns the number of finalists. Without any
    run nothing is written."""
    from .store import stored

    rows = stored(difflog.ingest(log, diffs, since), "runs")
    if rows.isEmpty():
        return 0
    chosen = stored(records.finalists(records.entrants(rows, excluded, seq="line_no")), "finalists")
    days = records.history_days(rows, chosen, day=rows["ts"], names=[r["rnk"] for r in chosen.select("rnk").orderBy("rnk").collect()])
    files.write_matrix(records.history_report(days, chosen), matrix)
    return files.write_matrix(records.finalists_report(chosen), finalists)
