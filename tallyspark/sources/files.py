"""Readers and writers of the reference's file formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import stored

BOARD = "entry_date long, branch_name string, time double"
PULL = "number long, title string, draft boolean, labels array<struct<name:string>>, head struct<ref:string,repo:struct<clone_url:string>>"
LABEL_EVENT = "event string, label struct<name:string>, created_at string"
RESULT = "results array<struct<mean:double,min:double>>"


def visit_log(spark: SparkSession, path: str) -> DataFrame:
    """url, ts from headerless `url,timestamp` lines. The timestamp is a line's last 25 characters, so URLs may hold commas."""
    n = F.length("value")
    lines = spark.read.text(path).where(n > 26)
    return lines.select(F.expr("substring(value, 1, length(value) - 26)").alias("url"), F.expr("substring(value, length(value) - 24, 25)").alias("ts"))


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't `url,timestamp`."""
    return spark.read.text(path).where(~F.col("value").rlike(r".,\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[+-]\d\d:\d\d$"))


def board(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOARD).option("header", True).option("escape", "\\").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_board(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_file(lines: DataFrame, path: str, end: str = "") -> int:
    """Writes sorted lines to one local file, a partition at a time, and returns their number; the last one ends with `end`."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        for row in lines.toLocalIterator():
            f.write(f"\n{row[0]}" if n else row[0])
            n += 1
        f.write(end if n else "")
    return n


def write_matrix(rows: DataFrame, path: str) -> int:
    """A report as unquoted lines under a header of its columns' names."""
    text = F.concat_ws(",", *(F.col(f"`{c}`").cast("string") for c in rows.columns))
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(",".join(rows.columns) + "\n")
        n = 0
        for row in rows.select(text).toLocalIterator():
            f.write(row[0] + "\n")
            n += 1
    return n


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], seconds: float) -> DataFrame:
    """The rows stored under path if they are younger than so many seconds, else make()'s, which replace them."""
    try:
        age = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg((F.unix_timestamp() - F.unix_timestamp(F.max("modificationTime"))).alias("age")).first()[0]
    except AnalysisException:  # nothing there yet
        age = None
    if age is None or age >= seconds:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def page_scan(spark: SparkSession, fetch: Callable[[int], list[dict]], schema: str, abort: bool = False, strides: int = 8) -> DataFrame:
    """_page, _place, _end (null, "empty" or the error of a page that ends the scan) and the columns of every fetched row, in any order.
    Partition k of `strides` fetches pages k, k + strides, .. up to its first empty or failing page, so there is no limit of pages;
    pages beyond the scan's end are fetched by other partitions and are to be dropped (see pages)."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    kinds = spark.createDataFrame([], schema).schema
    names = [f.name for f in kinds.fields]

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in range(1, strides + 1)]

        def read(self, partition):
            number, none = partition.value, (None,) * len(names)
            while True:
                try:
                    got = fetch(number)
                except Exception as e:
                    if abort:
                        raise
                    yield (number, None, f"{type(e).__name__}: {e}", *none)
                    return
                if not got:
                    yield (number, None, "empty", *none)
                    return
                for place, row in enumerate(got):
                    yield (number, place, None, *(row.get(n) for n in names))
                number += strides

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "tally_pages"

        def schema(self):
            return f"_page long, _place int, _end string, {schema}"

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Pages)
    return spark.read.format("tally_pages").load()


def pages(spark: SparkSession, fetch: Callable[[int], list[dict]], schema: str, abort: bool = False, strides: int = 8) -> DataFrame:
    """Rows of the pages 1, 2, .. before the first empty one. A failing page ends the scan too, or aborts it."""
    all_ = stored(page_scan(spark, fetch, schema, abort, strides), "pages")
    end = all_.where("_end is not null").agg(F.min("_page")).first()[0]
    return all_.where((F.col("_page") < end) & F.col("_end").isNull()).drop("_page", "_place", "_end")
