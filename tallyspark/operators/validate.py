"""Comparison of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of one side only, counted, in one aggregation instead of two set differences."""
    cols = actual.columns
    both = actual.withColumn("_d", F.lit(1)).unionByName(expected.withColumn("_d", F.lit(-1)))
    left = both.groupBy(*cols).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    return left.select(*cols, F.when(F.col("_d") > 0, "actual_only").otherwise("expected_only").alias("side"))


def verdict(actual: str | None, expected: str) -> str:
    return "missing" if actual is None else "empty" if actual == "" else "ok" if actual == expected else "unequal"
