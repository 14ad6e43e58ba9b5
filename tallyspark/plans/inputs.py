"""The driver's tables as logical inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type, url, ts, day: every event is a visit of the page event_id % count(pages)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = pages.count()
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", (F.col("event_id") % n).alias("page_id"))
    return events.join(pages, "page_id").select("event_id", "event_type", "url", "ts", F.to_date("ts").alias("day"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", "ts", F.col("user_id").cast("string").alias("branch"), F.col("value").alias("secs"))


def boards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A base board and new results: the best click and the best view of every user on every day, who is a contestant. Each has
    contestants that the other lacks."""
    who = F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("contestant")
    best = table(spark, sf_dir, "events").select(who, "event_type", "value", "ts")
    of = lambda kind: best.where(F.col("event_type") == kind).groupBy("contestant").agg(F.min("value").alias("secs"), F.min("ts").alias("first_ts"))
    return of("click"), of("view")
