"""Incremental daily visits and a leaderboard that is merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import url_path
from ..operators import board


def _started(stream: DataFrame, each, checkpoint: str, every: str | None):
    """Runs each batch once over what is there, or every so often. A source's offsets are acknowledged when the batch's folder is
    written; a batch that is repeated after a failure writes the same folder again."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_daily(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Counts each batch's visits by raw URL and day into a folder of its own under `path`: no state is kept, nothing is rewritten."""

    def count(batch: DataFrame, number: int) -> None:
        batch.groupBy("url", "day").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _started(stream, count, checkpoint, every)


def daily_result(spark: SparkSession, path: str) -> DataFrame:
    """The sums over all batches, as they are now."""
    return spark.read.parquet(path).groupBy("url", "day").agg(F.sum("n").alias("n")).groupBy(url_path(F.col("url")).alias("path"), "day").agg(F.sum("n").alias("visits"))


def run_board(stream: DataFrame, path: str, key: str, checkpoint: str, every: str | None = None):
    """Merges each batch into the board under `path`; versions are folders, so a repeated batch writes the same one."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        best = batch.where("secs is not null and secs <> 0").groupBy(key).agg(F.min("secs").alias("secs"), F.min("entry_ts").alias("entry_ts"))
        base = spark.read.parquet(f"{path}/version={number - 1}") if number else best.limit(0)
        board.merge(base, best, key).write.mode("overwrite").parquet(f"{path}/version={number}")

    return _started(stream, merge, checkpoint, every)


def last_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest version, found by Spark's own listing, so in any store."""
    all_ = spark.read.parquet(path)
    newest = all_.agg(F.max("version")).first()[0]
    return all_.where(F.col("version") == newest).drop("version")
