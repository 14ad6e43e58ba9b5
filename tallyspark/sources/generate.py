"""Seeded visit logs whose rows don't depend on partitioning."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import stored

POOL, SECONDS = 10_000, 5 * 365 * 86_400
#: Dimensions of at most so many URIs are broadcast.
SMALL = 100_000


def numbered(uris: DataFrame) -> DataFrame:
    """k, url: every URI with its place, from 0, in the order of the names. Stored, so that places don't change."""
    name = uris.columns[0]
    parts = stored(uris.select(F.col(name).alias("url")).orderBy("url").select("url", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "uris")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return stored(parts.join(F.broadcast(before), "_p").select((F.col("_b") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))).alias("k"), "url"), "uris")


def visits(spark: SparkSession, uris: DataFrame, rows: int | str = 1_000_000, seed: int = 1772177204, partitions: int | None = None) -> DataFrame:
    """url, ts: every row draws a URI of `uris` (a page dimension of any size, one column) and one of POOL timestamps of the five
    years before the seed. A seed of 0 is the present time."""
    n = int(str(rows).replace(",", "").replace("_", ""))
    now = seed or int(time.time())
    dimension = numbered(uris)
    size = dimension.count()
    if not size:
        raise ValueError("no URI to draw from")
    pick = lambda stream, of, among: F.pmod(F.xxhash64(F.lit(now), F.lit(stream), of), F.lit(among))
    stamp = F.lit(now) - pick(3, pick(2, F.col("id"), POOL), SECONDS + 1)
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    if size <= 1000:
        names = [r[0] for r in dimension.orderBy("k").select("url").collect()]
        url = F.element_at(F.array(*(F.lit(x) for x in names)), (pick(1, F.col("id"), size) + 1).cast("int"))
        return ids.select(url.alias("url"), F.date_format(F.timestamp_seconds(stamp), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("ts"))
    drawn = ids.select(pick(1, F.col("id"), size).alias("k"), F.date_format(F.timestamp_seconds(stamp), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("ts"))
    return drawn.join(F.broadcast(dimension) if size <= SMALL else dimension, "k").select("url", "ts")


def lines(log: DataFrame) -> DataFrame:
    return log.select(F.concat_ws(",", "url", "ts").alias("value"))
