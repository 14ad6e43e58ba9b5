"""Shards by extendible hashing.

A row's address is 120 bits: 60 from its key, then 60 from the whole row, which only matter when one key alone exceeds the limit.
The directory starts at depth 0; only buckets over the byte limit split on another bit, until each fits or holds one row. Depths
are settled in rounds: one aggregation gives the sizes of all prefixes down to the round's depth, a cell's bucket is its
shortest prefix that fits, and just the rows of cells that still don't fit go on to the next round.

A directory of up to DIRECTORY cells is broadcast; beyond that rows are shuffled to their cells, and cells that hold many rows (one
key may hold a third of them) are split.

Defined results: null texts weigh 0 bytes; null keys are one key; equal rows differ in their last bits, so they can part; a row
over the limit is a shard of its own; an empty table has no shards and writes none; extra columns are ignored by the plan and kept
by the writer, whatever their names; a key named like a column of the plan is called key_ and that name there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored, table

LIMIT = 1 << 20
#: Cells in a directory that is broadcast: some 200 bytes each.
DIRECTORY = 100_000


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(d: Column) -> list[Column]:
    """The first d bits: 60 of h, then of h2."""
    return [F.expr("shiftright(h, 60 - least(d, 60))").alias("a"), F.expr("shiftright(h2, 60 - greatest(d - 60, 0))").alias("b")]


def _assigned(docs: DataFrame, limit: int, key: str, text: str, whole: bool) -> DataFrame:
    """row (of the whole document or of the key alone), bytes, shard (depth and prefix), depth, shard_bytes for every row."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*(docs.columns if whole else [key])).alias("row"), size.alias("bytes"), _bits(k).alias("h"), _bits(F.concat_ws("\x01", k, F.md5(F.coalesce(F.col(text), F.lit(""))), F.monotonically_increasing_id().cast("string"))).alias("h2"))
    rows = stored(rows, "shard-rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    first = min(40, max(2, math.ceil(math.log2(max(1, total / limit))) + 4))
    # rows that another round doesn't settle are few: the hash is even, unless one key exceeds the limit
    done, low = None, 0
    for high in [first, first + 6, 66, 72, 84, 102, 120]:
        if high <= low:
            continue
        at = rows.withColumn("d", F.lit(high))
        cells = at.select(*_prefix(F.col("d")), "bytes").groupBy("a", "b").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        cells = stored(cells.select(F.col("a").alias("cell_a"), F.col("b").alias("cell_b"), "bytes", "n"), "shard-cells")
        up = cells.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high)))).selectExpr(
            "d", "cell_a", "cell_b", "bytes", "n",
            f"shiftright(cell_a, {min(high, 60)} - least(d, 60)) as a", f"shiftright(cell_b, {max(high - 60, 0)} - greatest(d - 60, 0)) as b",
        )
        nodes = up.groupBy("d", "a", "b").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.lit(high == 120) & (F.col("d") == 120))
        nodes = stored(nodes.where(fits), "shard-nodes")  # so that both sides of the join come from shuffles, which Spark can split
        leaf = up.drop("bytes", "n").hint("merge").join(nodes, ["d", "a", "b"]).groupBy("cell_a", "cell_b").agg(F.min(F.struct("d", "a", "b", "shard_bytes")).alias("leaf"))
        named = F.concat_ws("-", "cell_a", "cell_b").alias("cell")
        leaf = stored(cells.select("cell_a", "cell_b").hint("merge").join(leaf, ["cell_a", "cell_b"], "left").select(named, "leaf"), "shard-directory")
        a, b = _prefix(F.col("d"))
        keyed = at.select("row", "bytes", "h", "h2", F.concat_ws("-", a, b).alias("cell"))
        small = leaf.count() <= DIRECTORY
        met = keyed.join(F.broadcast(leaf), "cell") if small else skew_join(stored(keyed, "shard-keyed"), leaf.hint("merge"), "cell")
        told = met.where(F.col("leaf").isNotNull()).select("row", "bytes", F.format_string("%d-%x-%x", "leaf.d", "leaf.a", "leaf.b").alias("shard"), F.col("leaf.d").alias("depth"), "leaf.shard_bytes")
        done = told if done is None else done.unionByName(told)
        if leaf.where("leaf is null").isEmpty():
            break
        rows, low = stored(met.where(F.col("leaf").isNull()).select("row", "bytes", "h", "h2"), "shard-rest"), high + 1
    return done


def plan(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bytes, shard (depth and prefix), depth, shard_bytes for every row."""
    name = f"key_{key}" if key in ("bytes", "shard", "depth", "shard_bytes") else key
    return _assigned(docs, limit, key, text, whole=False).select(F.col(f"row.`{key}`").alias(name), "bytes", "shard", "depth", "shard_bytes")


def write(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes every row of docs as Parquet, a folder shard=.. for each shard, and returns the shards with their depth, bytes and rows.
    A shard is written by one task, as it fits the limit unless one row exceeds it. Columns stay as they are in `row`."""
    told = stored(_assigned(docs, limit, key, text, whole=True), "shard-plan")
    told.repartition("shard").select("row", "shard").write.partitionBy("shard").mode("overwrite").parquet(path)
    return told.groupBy("shard", "depth").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
with r as (select doc_id, coalesce(strlen(text), 0)::bigint as bytes, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h from documents),
n as (select d, h >> (60 - d)::int as a, sum(bytes)::bigint as shard_bytes, count(*) as c from r, range(0, 41) t(d) group by d, h >> (60 - d)::int),
l as (select r.doc_id, r.bytes, n.d, n.a, n.shard_bytes, row_number() over (partition by r.doc_id order by n.d) as k
  from r join n on n.a = r.h >> (60 - n.d)::int where n.shard_bytes <= {LIMIT} or n.c = 1)
select doc_id, bytes, printf('%d-%x-0', d, a) as shard, d::int as depth, shard_bytes from l where k = 1
"""
