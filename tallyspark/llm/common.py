"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..store import shared_dir, stored  # noqa: F401

#: Rows in one Arrow batch: whole texts travel, so batches are kept short.
BATCH_ROWS = 500
#: A key is hot if it holds over 1/HOT_SHARE of the rows; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 200

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words in lower case; 0 for white space (0x20, 0x09 to 0x0D), which parts words.
IN_WORD = np.array([0 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint16)
IN_WORD[0] = 256
#: Bytes of text whose words are hashed together.
SLICE = 1 << 20
_random = np.random.default_rng(20240611)
_BYTE = _random.integers(0, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_power = np.ones(1, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Lowers the rows of the session's Arrow batches, for results that are computed after the operator has returned. A lower
    setting of the user's stays."""
    now = int(spark.conf.get(ARROW_ROWS))
    if not 0 < now <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))
    return spark


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of so many rows at most within the block; the session's setting is as before after it."""
    old = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield spark
    finally:
        spark.conf.set(ARROW_ROWS, old)


def apart(docs: DataFrame, names: set[str], *needed: str) -> tuple[DataFrame, bool]:
    """docs, or if some column has one of the names, its rows as `row` beside the needed columns."""
    if not names & {c.lower() for c in docs.columns}:
        return docs, False
    return docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), *needed), True


def trimmed() -> None:
    """Gives a worker's free memory back: workers stay for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, ends: np.ndarray, kinds: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another, and each text's number of words. A hash is a sum of the
    bytes' random values times powers of an odd factor, mixed with the length. kinds: each byte as it counts, 0 parts words."""
    global _power
    x = kinds[data]
    inside = x != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = ends[(ends > 0) & (ends < len(x))]  # words don't run on from text to text
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    sizes = stops - starts
    longest = int(sizes.max())
    while len(_power) < longest:
        _power = np.concatenate([_power, _power * (_power[-1:] * MIX)])
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    sums = np.add.reduceat(_BYTE[x[inside]] * _power[place], at)
    return mixed(mixed(sums + sizes.astype(np.uint64)) * MIX), counts


def hashed_words(texts: pa.Array, limit: int = SLICE, kinds: np.ndarray = IN_WORD) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of the texts with about `limit` bytes: first row, row after the last, word hashes, and the number of words of each
    text. Null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    a = 0
    while a < len(texts):
        e = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[a] : offsets[e]] if held is not None else np.empty(0, np.uint8)
        yield a, e, *word_hashes(data, offsets[a + 1 : e + 1] - offsets[a], kinds)
        a = e


def append(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """df with the given columns added, or replaced where df has columns of these names. make() runs once a task and
    returns a function from an Arrow batch to the new columns' values."""
    new = {f.name for f in fields}
    keep = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            made = f(b)
            cols = [b.column(c) for c in keep] + [x if isinstance(x := made[y.name], pa.Array) else pa.array(x, type=arrow.field(y.name).type) for y in fields]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(y.name for y in fields)])
        trimmed()

    return df.mapInArrow(run, schema)


def emit(df: DataFrame, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Rows made from df's Arrow batches: make()(batches) yields dicts of columns."""
    kinds = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches):
        for made in make()(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)
        trimmed()

    return df.mapInArrow(run, kinds)


def skew_join(facts: DataFrame, dims: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """facts joined to dims, which has one row a key. Rows of hot keys (over 1/HOT_SHARE of all facts each, so fewer than
    HOT_SHARE keys) meet a broadcast of at most HOT_SHARE rows of dims; the others are shuffled. facts is read three times:
    hand in a stored table."""
    sizes = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = facts.count()
    hot = sizes.where((F.col("_n") > max(1000, total // HOT_SHARE))).select(key).limit(HOT_SHARE)
    keys = [r[0] for r in hot.collect()]
    if not keys:
        return facts.join(dims, key, how)
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    some = F.broadcast(dims.where(is_hot))
    return facts.where(~is_hot).join(dims.where(~is_hot), key, how).unionByName(facts.where(is_hot).join(some, key, how))


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))
