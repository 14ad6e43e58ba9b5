"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector component is a term. For every term the block's postings (rows with a non-zero weight) are scattered, weighted by the
sparse query rows, into dense score arrays; each task selects its best k a query by partition, and a window merges the tasks'
selections. Queries travel in blocks of at most `block` rows, so what is broadcast is bounded; every further block is another
pass over the candidates whose result is stored.

Defined results: vectors that are null or hold null or non-finite components take no part; missing components of shorter
vectors weigh 0; ties go to the smaller id; rows that share a query's id are its own; repeated query rows are answered one by
one; fewer than k candidates are all returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import emit, stored, table

SCALE, K, BLOCK, STRIP, ROWS = 256, 5, 8192, 128, 4096


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    whole = F.col(vector).isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("v"))


def dense(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), dtype=np.int64)
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all rows for the queries, term at a time."""
    scores = np.zeros((len(queries), len(rows)), dtype=np.int64)
    for term in range(min(queries.shape[1], rows.shape[1])):
        posting = np.flatnonzero(rows[:, term])
        asked = np.flatnonzero(queries[:, term])
        if not len(posting) or not len(asked):
            continue
        weights = rows[posting, term]
        if len(posting) == len(rows) and len(asked) == len(queries):
            scores += queries[:, term, None] * weights
        else:
            scores[np.ix_(asked, posting)] += queries[asked, term, None] * weights
    return scores


def search(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row where is_query holds. Scores are inner products of
    floor(scale * x)."""
    rows = quantised(vectors, vec_id, vector, scale)
    asked = quantised(vectors.where(is_query), vec_id, vector, scale)
    sc, done, waiting = vectors.sparkSession.sparkContext, [], []

    def answer(lot: list) -> DataFrame:
        width = max(len(v) for _, v in lot)
        asks = sc.broadcast((np.array([q for q, _ in lot], dtype=np.int64), dense([v for _, v in lot], width)))

        def make():
            def run(batches):
                qids, q = asks.value
                kept_id, kept_s = [np.empty(0, np.int64)] * len(qids), [np.empty(0, np.int64)] * len(qids)
                for ids, some in _gathered(batches, q.shape[1]):
                    for at in range(0, len(qids), STRIP):
                        scores = accumulate(q[at : at + STRIP], some)
                        for j, s in enumerate(scores, at):
                            other = ids != qids[j]
                            i, s = (ids, s) if other.all() else (ids[other], s[other])
                            b = best(s, i, k)
                            i, s = np.concatenate([kept_id[j], i[b]]), np.concatenate([kept_s[j], s[b]])
                            b = best(s, i, k)
                            kept_id[j], kept_s[j] = i[b], s[b]
                n = [len(x) for x in kept_id]
                yield {"q": np.repeat(np.arange(len(qids)), n), "query_id": np.repeat(qids, n), "vec_id": np.concatenate(kept_id), "score": np.concatenate(kept_s)}

            return run

        found = emit(rows, "q int, query_id long, vec_id long, score long", make)
        w = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    for r in asked.toLocalIterator():
        waiting.append((r["vec_id"], list(r["v"])))
        if len(waiting) == block:
            done.append(stored(answer(waiting), "topk"))
            waiting = []
    if waiting:
        done.append(answer(waiting) if not done else stored(answer(waiting), "topk"))
    if not done:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _gathered(batches, width: int):
    """Blocks of up to ROWS candidates."""
    ids, rows, n = [], [], 0
    for b in batches:
        v = b.column(1)
        flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
        if len(ends) and (ends == width).all():
            some = flat.reshape(len(ends), width)
        else:
            some = dense([x[:width] for x in v.to_pylist()], width)
        ids.append(b.column(0).to_numpy())
        rows.append(some)
        n += len(some)
        if n >= ROWS:
            yield np.concatenate(ids), np.concatenate(rows)
            ids, rows, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(rows)


def op5_topk(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
