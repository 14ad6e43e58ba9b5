"""Benchmark decontamination by a prefix-filtered set join.

A window is `window` consecutive words of a benchmark item (the whole item if it is shorter). Containment has threshold 1, so
one necessary prefix token is enough: the window's rarest word, by document frequency over the whole corpus; a window with a word
that no document has is dropped. Document words that are somebody's prefix token make candidates; the length bound (a document
has no fewer words than the window) and the position bound (the window must fit between the document's first and last word) discard
some, and the rest are verified word by word.

Words travel as 64-bit hashes. Equal windows are one window with several items. The benchmark's words are read in blocks of at most
`block_words`, a block is one broadcast of arrays (some 30 bytes a word, so at most about 60 MB), and every block is a pass over the
corpus; document frequencies are counted for all blocks' words together, in passes of at most 2 * block_words distinct words.

Defined results: a null text or one without words has n_words 0 and no hits; items without words or id have no windows; items with
one id count once; repeated documents are judged one by one; columns of documents with the names of the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, append, emit, field, hashed_words, long, mixed, prepare, stored, table, word_hashes

#: Keeps 0-9, a-z and all bytes of non-ASCII code points; lower-cases A-Z; the rest separates words.
WORDS = np.array([c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 0 for c in range(256)], dtype=np.uint16)
WINDOW = 13
#: Benchmark words in one broadcast block; further items go to further blocks.
BLOCK_WORDS = 2_000_000
#: Candidates that are verified together, some 50 bytes each; a frequent prefix token of many windows makes many.
CANDIDATES = 1_000_000


class Index(NamedTuple):
    words: np.ndarray  # of the block's items, one after another
    tokens: np.ndarray  # prefix tokens, sorted
    first: np.ndarray  # of each token's windows, and an end
    start: np.ndarray  # of each window in words
    size: np.ndarray
    place: np.ndarray  # of the prefix token in the window
    owner: np.ndarray  # first of each window's items in owners, and an end
    owners: np.ndarray  # numbers of items
    names: list[str]


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    block, size = [], 0
    for r in benchmark.select(F.col(item).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        if r[0] is None or not r[1]:
            continue
        w, _ = word_hashes(np.frombuffer(bytes(r[1]), np.uint8), np.array([len(r[1])]), WORDS)
        if len(w):
            block.append((r[0], w))
            size += len(w)
            if size >= limit:
                yield block
                block, size = [], 0
    if block:
        yield block


def rarity(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """Document frequency, over all documents, of the sorted words."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        def run(batches):
            known = held.value
            seen = np.zeros(len(known), dtype=np.int64)
            for b in batches:
                for _, _, x, counts in hashed_words(b.column(0), kinds=WORDS):
                    at = np.searchsorted(known, x)
                    at[at == len(known)] = 0
                    hit = np.flatnonzero(known[at] == x)
                    doc = np.repeat(np.arange(len(counts)), counts)[hit]
                    seen += np.bincount(np.unique(doc * len(known) + at[hit]) % len(known), minlength=len(known))
            at = np.flatnonzero(seen)
            yield {"w": at, "n": seen[at]}

        return run

    got = emit(docs.select(F.col(text).cast("binary")), "w long, n long", make).groupBy("w").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), dtype=np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def index(block: list[tuple[str, np.ndarray]], known: np.ndarray, frequency: np.ndarray, width: int) -> Index:
    names = sorted({n for n, _ in block})
    number = {n: k for k, n in enumerate(names)}
    words = np.concatenate([w for _, w in block])
    counts = np.array([len(w) for _, w in block])
    ends = np.cumsum(counts)
    windows = np.maximum(1, counts - width + 1)
    start = np.concatenate([np.arange(n) + e - c for n, e, c in zip(windows, ends, counts, strict=True)])
    size = np.repeat(np.minimum(counts, width), windows)
    whose = np.repeat(np.array([number[n] for n, _ in block]), windows)
    # equal windows become one
    key = size.astype(np.uint64)
    often = frequency[np.searchsorted(known, words)]
    least, place = np.full(len(start), np.iinfo(np.int64).max), np.zeros(len(start), dtype=np.int64)
    for j in range(width):
        in_ = size > j
        at = np.minimum(start + j, len(words) - 1)
        key = np.where(in_, mixed(key * MIX + words[at]), key)
        rarer = in_ & (often[at] < least)
        least[rarer], place[rarer] = often[at[rarer]], j
    order = np.lexsort((whose, key))
    order = order[least[order] > 0]
    key, whose = key[order], whose[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (whose[1:] != whose[:-1])]) if len(order) else np.zeros(0, bool)
    order, key, owners = order[new], key[new], whose[new]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(order) else np.zeros(0, np.int64)
    pick = order[head]
    token = words[start[pick] + place[pick]]
    by = np.argsort(token, kind="stable")
    tokens, first = np.unique(token[by], return_index=True)
    some, tail = np.diff(np.append(head, len(order)))[by], head[by]
    owner = np.append(0, np.cumsum(some))
    flat = owners[np.repeat(tail - owner[:-1], some) + np.arange(int(owner[-1]))] if len(by) else owners
    pick = pick[by]
    return Index(words, tokens, np.append(first, len(pick)), start[pick], size[pick], place[pick], owner, flat, names)


def matches(found: Index, x: np.ndarray, ends: np.ndarray):
    """Document, first word, end and window of every occurrence in the words x of documents with these ends."""
    if not len(found.tokens) or not len(x):
        return (np.zeros(0, np.int64),) * 4
    at = np.minimum(np.searchsorted(found.tokens, x), len(found.tokens) - 1)
    p = np.flatnonzero(found.tokens[at] == x)
    first, n = found.first[at[p]], found.first[at[p] + 1] - found.first[at[p]]
    upto, k, made = np.cumsum(n), 0, []
    while k < len(p):
        stop = max(k + 1, int(np.searchsorted(upto, upto[k] - n[k] + CANDIDATES, "right")))
        made.append(_verified(found, x, ends, p[k:stop], first[k:stop], n[k:stop]))
        k = stop
    return tuple(np.concatenate(c) for c in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 4


def _verified(found: Index, x: np.ndarray, ends: np.ndarray, p: np.ndarray, first: np.ndarray, n: np.ndarray):
    """Of the candidates, which are the n windows from `first` on at each place p of a prefix token, those that occur there."""
    window = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    p = np.repeat(p, n)
    doc = np.searchsorted(ends, p, "right")
    a = p - found.place[window]
    e = a + found.size[window]
    low = np.append(0, ends)[doc]
    good = (ends[doc] - low >= found.size[window]) & (a >= low) & (e <= ends[doc])
    doc, a, e, window = doc[good], a[good], e[good], window[good]
    for j in range(int(found.size.max())):
        k = np.minimum(j, e - a - 1)
        good = x[a + k] == found.words[found.start[window] + k]
        doc, a, e, window = doc[good], a[good], e[good], window[good]
    return doc, a - np.append(0, ends)[doc], e - np.append(0, ends)[doc], window


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window), hits (array of [start, end) word spans), items (ids,
    sorted as strings) and contaminated (20 * n_hit >= n_words, n_hit > 0)."""
    sc = prepare(docs.sparkSession).sparkContext
    results = ("n_words", "n_hit", "hits", "items", "contaminated")
    out = docs.select(*[c for c in docs.columns if c not in results], F.lit(None).cast("array<array<int>>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    fields = [long("n_words"), long("n_hit"), field("hits", "array<array<int>>"), field("items", "array<string>"), field("contaminated", "boolean")]
    lots = list(blocks(benchmark, item, item_text, block_words))
    known = np.unique(np.concatenate([w for b in lots for _, w in b])) if lots else np.zeros(0, np.uint64)
    often = np.concatenate([rarity(docs, text, known[a : a + 2 * block_words]) for a in range(0, len(known), 2 * block_words)]) if len(known) else np.zeros(0, np.int64)
    for number, block in enumerate(lots or [[("", known)]]):
        if number:
            out = stored(out, "decontaminate")
        out = _scan(out, text, fields, sc.broadcast(index(block, known, often, window) if len(known) else None))
    return out


def _scan(docs: DataFrame, text: str, fields: list, made) -> DataFrame:
    hidden = next(n for n in ("_bytes", "_bytes_", "_bytes__") if n not in docs.columns)

    def make():
        found = made.value

        def run(b):
            rows = {f.name: [] for f in fields}
            texts, old_hits, old_items = (b.column(b.schema.names.index(c)) for c in (hidden, "hits", "items"))
            old_hits, old_items = old_hits.to_pylist(), old_items.to_pylist()
            for first, last, x, counts in hashed_words(texts, kinds=WORDS):
                ends = np.cumsum(counts)
                doc, a, e, window = matches(found, x, ends) if found else (np.zeros(0, np.int64),) * 4
                order = np.argsort(doc, kind="stable")
                border = np.searchsorted(doc[order], np.arange(last - first + 1))
                for k, n in enumerate(counts.tolist()):
                    some = order[border[k] : border[k + 1]]
                    spans, names = {tuple(s) for s in old_hits[first + k] or ()}, set(old_items[first + k] or ())
                    if len(some):
                        spans |= set(zip(a[some].tolist(), e[some].tolist(), strict=True))
                        for w in np.unique(window[some]).tolist():
                            names |= {found.names[j] for j in found.owners[found.owner[w] : found.owner[w + 1]].tolist()}
                    hit = end = 0
                    for x0, x1 in sorted(spans):
                        hit += max(0, x1 - max(x0, end))
                        end = max(end, x1)
                    for f, v in zip(fields, (n, hit, [list(s) for s in sorted(spans)], sorted(names), hit > 0 and 20 * hit >= n), strict=True):
                        rows[f.name].append(v)
            return {f.name: pa.array(rows[f.name], type=b.schema.field(f.name).type) if f.name in b.schema.names else rows[f.name] for f in fields}

        return run

    return append(docs.withColumn(hidden, F.col(text).cast("binary")), fields, make).drop(hidden)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_W = "list_filter(regexp_split_to_array(regexp_replace(coalesce({}, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_W.format(_LOWER.format("text"))} as w from documents),
b as (select item_id, {_W.format(_LOWER.format("text"))} as w from benchmark where item_id is not null),
win as (select item_id, w[k : k + {WINDOW} - 1] as s, least(len(w), {WINDOW}) as n from b, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) t(k) where len(w) > 0),
ws as (select distinct s, n, item_id::varchar as item from win),
sizes as (select distinct n from ws),
dw as (select r, k, n, w[k : k + n - 1] as s from d, sizes, unnest(range(1, len(w) - n + 2)) t(k)),
hits as (select r, k, dw.n, item from dw join ws on dw.s = ws.s and dw.n = ws.n),
words as (select r, count(distinct p) as n_hit from (select distinct r, k, n from hits) h, unnest(range(k, k + n)) t(p) group by r),
items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from hits group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated from d left join words using (r) left join items using (r)
"""
