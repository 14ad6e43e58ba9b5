"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a bigram trie in shards. A shard's first level holds its contexts, its second the contexts' successors; both are
monotone sequences in Elias-Fano form (successors are made monotone by their context's rank in front), pointers are another one,
and the smoothed bigram probabilities are 8-bit codes on a log10 grid. Nothing is unpacked for a query: the context is found in the
bucket of its high bits (two selects), its pointers are read by select, and the successor is searched by bisection between them, in
the bucket of its high bits. Levels are read from one buffer, which may be a memory-mapped file (`Trie.open`).

A Dirichlet prior smooths: p(w|u) = (c(u,w) + PRIOR * p1(w)) / (c(u) + PRIOR), which the trie stores for bigrams of the training
texts; for others the count is 0. p1 is a unigram with absolute discount, whose discount comes from counts of counts.

Nothing of the size of the vocabulary is broadcast or collected. Texts are read once into chunks of about `chunk_tokens` tokens:
token numbers, and the chunk's distinct words with their training counts. Chunks ask for what they need with one entry for each
distinct word or bigram: counts of words from unigram shards, then codes of bigrams from trie shards; a shard that a chunk needs
nothing from gets no row, so rows grow with the distinct words and bigrams of the chunks. A frequent word reaches its shard once a
chunk, and contexts over 1/(HOT * shards) of all tokens are dealt out over sub-shards by successor. Chunks rest in a bucketed table,
so answers come to them and they aren't shuffled. Words are known by 64-bit hashes, successors of one context by 40 bits.

Defined results: a null text is empty and has the end token alone; a null id is no held-out one; equal rows count and score one by
one; without training tokens N and V are 0 and every token is unknown; extra columns are ignored.
"""

from __future__ import annotations

import mmap
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, SLICE, batches_of, emit, hashed_words, stored, table

CHUNK_TOKENS, WORD_SHARD, PAIR_SHARD, HOT, SUBS = 1_000_000, 500_000, 1_000_000, 4, 16
GRID = 20.0  # codes for each power of ten: 255 of them reach down to 10 ** -12.7
#: Weight of the unigram in every context, in tokens. Of 0.5, 2, 5, 20 .. 3000, the best for a seventh of the training documents of
#: the driver's sf0.1 tables when the others taught; held-out documents weren't looked at.
PRIOR = 300.0
#: Hashes of no word.
END, BEGIN = np.uint64(0x51D3A9F27C64E805), np.uint64(0xC2B87E1460F9D33B)
MARK = np.uint64(24)  # a successor's mark: its hash without so many low bits
#: The place of the k-th one of each byte.
_SELECT = np.array([[*[j for j in range(8) if v >> j & 1], *[0] * 8][:8] for v in range(256)], dtype=np.uint8)


class EliasFano:
    """A monotone sequence: low bits packed, high bits as a bit vector of unary gaps, with the number of ones before every 512 bits."""

    @staticmethod
    def build(x: np.ndarray) -> bytes:
        n, top = len(x), int(x[-1]) if len(x) else 0
        low = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        blocks = (n + (top >> low) + 1) // 512 + 1
        bits = np.zeros(blocks * 512, dtype=np.uint8)
        bits[(x >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(high.view(np.uint64)).reshape(-1, 8).sum(axis=1, dtype=np.int64)
        lows = []
        for a in range(0, n, 65536):  # 65536 * low is a whole number of bytes
            some = (x[a : a + 65536] & np.uint64((1 << low) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)
            lows.append(np.packbits(np.unpackbits(some, axis=1, bitorder="little")[:, :low].ravel(), bitorder="little"))
        packed_ = np.concatenate([*lows, np.zeros(8, np.uint8)])  # words of 8 bytes are read from any byte
        return np.array([n, low, blocks, len(packed_)], "<i8").tobytes() + (np.cumsum(ones) - ones).astype("<i8").tobytes() + high.tobytes() + packed_.tobytes()

    def __init__(self, buffer, at: int = 0):
        self.n, self.low, blocks, size = (int(v) for v in np.frombuffer(buffer, "<i8", 4, at))
        self.ones = np.frombuffer(buffer, "<i8", blocks, at + 32)
        self.high = np.frombuffer(buffer, "<u8", 8 * blocks, at + 32 + 8 * blocks).reshape(-1, 8)
        low_at = at + 32 + 72 * blocks
        self.words = np.ndarray((size - 7,), "<u8", buffer, low_at, (1,))
        self.end = low_at + size

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Places of the k-th ones or zeros, from 0."""
        before = np.arange(len(self.ones)) * 512 - self.ones if zeros else self.ones
        block = np.searchsorted(before, k, "right") - 1
        rest = k - before[block]
        words = ~self.high[block] if zeros else self.high[block]
        sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        rows = np.arange(len(k))
        word = (sums <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(word > 0, sums[rows, word - 1], 0)
        bytes_ = np.ascontiguousarray(words[rows, word]).view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(np.bitwise_count(bytes_), axis=1, dtype=np.int64)
        byte = (sums <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(byte > 0, sums[rows, byte - 1], 0)
        return block * 512 + word * 64 + byte * 8 + _SELECT[bytes_[rows, byte], rest]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        return (self.words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return (self._select(i, False) - i).astype(np.uint64) << np.uint64(self.low) | self.lows(i)

    def find(self, x: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        """Places of the values x, -1 for those that aren't there; places are within [least, most) if these are given."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n or not len(x):
            return out
        top = len(self.ones) * 512 - self.n - 1  # the last zero
        h = np.minimum(x >> np.uint64(self.low), np.uint64(top + 1)).astype(np.int64)
        inside = np.flatnonzero(h <= top)
        h = h[inside]
        # the bucket of equal high bits lies between two zeros
        a = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - np.maximum(h - 1, 0), 0)
        e = self._select(h, True) - h
        if least is not None:
            a, e = np.maximum(a, least[inside]), np.minimum(e, most[inside])
        want, end = x[inside] & np.uint64((1 << self.low) - 1), e
        for _ in range(int(max(0, (e - a).max(initial=0))).bit_length()):
            m = (a + e) >> 1
            less = (a < e) & (self.lows(np.minimum(m, self.n - 1)) < want)
            a, e = np.where(less, m + 1, a), np.where(less | (a >= e), e, m)
        good = (a < end) & (self.lows(np.minimum(a, self.n - 1)) == want)
        out[inside[good]] = a[good]
        return out


class Trie:
    """Contexts, pointers, successors and codes of one shard."""

    @staticmethod
    def build(contexts: np.ndarray, words: np.ndarray, codes: np.ndarray) -> bytes:
        """From bigrams sorted by (context, word); words are marks of 40 bits."""
        first = np.concatenate([[True], contexts[1:] != contexts[:-1]]) if len(contexts) else np.empty(0, bool)
        rank = np.cumsum(first).astype(np.uint64) - np.uint64(1) if len(first) else np.empty(0, np.uint64)
        starts = np.concatenate([np.flatnonzero(first), [len(contexts)]]).astype(np.uint64)
        parts = [EliasFano.build(contexts[first]), EliasFano.build(starts), EliasFano.build(rank << np.uint64(40) | words), codes.astype(np.uint8).tobytes()]
        return b"".join(parts)

    def __init__(self, buffer):
        self.contexts = EliasFano(buffer)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.successors = EliasFano(buffer, self.pointers.end)
        self.codes = np.frombuffer(buffer, np.uint8, self.successors.n, self.successors.end)

    @staticmethod
    def open(path: str) -> Trie:
        """From a file, mapped into memory."""
        with open(path, "rb") as f:
            return Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def look(self, contexts: np.ndarray, runs: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of bigrams, 0 for those that aren't there. contexts: one for each run of bigrams; runs: their lengths."""
        out = np.zeros(len(words), dtype=np.uint8)
        rank = self.contexts.find(contexts)
        known = np.flatnonzero(rank >= 0)
        least, most = (np.zeros(len(contexts), np.int64) for _ in range(2))
        least[known], most[known] = (self.pointers.get(rank[known] + k).astype(np.int64) for k in (0, 1))
        step = 1 << 18
        of = np.repeat(np.arange(len(contexts)), runs)
        for a in range(0, len(words), step):
            c = of[a : a + step]
            some = np.flatnonzero(rank[c] >= 0)
            c = c[some]
            place = self.successors.find(rank[c].astype(np.uint64) << np.uint64(40) | words[a + some], least[c], most[c])
            out[a + some] = np.where(place >= 0, self.codes[np.maximum(place, 0)], 0) if self.successors.n else 0
        return out


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(p) * GRID) + 1, 1, 255).astype(np.uint8)


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 0, 0.0, 10.0 ** -((codes.astype(np.float64) - 1) / GRID))


def packed(x: np.ndarray) -> bytes:
    """Byte planes, each compressed."""
    z = zstandard.ZstdCompressor(level=3)
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    parts = [z.compress(p.tobytes()) for p in planes]
    return np.array([len(x), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unpacked(data: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    n, *sizes = np.frombuffer(data, "<i8", wide + 1)
    out, at = np.empty((int(n), wide), dtype=np.uint8), 8 * (wide + 1)
    for k, size in enumerate(sizes):
        out[:, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, int(n))), np.uint8) if n else 0
        at += size
    return out.view(kind).ravel()


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """chunk, ids, nulls (which ids are null), lengths, held, tokens (numbers of words), words (hashes), counts."""

    def make():
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def run(batches):
            names, held, sizes, parts, total, seq = [], [], [], [], 0, 0

            def chunk():
                h, n, out = np.concatenate(parts), np.concatenate(sizes), np.array(held, dtype=bool)
                words, number, uses = np.unique(h, return_inverse=True, return_counts=True)
                order = np.argsort(-uses, kind="stable")  # frequent words get small numbers
                place = np.empty(len(order), dtype=np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                tokens = place[number]
                train = np.bincount(tokens[np.repeat(~out, n)], minlength=len(words)).astype(np.uint64)
                ids = np.array([0 if x is None else x for x in names], dtype=np.int64)
                null = np.array([x is None for x in names], dtype=np.uint8)
                return {"chunk": [part << 32 | seq], "ids": [packed(ids)], "nulls": [packed(null)], "lengths": [packed(n.astype(np.uint32))], "held": [packed(out.astype(np.uint8))], "tokens": [packed(tokens)], "words": [words[order].tobytes()], "counts": [packed(train)]}

            for b in batches:
                ids, out = b.column(0).to_pylist(), b.column(2).to_pylist()
                for a, e, h, n in hashed_words(b.column(1), min(SLICE, 8 * chunk_tokens)):
                    n = n + 1
                    x = np.full(len(h) + e - a, END, dtype=np.uint64)
                    inside = np.ones(len(x), dtype=bool)
                    inside[np.cumsum(n) - 1] = False
                    x[inside] = h
                    names += ids[a:e]
                    held += out[a:e]
                    sizes.append(n)
                    parts.append(x)
                    total += len(x)
                    if total >= chunk_tokens:
                        yield chunk()
                        names, held, sizes, parts, total, seq = [], [], [], [], 0, seq + 1
            if names:
                yield chunk()

        return run

    return emit(docs, "chunk long, ids binary, nulls binary, lengths binary, held binary, tokens binary, words binary, counts binary", make)


def _slices(where: np.ndarray):
    """Shard, places of the entries that go there, in stable order; only shards that get some."""
    order = np.argsort(where, kind="stable")
    shards, first = np.unique(where[order], return_index=True)
    for k, at in zip(shards.tolist(), np.split(order, first[1:]), strict=True):
        yield k, at


def _bigrams(r, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per token: place of its context's word (-1: begin); distinct (context, word) pairs, each token's pair, training counts."""
    n, tokens, held = unpacked(r["lengths"], np.uint32).astype(np.int64), unpacked(r["tokens"], np.uint32).astype(np.int64), unpacked(r["held"], np.uint8) > 0
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[np.cumsum(n) - n] = len(words)
    pairs, of = np.unique(context * len(words) + tokens, return_inverse=True)
    train = np.bincount(of[np.repeat(~held, n)], minlength=len(pairs)).astype(np.uint32)
    return n, tokens, held, pairs, of, train


def _place(contexts: np.ndarray, words: np.ndarray, uses: np.ndarray, shards: int, total: int) -> np.ndarray:
    """Shard of each pair; contexts with a large part of all tokens are dealt out by successor."""
    x = ((contexts * MIX) >> np.uint64(33)).astype(np.int64)
    sub = ((words * MIX) >> np.uint64(40)).astype(np.int64) % (SUBS * shards)
    return np.where(uses > max(1000, total // (HOT * shards)), x + sub, x) % shards


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out=None, chunk_tokens: int = CHUNK_TOKENS, model_path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a condition; its rows don't teach. The
    trie's shards are written to model_path, if given."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2 if held_out is None else held_out, F.lit(False))
    made = _chunks(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary"), held), chunk_tokens)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lm_chunks_{uuid.uuid4().hex}"
    with batches_of(spark):
        made.write.bucketBy(buckets, "chunk").sortBy("chunk").saveAsTable(name)
    try:
        with batches_of(spark, 1):  # rows are large from here on
            return _scored(spark, spark.table(name), model_path)
    finally:
        spark.sql(f"drop table {name}")


def _scored(spark, chunks: DataFrame, model_path: str | None) -> DataFrame:
    entries = chunks.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    word_shards = max(1, -(-int(entries) // WORD_SHARD))

    def word_place(words: np.ndarray) -> np.ndarray:
        return ((words >> np.uint64(20)) % np.uint64(word_shards)).astype(np.int64)

    def ask_words():
        def run(batches):
            for b in batches:
                for chunk, words, counts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    w, c = np.frombuffer(words, np.uint64), unpacked(counts, np.uint64)
                    for k, at in _slices(word_place(w)):
                        yield {"shard": [k], "chunk": [chunk], "words": [w[at].tobytes()], "counts": [packed(c[at])]}

        return run

    asked = emit(chunks.select("chunk", "words", "counts"), "shard long, chunk long, words binary, counts binary", ask_words)

    def count_words():
        def run(batches):
            for b in batches:
                for k, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    all_ = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])
                    words, of = np.unique(all_, return_inverse=True)
                    c = np.zeros(len(words), dtype=np.uint64)
                    np.add.at(c, of, np.concatenate([unpacked(r["counts"], np.uint64) for r in rows]))
                    at = 0
                    for r in rows:
                        n = len(r["words"]) // 8
                        yield {"chunk": [r["chunk"]], "shard": [k], "counts": [packed(c[of[at : at + n]])], "sums": [None]}
                        at += n
                    yield {"chunk": [None], "shard": [k], "counts": [None], "sums": [[int(c.sum()), int((c > 0).sum()), int((c == 1).sum()), int((c == 2).sum())]]}

        return run

    by_shard = lambda df, *cols: df.groupBy("shard").agg(F.collect_list(F.struct(*cols)).alias("rows"))
    counted = stored(emit(by_shard(asked, "chunk", "words", "counts"), "chunk long, shard long, counts binary, sums array<long>", count_words), "lm-words")
    total, types, ones, twos = (int(x) for x in counted.where("sums is not null").agg(*(F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(4))).first())
    discount = ones / (ones + 2 * twos) if ones else 0.5
    answers = counted.where("sums is null").groupBy("chunk").agg(F.collect_list(F.struct("shard", "counts")).alias("answers"))
    pair_shards = max(1, -(-total // PAIR_SHARD))

    def unigram(c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (c - discount) / max(1, total), discount * types / max(1, total) / (types + 1) if total else 1.0)

    def smoothed(pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (pair + PRIOR * unigram(word)) / (context + PRIOR)

    def with_counts(r) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of a chunk's words, the last for BEGIN (followed as often as END occurs)."""
        words = np.frombuffer(r["words"], np.uint64)
        c = np.zeros(len(words) + 1, dtype=np.int64)
        got = {a["shard"]: a["counts"] for a in r["answers"]}
        for k, at in _slices(word_place(words)):
            c[at] = unpacked(got[k], np.uint64).astype(np.int64)
        c[-1] = c[:-1][words == END].sum()
        return np.append(words, BEGIN), c

    def pairs_of(r):
        words, c = with_counts(r)
        n, tokens, held, pairs, of, train = _bigrams(r, words[:-1])
        u, w = np.divmod(pairs, len(words) - 1)
        where = _place(words[u], words[w], c[u], pair_shards, total)
        return words, c, n, tokens, held, of, train, u, w, where

    def ask_pairs():
        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    words, c, *_, train, u, w, where = pairs_of(r)
                    for k, at in _slices(where):
                        # runs of one context: its hash and uses stand once
                        first = np.flatnonzero(np.concatenate([[True], u[at][1:] != u[at][:-1]]))
                        some = u[at][first]
                        yield {"shard": [k], "chunk": [r["chunk"]], "contexts": [words[some].tobytes()], "uses": [packed(c[some])], "runs": [packed(np.diff(np.append(first, len(at))).astype(np.uint32))], "words": [packed(words[w[at]] >> MARK)], "counts": [packed(train[at])], "common": [packed(c[w[at]])]}

        return run

    met = chunks.join(answers, "chunk")
    pair_kind = "shard long, chunk long, contexts binary, uses binary, runs binary, words binary, counts binary, common binary"
    asked = emit(met.select("chunk", "lengths", "held", "tokens", "words", "answers"), pair_kind, ask_pairs)

    def answer_pairs():
        def run(batches):
            for b in batches:
                for k, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    got = [(unpacked(r["runs"], np.uint32), np.frombuffer(r["contexts"], np.uint64), unpacked(r["uses"], np.int64)) for r in rows]
                    context, uses = (np.concatenate([np.repeat(x[j], x[0]) for x in got]) for j in (1, 2))
                    word, train, common = (np.concatenate([unpacked(r[c], kind) for r in rows]) for c, kind in (("words", np.uint64), ("counts", np.uint32), ("common", np.int64)))
                    seen = np.flatnonzero(train)
                    seen = seen[np.lexsort((word[seen], context[seen]))]
                    x, y = context[seen], word[seen]
                    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.empty(0, np.int64)
                    c = np.add.reduceat(train[seen].astype(np.int64), first) if len(x) else np.empty(0, np.int64)
                    codes = quantised(smoothed(c, uses[seen][first], common[seen][first]))
                    blob = Trie.build(x[first], y[first], codes)
                    del context, uses, common, seen, x, y
                    trie, at = Trie(blob), 0
                    for r, (runs, contexts, _) in zip(rows, got, strict=True):
                        m = int(runs.sum())
                        yield {"chunk": [r["chunk"]], "shard": [k], "codes": [packed(trie.look(contexts, runs, word[at : at + m]))], "trie": [None]}
                        at += m
                    if model_path:
                        yield {"chunk": [None], "shard": [k], "codes": [None], "trie": [blob]}

        return run

    cols = [c.split()[0] for c in pair_kind.split(", ")[1:]]
    answered = stored(emit(by_shard(asked, *cols), "chunk long, shard long, codes binary, trie binary", answer_pairs), "lm-pairs")
    if model_path:
        answered.where("trie is not null").select("shard", "trie").write.mode("overwrite").parquet(model_path)
    codes = answered.where("trie is null").groupBy("chunk").agg(F.collect_list(F.struct("shard", "codes")).alias("codes"))

    def finish():
        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    words, c, n, tokens, held, of, _, u, w, where = pairs_of(r)
                    code, got = np.zeros(len(u), dtype=np.uint8), {a["shard"]: a["codes"] for a in r["codes"]}
                    for k, at in _slices(where):
                        code[at] = unpacked(got[k], np.uint8)
                    p = np.log10(np.where(code > 0, probability(code), smoothed(0, c[u], c[w])))
                    starts = np.cumsum(n) - n
                    sums = lambda x: np.add.reduceat(x, starts)
                    base = np.log10((c + 1) / (total + types + 1))
                    ids, null = unpacked(r["ids"], np.int64), unpacked(r["nulls"], np.uint8)
                    yield {"doc_id": [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)], "held_out": held, "n_tokens": n, "n_known": sums((c[tokens] > 0).astype(np.int64)), "base_score": sums(base[tokens]), "score": sums(p[of])}

        return run

    done = emit(chunks.join(answers, "chunk").join(codes, "chunk").select("chunk", "ids", "nulls", "lengths", "held", "tokens", "words", "answers", "codes"), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double", finish)
    return stored(done, "lm-scores").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
