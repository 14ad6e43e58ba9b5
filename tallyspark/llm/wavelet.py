"""Token-ID output as wavelet matrices.

Documents are encoded, an end id is appended to each, and the ids go, in ascending doc_id order, to files of at most about
`file_tokens` ids (a document stays in one file). A file is a wavelet matrix: the ids are mapped to ranks in the file's sorted
alphabet, and the ranks' bits, highest first, are stored as one bit-plane a level, each level sorted stably by the bit above.
Rank directories (a count for every 512 bits) give access, count and occurrence lookup straight from the file.

Defined results: a null text is empty and has the end id alone; null doc_ids come first; equal doc_ids stand next to each other
in any order; extra columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, batches_of, emit, stored, table

MAGIC, STEP, FILE_TOKENS, FILE_DOCS = b"WVMX", 512, 2_000_000, 50_000
#: Classes of bytes: ASCII letters and digits; punctuation marks; white space but for spaces and newlines, and other control
#: characters; first bytes of characters that need a look at the next ones.
PLAIN, MARK, ODD, LOOK = 1, 2, 4, 8
CLASS = bytes(PLAIN * (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) | MARK * (c in b".,;:!?") | ODD * (c < 32 and c != 10 or c == 127) | LOOK * (c in (60, 0xC2, 0xE1, 0xE2, 0xE3)) for c in range(256))
#: Pieces between cuts that a worker remembers.
MEMORY = 1_000_000
#: Bytes of text that are encoded together.
STRIP = 16 << 20
_remembered: dict = {}  # path -> tokenizer, bytes of each token, ids of pieces


class Wavelet:
    """Token access, counting and occurrence lookup over one file's bytes."""

    def __init__(self, blob: bytes):
        magic, self.n, self.size, self.levels = struct.unpack_from("<4sQIB", blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet file")
        at = 17
        self.alphabet = np.frombuffer(blob, "<u4", self.size, at)
        at += 4 * self.size
        width, marks = (self.n + 7) // 8, self.n // STEP + 1
        self.zeros = np.frombuffer(blob, "<u8", self.levels, at)
        at += 8 * self.levels
        self.planes, self.ranks = [], []
        for _ in range(self.levels):
            self.planes.append(np.frombuffer(blob, np.uint8, width, at))
            at += width
            self.ranks.append(np.frombuffer(blob, "<u4", marks, at))
            at += 4 * marks

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        n = len(ids)
        present = np.zeros(int(ids.max(initial=0)) + 1, dtype=bool)
        present[ids] = True
        alphabet = np.flatnonzero(present)
        place = np.zeros(len(present), dtype=np.uint16 if len(alphabet) <= 65536 else np.uint32)
        place[alphabet] = np.arange(len(alphabet))
        x = place[ids]
        levels = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
        zeros, body = [], []
        for k in range(levels - 1, -1, -1):
            bit = (x & x.dtype.type(1 << k)) != 0
            plane = np.packbits(bit, bitorder="little")
            whole = np.zeros((n // STEP + 1) * STEP // 8, dtype=np.uint8)
            whole[: len(plane)] = plane
            counts = np.bitwise_count(whole.view(np.uint64)).reshape(-1, STEP // 64).sum(axis=1, dtype=np.uint32)
            body += [plane.tobytes(), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4").tobytes()]
            low = x.take(np.flatnonzero(~bit))
            zeros.append(len(low))
            x = np.concatenate([low, x.take(np.flatnonzero(bit))])
        return struct.pack("<4sQIB", MAGIC, n, len(alphabet), levels) + alphabet.astype("<u4").tobytes() + np.array(zeros, "<u8").tobytes() + b"".join(body)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        block = min(i // STEP, len(self.ranks[level]) - 1)
        got = int(self.ranks[level][block])
        a = block * STEP
        return got + int(np.unpackbits(self.planes[level][a // 8 : (i + 7) // 8], bitorder="little")[: i - a].sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        x = 0
        for k in range(self.levels):
            bit = self.planes[k][i // 8] >> (i % 8) & 1
            ones = self.rank1(k, i)
            i = int(self.zeros[k]) + ones if bit else i - ones
            x = x << 1 | int(bit)
        return int(self.alphabet[x])

    def _range(self, token: int, end: int) -> tuple[int, int, list]:
        place = int(np.searchsorted(self.alphabet, token))
        if place == self.size or self.alphabet[place] != token:
            return 0, 0, []
        a, b, path = 0, end, []
        for k in range(self.levels):
            bit = place >> (self.levels - 1 - k) & 1
            x, y = self.rank1(k, a), self.rank1(k, b)
            a, b = (int(self.zeros[k]) + x, int(self.zeros[k]) + y) if bit else (a - x, b - y)
            path.append(bit)
        return a, b, path

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences among the first `end` ids."""
        a, b, _ = self._range(token, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        r = self.ranks[level].astype(np.int64)
        if not bit:
            r = np.arange(len(r), dtype=np.int64) * STEP - r
        block = int(np.searchsorted(r, k, "right")) - 1
        a = block * STEP
        bits = np.unpackbits(self.planes[level][a // 8 : (a + STEP) // 8], bitorder="little")[: self.n - a]
        return a + int(np.flatnonzero(bits == bit)[k - int(r[block])])

    def find(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        a, b, path = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            i = self._select(level, path[level], i - int(self.zeros[level]) * path[level])
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: the levels are merged from the lowest up."""
        x = np.zeros(self.n, dtype=np.uint16 if self.size <= 65536 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(x)
            z = int(self.zeros[k])
            up[np.flatnonzero(~bit)] = x[:z]
            up[np.flatnonzero(bit)] = x[z:] | np.array(1 << (self.levels - 1 - k), dtype=x.dtype)
            x = up
        return self.alphabet.astype(np.uint32)[x] if self.n else np.empty(0, np.uint32)


def _borders(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that begin at `starts`: only where the byte-level pattern always cuts. These are spaces
    between ASCII letters and digits, and in texts whose white space is just spaces and newlines also the other borders of white
    space and those between a letter and a punctuation mark."""
    n = len(b)
    kind = np.frombuffer(b.tobytes().translate(CLASS), np.uint8)
    word = (kind & PLAIN) != 0
    cut = np.zeros(n + 1, dtype=bool)
    cut[starts] = True
    inner = np.ones(n + 1, dtype=bool)  # not a text's first byte
    inner[starts] = False
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:] = word[:-1] & inner[1:n]
    after[:-1] = word[1:] & inner[1:n]
    space = b == 32
    cut[:n] |= space & before & after
    # texts with other white space, or a bracket of a special token, have no further cuts
    odd = (kind & ODD) != 0
    two = np.flatnonzero(kind[:-1] & LOOK)
    x, y = b[two], b[two + 1]
    z = b[np.minimum(two + 2, n - 1)]
    thin = (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F)
    odd[two] |= (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE2) & thin | (x == 0xE3) & (y == 0x80) & (z == 0x80) | (x == 60) & (y == 124)
    bad = np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)
    good = np.ones(len(starts), dtype=bool)
    good[bad] = False
    if len(bad) == len(starts):
        return cut
    white = space | (b == 10)
    first, last = white.copy(), white.copy()  # of a run of white space
    first[1:] &= ~white[:-1] | ~inner[1:n]
    last[:-1] &= ~white[1:] | ~inner[1:n]
    ends = np.append(starts[1:], n) - 1
    final = np.zeros(n, dtype=bool)  # a text's last byte
    final[ends[ends >= starts]] = True
    more = np.zeros(n + 1, dtype=bool)
    more[:n] = first | (last & ~final)
    more[1 : n + 1] |= last & ~final & ~space  # a newline stands alone before a word
    # a mark after a letter
    letter = word.copy()
    at = np.flatnonzero((b[:-1] >= 0xC3) & (b[:-1] <= 0xC5))
    letter[at + 1] |= ~((b[at] == 0xC3) & ((b[at + 1] == 0x97) | (b[at + 1] == 0xB7)))
    more[1:n] |= ((kind[1:] & MARK) != 0) & letter[:-1] & inner[1:n]
    if len(bad):
        size = np.diff(np.append(starts, n))
        more[:n] &= np.repeat(good, size)
    return cut | more


def encoder(path: str):
    """texts -> their ids one after another, and each text's number of ids. Texts are cut where the pattern always cuts; each different
    piece is encoded once by the library and remembered."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a core for each task
    from tokenizers import Tokenizer

    if path not in _remembered:
        tok = Tokenizer.from_file(path)
        _remembered[path] = tok, np.array([len(tok.id_to_token(k) or "") for k in range(tok.get_vocab_size())]), {}  # a character for each byte
    tok, sizes, known = _remembered[path]

    def ids_of(text: str) -> np.ndarray:
        return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(new: list[bytes]) -> None:
        lens = np.array([len(x) for x in new], dtype=np.int64)
        ends = np.cumsum(lens)
        b = np.frombuffer(b"".join([b"\0\0", *new, b"\0"]), np.uint8).astype(np.int16)
        head, tail = ends - lens + 2, ends + 1
        # first and last characters that surely are no white space: printable ASCII, or two bytes from U+00C0 on
        shown = lambda x: (x > 32) & (x < 127)
        begins = lambda at: shown(b[at]) | (b[at] >= 0xC3) & (b[at] <= 0xDF)
        closed = shown(b[tail]) | (b[tail] >= 0x80) & (b[tail - 1] >= 0xC3) & (b[tail - 1] <= 0xDF)
        special = np.array([b"<|" in x for x in new]) if b"<|" in b"".join(new) else np.zeros(len(new), bool)
        spaced = (b[head] == 32) & begins(head + 1) & (lens > 1) & closed & ~special
        bare = begins(head) & closed & ~special
        for k in np.flatnonzero(~spaced & ~bare).tolist():
            known[new[k]] = ids_of(new[k].decode()).tobytes()
        # pieces in a row: no token crosses their borders
        for some, gap in ((spaced, b""), (bare, b"\n")):
            at = np.flatnonzero(some)
            for k in range(0, len(at), 20_000):
                part = [new[j] for j in at[k : k + 20_000].tolist()]
                ids = ids_of(gap.join(part).decode())
                stops = np.cumsum(lens[at[k : k + 20_000]] + len(gap)) - len(gap)
                place = np.cumsum(sizes[ids])
                last = np.searchsorted(place, stops) + 1
                if not len(ids) or (place[last - 1] != stops).any():
                    raise ValueError("the tokenizer isn't byte-level")
                raw = ids.tobytes()
                from_ = np.append(0, last[:-1] + len(gap))
                known.update(zip(part, [raw[x:y] for x, y in zip((4 * from_).tolist(), (4 * last).tolist(), strict=True)], strict=True))

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        b = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        starts = offsets[:-1] - offsets[0]
        if not len(b):
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        full = starts[np.diff(offsets) > 0]
        ends, at, k = np.append(full[1:], len(b)), [], 0
        while k < len(full):  # borders are found in slices of whole texts
            e = max(k + 1, int(np.searchsorted(ends, full[k] + SLICE, "right")))
            at.append(np.flatnonzero(_borders(b[full[k] : ends[e - 1]], full[k:e] - full[k])[:-1]) + full[k])
            k = e
        at = np.concatenate(at)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(b))), pa.py_buffer(b)]).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        if len(known) > MEMORY:  # the first are the frequent ones
            some = dict(itertools.islice(known.items(), MEMORY * 6 // 10))
            known.clear()
            known.update(some)
        made = [known.get(x) for x in words]
        if new := [x for x, y in zip(words, made, strict=True) if y is None]:
            learn(new)
        made = [known[x] if y is None else y for x, y in zip(words, made, strict=True)]
        size = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        flat, place = np.frombuffer(b"".join(made), "<u4"), np.cumsum(size) - size
        which = pieces.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat((place[which] - (ends - n)).astype(np.int32), n) + np.arange(int(ends[-1]), dtype=np.int32)]
        # ids before each text: those of the pieces before it
        before = np.append(0, ends)[np.searchsorted(at, starts)]
        return ids, np.diff(np.append(before, len(ids)))

    return encode


def strips(sizes: np.ndarray, limit: int):
    """Slices of rows with about `limit` bytes each."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, e
        a = e


def gathered(batches, limit: int = STRIP):
    """Batches of about `limit` bytes of text (the second column)."""
    some, n = [], 0
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        for a, e in strips(sizes, limit):
            some.append(b.slice(a, e - a))
            n += int(sizes[a:e].sum())
            if n >= limit:
                yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
                some, n = [], 0
    if some:
        t = pa.Table.from_batches(some).combine_chunks()
        yield from t.to_batches()


def write_files(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, file_tokens: int = FILE_TOKENS, partitions: int | None = None) -> DataFrame:
    """file_id (ascending with doc_id), n_tokens, doc_ids, lengths, blob: one row a file, stored."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def make():
        from pyspark import TaskContext

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()

        def run(batches):
            names, parts, sizes, total, docs_, seq = [], [], [], 0, 0, 0

            def file():
                return {"file_id": [part << 32 | seq], "n_tokens": [total], "doc_ids": [names], "lengths": [np.concatenate(sizes)], "blob": [Wavelet.build(np.concatenate(parts))]}

            for b in gathered(batches):
                ids_of, n = b.column(0).to_pylist(), b.num_rows
                ids, own = encode(b.column(1))
                own = own + 1
                ends = np.cumsum(own)
                x = np.full(int(ends[-1]), end_id, dtype="<u4")
                inside = np.ones(len(x), dtype=bool)
                inside[ends - 1] = False
                x[inside] = ids
                a = 0
                while a < n:  # the documents up to the one that fills the file
                    done = int(ends[a - 1]) if a else 0
                    e = min(n, int(np.searchsorted(ends, done + file_tokens - total)) + 1, a + FILE_DOCS - docs_)
                    names += ids_of[a:e]
                    sizes.append(own[a:e].astype(np.int32))
                    parts.append(x[done : int(ends[e - 1])])
                    total, docs_ = total + int(ends[e - 1]) - done, docs_ + e - a
                    if total >= file_tokens or docs_ >= FILE_DOCS:
                        yield file()
                        names, parts, sizes, total, docs_, seq = [], [], [], 0, 0, seq + 1
                    a = e
            if names:
                yield file()

        return run

    with batches_of(docs.sparkSession):
        return stored(emit(rows, "file_id long, n_tokens long, doc_ids array<long>, lengths array<int>, blob binary", make), "wavelet")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32: from the files alone."""
    part = F.shiftright("file_id", 32)
    # running counts within a partition first, so that the one-task window sees a row a partition only
    inner = files.select("file_id", part.alias("p"), F.coalesce(F.sum("n_tokens").over(Window.partitionBy(part).orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner"))
    sums = files.groupBy(part.alias("p")).agg(F.sum("n_tokens").alias("n"))
    outer = sums.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    base = inner.join(outer, "p").select("file_id", (F.col("inner") + F.col("outer")).alias("base"))

    def make():
        def run(batches):
            for b in batches:
                for name, ids_, sizes, blob in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    raw = memoryview(Wavelet(blob).ids().astype("<u4").tobytes())
                    ends = np.cumsum(sizes)
                    starts = ends - sizes
                    yield {"file_id": [name] * len(sizes), "doc_id": ids_, "local": starts, "n_tokens": sizes, "ids_crc32": [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]}

        return run

    with batches_of(files.sparkSession, 1):  # a row is a file
        back = stored(emit(files.select("file_id", "doc_ids", "lengths", "blob"), "file_id long, doc_id long, local long, n_tokens long, ids_crc32 long", make), "wavelet-rows")
    return back.join(base, "file_id").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op9_wavelet(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(files)
