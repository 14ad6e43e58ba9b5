"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (the file's rewrite rules, a trie of byte strings of which the longest
match counts; its white space rules; spaces to U+2581, optional space in front), the pieces (an arc for every piece, with its id as
output) and byte fallback (an arc of byte pieces, or of the unknown piece, for every character that no piece covers). They are
composed with the input, and the tropical-semiring shortest path gives the ids. Models with user-defined pieces or with white space
as a suffix are refused.

For a merge-based model the last transducer is a bigram acceptor: two neighbouring pieces weigh 0 if merging their joined
characters by piece score gives back these two, else infinity. A sequence of pieces is what merging makes of a text exactly
if all neighbours pass (a first merge across a border would happen to that pair alone as well), so just one path of finite
weight reaches every place. For a unigram model, arcs weigh minus their score and the acceptor passes all; a character without a piece weighs 10 more than the worst piece. (Weights are summed in double precision; the library sums in
single precision, so of two paths that weigh the same but for its rounding it may take the other.)

Pieces with U+2581 inside don't occur, so no arc crosses the border before a space that follows another character: the input
is cut there, and each different part is composed once in a worker. compile_model checks this, and else doesn't cut.
Short parts of a batch are composed together: their arcs are found by one walk of all starts through a trie, and the acceptor
takes one place of all parts at a time.

Defined results: a null text is empty, and an empty text has no ids; equal rows get equal results; extra columns are kept, and
those with the results' names are replaced; byte pieces that are no valid UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, field, long, prepare, table

SPACE = "▁"
MEMORY = 200_000
#: Longest part that is composed together with others, characters of texts that are encoded together, and cached pairs.
SHORT, TOGETHER, CACHE = 64, 300_000, 1 << 20
CODES = 0x110000


def fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            x |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return x

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


def model_kind(path: str) -> int:
    """1: unigram, 2: merges, by the training settings in the model file."""
    with open(path, "rb") as f:
        trained = dict(fields(f.read())).get(2, b"")
    return dict(fields(trained)).get(3, 1)


class Normaliser:
    """The normaliser of a model file's specification: a double-array trie from byte strings to their replacements."""

    def __init__(self, spec: bytes):
        found = dict(fields(spec))
        data = found.get(2, b"")
        self.front, self.trim = bool(found.get(3, 1)), bool(found.get(4, 1))
        if not found.get(5, 1):
            raise ValueError("models that don't escape white space aren't supported")
        size = int.from_bytes(data[:4], "little")
        self.units = np.frombuffer(data[4 : 4 + size], "<u4").tolist()
        self.targets = data[4 + size :]
        self.identity = not self.units and not self.trim
        self.heads: dict[str, bool] = {}

    def match(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length and replacement of the longest rule that matches at a place, else 0."""
        units, best = self.units, (0, b"")
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                a = units[node] & 0x7FFFFFFF
                best = k + 1 - at, self.targets[a : self.targets.index(0, a)]
        return best

    def _begins(self, c: str) -> bool:
        """Whether some rule may begin with the character's first byte and match within or beyond it."""
        if (x := self.heads.get(c)) is None:
            raw, units = c.encode(), self.units
            node, x = units[0] >> 10 << ((units[0] & 512) >> 6), True
            for k in raw:
                node ^= k
                if units[node] & 0x800000FF != k:
                    x = False
                    break
                node ^= units[node] >> 10 << ((units[node] & 512) >> 6)
            x = self.heads[c] = x or bool(self.match(raw, 0)[0])
        return x

    def __call__(self, text: str) -> str:
        """The rewritten text, still with spaces for U+2581 and without a space in front."""
        if self.identity or not text:
            return text
        parts = [text]
        if self.units and any(self._begins(c) for c in set(text)):
            raw, at, parts = text.encode(), 0, []
            while at < len(raw):
                n, x = self.match(raw, at)
                if not n:
                    n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                    x = raw[at : at + n]
                parts.append(x.decode("utf-8", "replace"))
                at += n
        if not self.trim:
            return "".join(parts)
        # runs of spaces become one, and none at the ends
        return re.sub(" +", " ", "".join(parts)).strip(" ").rstrip(f" {SPACE}")


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(k) for k in range(n)]
        self.unknown = sp.unk_id()
        self.bytes = {int(names[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        self.arcs = {names[k]: k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))}
        self.score = {x: sp.get_score(k) for x, k in self.arcs.items()}
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        if any(dict(fields(x)).get(3, 1) == 4 for k, x in model if k == 1) or dict(fields(dict(model).get(2, b""))).get(24, 0):
            raise ValueError("models with user-defined pieces or white space as a suffix aren't supported")
        self.rules = Normaliser(dict(model).get(3, b""))
        self.beyond = 10.0 - min(self.score.values())  # weight of a character without a piece
        self.longest = max(map(len, self.arcs))
        self.cuts = not any(SPACE in x.lstrip(SPACE) for x in self.arcs)
        self.front = self.rules.front
        self.merges = model_kind(path) == 2
        self.output = [b""] * n
        for x, k in self.arcs.items():
            self.output[k] = x.replace(SPACE, " ").encode()
        for b, k in self.bytes.items():
            self.output[k] = bytes([b])
        self.output[self.unknown] = " ⁇ ".encode()
        self.pairs: dict = {}
        self.parts: dict = {}
        self.n, self.slots = n, None

    def merged(self, text: str) -> list[str]:
        """The pieces that merging by score, leftmost first, makes of a few characters."""
        parts, score, none = list(text), self.score, float("-inf")
        weights = [score.get(x + y, none) for x, y in itertools.pairwise(parts)]
        while weights and (best := max(weights)) > none:
            k = weights.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del weights[k]
            if k:
                weights[k - 1] = score.get(parts[k - 1] + parts[k], none)
            if k < len(weights):
                weights[k] = score.get(parts[k] + parts[k + 1], none)
        return parts

    def passes(self, a: str, b: str) -> bool:
        """The bigram acceptor; a is empty at the start."""
        if not self.merges:
            return True
        key = (a, b)
        if (x := self.pairs.get(key)) is None:
            if len(self.pairs) > MEMORY // 2:
                self.pairs.clear()
            x = self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return x

    def compose(self, part: str) -> list[int]:
        """Shortest path over one part of the normalised input: for each place the least weight and the piece that ends there."""
        n = len(part)
        arcs, score, merges = self.arcs, self.score, self.merges
        weight, last = [0.0] + [float("inf")] * n, [""] * (n + 1)
        for e in range(1, n + 1):
            for a in range(max(0, e - self.longest), e):
                x = part[a:e]
                if x in arcs:
                    w = weight[a] if merges else weight[a] - score[x]
                    if w < weight[e] and self.passes(last[a], x):
                        weight[e], last[e] = w, x
                        if merges:
                            break
            if merges and last[e] == "":  # no piece covers the character: byte fallback
                weight[e], last[e] = weight[e - 1], part[e - 1]
            elif not merges and part[e - 1] not in arcs and weight[e - 1] + self.beyond < weight[e]:
                weight[e], last[e] = weight[e - 1] + self.beyond, part[e - 1]
        out: list[int] = []
        while n:
            x = last[n]
            k = arcs.get(x)
            out += [k] if k is not None else [self.bytes[b] for b in reversed(x.encode())] if self.bytes else [self.unknown]
            n -= len(x)
        return out[::-1]

    def _trie(self) -> None:
        """Arrays for composing many parts: character classes, the trie of pieces as a hash table, and a cache of pairs."""
        n = self.n
        self.names = dict(zip(self.arcs.values(), self.arcs, strict=True))
        letters = sorted({c for x in self.arcs for c in x})
        self.classes = np.zeros(CODES, dtype=np.int32)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.single = np.arange(n, n + CODES, dtype=np.int32)  # the piece of a character, or n + its code
        one = [x for x in self.arcs if len(x) == 1]
        self.single[[ord(x) for x in one]] = [self.arcs[x] for x in one]
        self.width = len(letters) + 1
        steps, ends, place = {}, [-1], {c: k + 1 for k, c in enumerate(letters)}
        for x, piece in self.arcs.items():
            node = 0
            for c in x:
                key = node * self.width + place[c]
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                node = steps[key]
            ends[node] = piece
        self.ends = np.array(ends, dtype=np.int64)
        self.lengths = np.ones(n + CODES + 1, dtype=np.int16)
        self.lengths[list(self.names)] = [len(x) for x in self.names.values()]
        self.shift = np.uint64(64 - max(10, (4 * len(steps)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.targets = np.zeros(len(self.slots), dtype=np.int64)
        keys, values = np.array(list(steps), dtype=np.int64), np.array(list(steps.values()), dtype=np.int64)
        for at, key, value in zip(self._slot(keys, self.shift).tolist(), keys.tolist(), values.tolist(), strict=True):
            while self.slots[at] != -1:
                at = (at + 1) % len(self.slots)
            self.slots[at], self.targets[at] = key, value
        self.cached, self.verdict = np.full(CACHE, -1, dtype=np.int64), np.zeros(CACHE, dtype=bool)

    @staticmethod
    def _slot(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def _step(self, nodes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The trie's next nodes, or -1."""
        keys = nodes * self.width + classes
        at = self._slot(keys, self.shift)
        held = self.slots[at]
        out = np.where(held == keys, self.targets[at], -1)
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.slots)
            held = self.slots[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.targets[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out

    def _name(self, x: int) -> str:
        return self.names[x] if x in self.names else chr(x - self.n) if x < self.n + CODES else ""

    def _pass(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """The bigram acceptor for arrays; n + CODES is the start."""
        keys = before * self.n + pieces
        at = self._slot(keys, np.uint64(64 - CACHE.bit_length() + 1))
        ok = self.verdict[at]
        new = np.flatnonzero(self.cached[at] != keys)
        if len(new):
            some, back = np.unique(keys[new], return_inverse=True)
            found = []
            for key in some.tolist():
                found.append(self.passes(self._name(key // self.n), self._name(key % self.n)))
            found = np.array(found)[back.ravel()]
            ok[new] = found
            self.cached[at[new]] = keys[new]
            # of two keys of a slot the one that stays gives the verdict
            stays = self.cached[at[new]] == keys[new]
            self.verdict[at[new[stays]]] = found[stays]
        return ok

    def compose_many(self, parts: list[str]) -> list[bytes]:
        """compose() of each part, as unsigned 32-bit integers."""
        if self.slots is None:
            self._trie()
        n = self.n
        size = np.array([len(x) for x in parts], dtype=np.int64)
        code = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
        start = np.cumsum(size) - size
        stop, first = np.repeat(start + size, size), np.repeat(start, size)
        classes = self.classes[code]
        at, node, got = np.arange(len(code)), np.zeros(len(code), dtype=np.int64), []
        for k in range(self.longest):
            node = self._step(node, classes[at + k])
            live = node >= 0
            at, node = at[live], node[live]
            piece = self.ends[node]
            is_end = piece >= 0
            got.append((at[is_end], np.full(int(is_end.sum()), k + 1), piece[is_end]))
            live = at + k + 1 < stop[at]
            at, node = at[live], node[live]
        a, k, piece = (np.concatenate(x) for x in zip(*got, strict=True))
        place = a + k - first[a]  # within the part
        order = np.argsort(place, kind="stable")  # at a place the longest comes last
        a, k, piece = a[order], k[order], piece[order]
        border = np.searchsorted(place[order], np.arange(size.max() + 2))
        last = np.full(len(code), -1, dtype=np.int64)  # by last character
        for e in range(1, int(size.max()) + 1):
            here = slice(border[e], border[e + 1])
            x, y = a[here], piece[here]
            before = np.where(x == first[x], n + CODES, last[x - 1])
            ok = self._pass(before, y)
            last[x[ok] + k[here][ok] - 1] = y[ok]
            rest = start[size >= e] + e - 1
            rest = rest[last[rest] < 0]
            last[rest] = self.single[code[rest]]
        on, pos = np.zeros(len(code), dtype=bool), start + size - 1
        low = start
        while len(pos):
            on[pos] = True
            pos = pos - self.lengths[last[pos]]
            more = pos >= low
            pos, low = pos[more], low[more]
        made = np.cumsum(np.concatenate([[0], on]))
        ids = last[on]
        cut = made[np.concatenate([start, [len(code)]])].tolist()
        data = ids.astype("<u4").tobytes()
        out = [data[4 * x : 4 * y] for x, y in itertools.pairwise(cut)]
        for j in np.unique(np.searchsorted(cut, np.flatnonzero(ids >= n), "right") - 1).tolist():
            bytes_of = lambda x: [self.bytes[b] for b in chr(x - n).encode()] if self.bytes else [self.unknown]
            out[j] = np.array([i for x in ids[cut[j] : cut[j + 1]].tolist() for i in ([x] if x < n else bytes_of(x))], dtype="<u4").tobytes()
        return out

    def normalise(self, text: str) -> str:
        return (SPACE if self.front and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), "<u4").tolist()

    def encoded(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers."""
        return self.encoded_many([text])[0]

    def _cut(self, text: str) -> list[str]:
        # cut before each run of spaces; "x y" has parts "x" and " y"
        text = self.rules(text)
        if not text:
            return []
        if self.cuts and self.front and "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text:
            return [SPACE + w for w in text.split(" ")]
        whole = self.normalise(text)
        return [c for c in CUT.split(whole) if c] if self.cuts else [whole]

    def encoded_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as unsigned 32-bit integers."""
        out: list[bytes] = []
        a = 0
        while a < len(texts):
            e, room = a + 1, TOGETHER - len(texts[a])
            while e < len(texts) and len(texts[e]) <= room:
                room -= len(texts[e])
                e += 1
            out += self._encoded([self._cut(x) for x in texts[a:e]])
            a = e
        return out

    def _encoded(self, cuts: list[list[str]]) -> list[bytes]:
        known = self.parts
        if len(known) > MEMORY:  # the first are the frequent ones
            self.parts = known = dict(itertools.islice(known.items(), MEMORY // 2))
        new = set(itertools.chain.from_iterable(cuts)).difference(known)
        short = [c for c in new if len(c) <= SHORT] if self.merges else []
        if short:
            known.update(zip(short, self.compose_many(short), strict=True))
        for c in new:
            if c not in known:
                known[c] = np.array(self.compose(c), dtype="<u4").tobytes()
        made = [b"".join(map(known.__getitem__, cut)) for cut in cuts]
        return made if self.bytes else [self._once(x) for x in made]

    def _once(self, ids: bytes) -> bytes:
        """Unknown pieces in a row are one."""
        x = np.frombuffer(ids, "<u4")
        return x[np.append(True, (x[1:] != self.unknown) | (x[:-1] != self.unknown))[: len(x)]].tobytes()

    def decode(self, ids: list[int]) -> str:
        out = self.output
        text = b"".join([out[k] for k in ids]).decode("utf-8", "replace")
        return text[1:] if self.front and text.startswith(" ") else text


CUT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
_compiled: dict = {}


def compile_model(path: str) -> Transducer:
    """The model's transducer; a worker compiles it once."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", digested: bool = False) -> DataFrame:
    """docs with the ids of the text, and if asked with the columns of digest(), made in the same pass."""
    prepare(docs.sparkSession)

    def make():
        t = compile_model(model)

        def run(b):
            made = t.encoded_many([x or "" for x in b.column(b.schema.names.index(text)).to_pylist()])
            at = np.cumsum([0, *(len(x) // 4 for x in made)]).astype("<i4")
            out = {ids: pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(made), "<i4")))}
            return out | {"n_pieces": np.diff(at).astype(np.int64), "ids_crc32": [zlib.crc32(x) for x in made]}

        return run

    return append(docs, [field(ids, "array<int>"), *([long("n_pieces"), long("ids_crc32")] if digested else [])], make)


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for; null ids decode to an empty text."""
    prepare(docs.sparkSession)

    def make():
        t = compile_model(model)

        def run(b):
            x = b.column(b.schema.names.index(ids))
            at, flat = x.offsets.to_pylist(), x.values.to_numpy(zero_copy_only=False).tolist()
            return {text: [t.decode(flat[a:e] if e > a else []) for a, e in itertools.pairwise(at)]}

        return run

    return append(docs, [field(text, "string")], make)


def digest(docs: DataFrame, ids: str = "ids") -> DataFrame:
    """docs with n_pieces and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def make():
        def run(b):
            x = b.column(b.schema.names.index(ids))
            flat, at = x.values.to_numpy(zero_copy_only=False).astype("<u4"), x.offsets.to_numpy()
            return {"n_pieces": np.diff(at).astype(np.int64), "ids_crc32": [zlib.crc32(flat[a:e].tobytes()) for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]}

        return run

    return append(docs, [long("n_pieces"), long("ids_crc32")], make)


def op1_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, digested=True), model)
    shown = F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" "))
    return out.select("doc_id", "n_pieces", "ids_crc32", (F.col("decoded") == shown).alias("round_trip"), F.sha2("decoded", 256).alias("decoded_sha256"))
