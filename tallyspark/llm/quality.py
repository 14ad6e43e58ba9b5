"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (poor) and 2 (good). A text's features are its distinct words, the first few bytes of longer ones, runs of punctuation and a few shapes
(shares of capitals, signs and digits, repeated lines, line length, each in bins), hashed to 2**BITS weights that all thresholds
share: P(grade >= k) = sigmoid(w.x - threshold_k). The thresholds stay ordered; an L1 penalty clears weights of words that tell
nothing, so that a few telling words count in long texts too. The fit sees at most `rows` labelled rows, those with the smallest
hash of their id; scoring covers every row.

Defined results: a null text is empty and scored by its shape alone; labels that are null or have no document are ignored;
repeated rows are scored one by one; without labelled rows of two grades everything is accepted (p_good 1); columns with the
results' names are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, batches_of, emit, field, prepare, table

BITS, ROWS, LEAST_DF, PENALTY, PASSES, GRADES, HEADS = 22, 6000, 5, 5.0, 20, 3, (4, 5, 6, 7, 8)
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")
LETTERS, CAPITALS, DIGITS, BLANKS, BEYOND = bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\r\n", bytes(range(128, 256))
RESULTS = {"expected_grade": "double", "p_fair": "double", "p_good": "double", "accepted": "boolean"}


def heads(word: bytes) -> list[bytes]:
    """The first few bytes of longer words, as features."""
    return [b"\1" + word[:k] for k in HEADS if len(word) > k and word[0] > 1]


def shapes(text: bytes) -> list[bytes]:
    """The text's shape, in bins, as features."""
    n = max(1, len(text))
    count = lambda kind: len(text) - len(text.translate(None, kind))
    capitals, digits = count(CAPITALS), count(DIGITS)
    signs = len(text) - count(CAPITALS + DIGITS + LETTERS + BLANKS + BEYOND)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0
    parts = text.split()
    commonest = max(Counter(parts).values(), default=0)
    w = max(1, len(parts))
    shape = (("capitals", capitals / n), ("digits", digits / n), ("signs", signs / n), ("lines", repeated), ("top", commonest / w), ("width", len(text) / max(1, len(lines)) / 1000), ("size", w / 2000))
    return [b"\0%s %d" % (name.encode(), int(min(20, 2 * (share * 50) ** 0.5))) for name, share in shape]


def tokens(text: bytes) -> set[bytes]:
    """Distinct features as bytes; shapes start with a zero byte, heads of longer words with a one."""
    found = set(TOKEN.findall(text.lower()))
    return found.union(shapes(text), *map(heads, found))


def spot(token: bytes) -> int:
    return zlib.crc32(token) & ((1 << BITS) - 1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """weights: hashed feature -> weight; cuts: ordered thresholds."""

    def __init__(self, weights: dict[int, float], cuts: list[float]):
        self.weights, self.cuts = weights, cuts
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _weighing(self, features: list[bytes]) -> tuple[int, ...]:
        return tuple({x for f in features if (x := spot(f)) in self.weights})

    def score(self, text: bytes) -> float:
        """The sum of the weights of the text's distinct hashed features. Of a word, only the features that weigh something are
        remembered: the penalty leaves few."""
        known, found = self.known, set(self._weighing(shapes(text)))
        if len(known) > 500_000:
            known.clear()
        for t in set(TOKEN.findall(text.lower())):
            if (x := known.get(t)) is None:
                x = known[t] = self._weighing([t, *heads(t)])
            if x:
                found.update(x)
        return math.fsum(self.weights[x] for x in found)

    def tails(self, text: bytes) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        s = self.score(text)
        return [float(sigmoid(s - c)) for c in self.cuts]


def fit(spots: list[np.ndarray], grades: np.ndarray, penalty: float = PENALTY, passes: int = PASSES, batch: int = 64, pace: float = 0.3) -> Model:
    """Follow-the-regularised-leader with an L1 penalty over shuffled batches; thresholds move with the weights and stay ordered."""
    n = len(spots)
    if n == 0 or len(np.unique(grades)) < 2:
        return Model({}, [-40.0] * (GRADES - 1))
    used, flat = np.unique(np.concatenate(spots), return_inverse=True)
    keep = np.bincount(flat) >= LEAST_DF
    ends = np.cumsum([len(x) for x in spots])
    rows = [x[keep[x]] for x in np.split(flat, ends[:-1])]
    z, squares, w = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    share = np.array([np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, GRADES)])
    cuts, moved = -np.log(share / (1 - share)), np.ones(GRADES - 1)
    random = np.random.default_rng(7)
    for _ in range(passes):
        for some in np.array_split(random.permutation(n), max(1, n // batch)):
            at, y = np.concatenate([rows[k] for k in some]), grades[some]
            row = np.repeat(np.arange(len(some)), [len(rows[k]) for k in some])
            f = np.bincount(row, weights=w[at], minlength=len(some))
            below = np.where(y > 0, sigmoid(cuts[np.maximum(y - 1, 0)] - f), 0.0)  # P(grade < y)
            upto = np.where(y < GRADES - 1, sigmoid(cuts[np.minimum(y, GRADES - 2)] - f), 1.0)  # P(grade <= y)
            mass = np.maximum(upto - below, 1e-6)
            rise = np.array([((y == k) * upto * (1 - upto) / mass - (y == k + 1) * below * (1 - below) / mass).sum() for k in range(GRADES - 1)])
            moved += rise**2
            cuts = np.maximum.accumulate(cuts + 0.1 * rise / np.sqrt(moved) + np.arange(GRADES - 1) * 1e-4)
            grad = np.bincount(at, weights=(1 - below - upto)[row], minlength=len(used))
            touched = np.flatnonzero(grad)
            g = grad[touched]
            more = squares[touched] + g * g
            z[touched] += g - (np.sqrt(more) - np.sqrt(squares[touched])) / pace * w[touched]
            squares[touched] = more
            zt = z[touched]
            w[touched] = -np.sign(zt) * np.maximum(np.abs(zt) - penalty, 0) / ((1 + np.sqrt(more)) / pace)
    at = np.flatnonzero(w)
    return Model({int(used[k]): float(w[k]) for k in at}, cuts.tolist())


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = ROWS) -> Model:
    """A model from at most `rows` labelled rows; their hashed features reach the driver, not their texts."""
    graded = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(F.col(doc_id).alias("doc_id"), F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))
    ids = docs.select(F.col(doc_id).alias("doc_id")).distinct()  # labels without a document push none out
    some = graded.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(rows)
    met = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t")).join(F.broadcast(some), "doc_id")

    def make():
        def run(batches):
            for b in batches:
                yield {"doc_id": b.column(0), "grade": b.column(2), "spots": [np.unique(np.fromiter(map(spot, tokens(t or b"")), dtype="<i4")).tobytes() for t in b.column(1).to_pylist()]}

        return run

    with batches_of(docs.sparkSession):
        got = emit(met, "doc_id long, grade int, spots binary", make).orderBy(F.xxhash64("doc_id"), "doc_id", "grade", "spots").limit(rows).collect()
    return fit([np.frombuffer(r["spots"], "<i4") for r in got], np.array([r["grade"] for r in got], dtype=np.int64))


def classify(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with expected_grade, p_fair (grade 1 or more), p_good (grade 2) and accepted (p_good at least `least`)."""
    told = prepare(docs.sparkSession).sparkContext.broadcast((model.weights, model.cuts))

    hidden = next(n for n in ("_bytes", "_bytes_", "_bytes__") if n not in docs.columns)

    def make():
        m = Model(*told.value)

        def run(b):
            tails = [m.tails(x or b"") for x in b.column(b.schema.names.index(hidden)).to_pylist()]
            return {"expected_grade": [sum(x) for x in tails], "p_fair": [x[0] for x in tails], "p_good": [x[-1] for x in tails], "accepted": [x[-1] >= least for x in tails]}

        return run

    return append(docs.withColumn(hidden, F.col(text).cast("binary")), [field(*x) for x in RESULTS.items()], make).drop(hidden)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")
