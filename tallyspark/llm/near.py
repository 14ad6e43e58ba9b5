"""Near-duplicate groups by a multi-index Hamming join of b-bit signatures, with an exact check of every link.

A document's set holds the hashes of its distinct shingles of `width` words (the whole text, if it has fewer). Documents with
equal sets are one class. A class's signature has CHUNKS * WIDE symbols of 16 bits, one minimum hash each. By pigeonhole,
signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols agree, in some chunk, on all but ERRORS symbols; each class
is indexed under every choice of WIDE - ERRORS symbols of every chunk, so all such pairs meet in a bucket. (At similarity 0.8 a
pair misses every bucket with a probability of about 2e-6.)

A bucket never gives all its pairs. First each class is linked with its bucket's smallest class; links whose signatures are
near enough are checked on the full sets, and make components. Only buckets of three or more classes that still hold several
components are searched further, and there only classes outside the bucket's largest component meet others: these and the largest
component are dealt to parts of about BLOCK classes and BLOCK_BYTES of sets, and blocks are made of two parts each, so the largest
component's classes are never dealt out against one another. Of the many buckets that a pair shares, only the first checks it, and
only if signatures and set sizes allow the threshold.

Whether a document or key can matter is looked up in bitmaps of bounded size, so texts and keys that can't aren't shuffled.

Defined results: null and empty texts have empty sets and are linked with nothing; every row is a node, also rows that share a
doc_id, and takes the smallest doc_id of its component's rows; a null doc_id is never the smallest (a component of such rows alone
has a null id, and its rows aren't kept by `groups`); extra columns are ignored. `deduplicate` keeps one row of each component: that
of the smallest doc_id, nulls last, and of repeated rows any one; rows with empty sets all stay, and all columns, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, append, batches_of, emit, field, hashed_words, mixed, prepare, skew_join, stored, table

CHUNKS, WIDE, ERRORS, BLOCK, BLOCK_BYTES = 10, 5, 1, 1000, 4 << 20
SYMBOLS = CHUNKS * WIDE
#: Pairs at 0.8 differ in 10 of 50 symbols on average; more than 26 has a probability of under 1e-6.
FAR = 26
#: Most bits of a bitmap (32 MB); it has 32 bits a value as far as that allows.
BITS = 28

_random = np.random.default_rng(20240607)
FACTORS = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
#: Which symbols of the signature make each key.
PICKS = np.array([[c * WIDE + k for k in pick] for c in range(CHUNKS) for pick in itertools.combinations(range(WIDE), WIDE - ERRORS)])
EACH = len(PICKS) // CHUNKS


def shingle_sets(texts: pa.Array, width: int):
    """For each text the sorted distinct 64-bit hashes of its shingles. A-Z are lower-cased; words are parted by ASCII white space."""
    for _, _, x, counts in hashed_words(texts):
        k = min(width, len(x))
        whole = np.zeros(max(0, len(x) - k + 1), dtype=np.uint64)
        for j in range(k):
            whole = mixed(whole * MIX + x[j : len(x) - k + 1 + j])
        whole += np.uint64(width)
        ends = np.cumsum(counts)
        for a, e in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            if e - a >= width:
                made = np.sort(whole[a : e - width + 1])
                yield made[np.concatenate([[True], made[1:] != made[:-1]])]
            elif e == a:
                yield np.empty(0, np.uint64)
            else:  # the whole sequence
                made = np.zeros(1, dtype=np.uint64)
                for j in range(a, e):
                    made = mixed(made * MIX + x[j])
                yield made + np.uint64(e - a)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS minimum hashes of 16 bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(hashes), 2000):
        least = np.minimum(least, (hashes[a : a + 2000, None] * FACTORS + SHIFTS).min(axis=0))
    return (mixed(least) >> np.uint64(48)).astype("<u2")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """A row of index keys for each signature."""
    x = np.zeros((len(signatures), len(PICKS)), dtype=np.uint64) + np.arange(1, len(PICKS) + 1, dtype=np.uint64)
    for k in range(PICKS.shape[1]):
        x = mixed(x * MIX + signatures[:, PICKS[:, k]].astype(np.uint64))
    return (x >> np.uint64(1)).view(np.int64)


def _bitmap(values: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of a column of longs, by its low bits, as bytes: 2**BITS / 8 of them at most, whatever the data."""
    size = 1 << min(BITS, max(20, (32 * values.count()).bit_length()))
    v = F.col(column).bitwiseAND(F.lit(size - 1)) + 1
    got = values.select(F.bitmap_bucket_number(v).alias("b"), F.bitmap_bit_position(v).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    bits = np.zeros(size >> 3, dtype=np.uint8)
    for r in got.collect():  # at most size / 32768 rows of 4 KB
        a = (r["b"] - 1) * 4096
        bits[a : a + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)[: len(bits) - a]
    return bits


def _hit(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & ((len(bits) << 3) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _row_key(doc_id: str, text: str):
    """128 bits of a row's id and text, as two longs."""
    return F.xxhash64(F.lit(1), doc_id, text).alias("rk"), F.xxhash64(F.lit(2), doc_id, text).alias("rk2")


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, rk, rk2, n_shingles, same (hash of the set, null if empty), sig."""

    def make():
        def run(batches):
            for b in batches:
                n, same, sig = [], [], []
                for s in shingle_sets(b.column(3), width):
                    n.append(len(s))
                    same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield {"doc_id": b.column(0), "rk": b.column(1), "rk2": b.column(2), "n_shingles": n, "same": same, "sig": sig}

        return run

    return emit(docs, "doc_id long, rk long, rk2 long, n_shingles long, same binary, sig binary", make)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, shingles for the wanted classes (id, same, rk of some row)."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("rk"), "rk"))

    def make():
        def run(batches):
            for b in batches:
                at = np.flatnonzero(_hit(bits.value, b.column(0).to_numpy()))
                for k in range(0, len(at), 100):
                    made = [x.tobytes() for x in shingle_sets(b.column(1).take(pa.array(at[k : k + 100])), width)]
                    yield {"same": [xxhash.xxh3_128_digest(x) for x in made], "shingles": made}

        return run

    found = emit(docs.select("rk", "text"), "same binary, shingles binary", make)
    return found.join(wanted.select("id", "same"), "same").dropDuplicates(["id"]).select("id", "shingles")


def _near(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose signatures differ in at most FAR symbols."""
    met = skew_join(skew_join(pairs, sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a"), sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")

    def make():
        def run(batches):
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, SYMBOLS) for k in (2, 3))
                at = np.flatnonzero((x != y).sum(axis=1) <= FAR)
                yield {"a": b.column(0).to_numpy()[at], "b": b.column(1).to_numpy()[at]}

        return run

    return emit(met.select("a", "b", "sa", "sb"), "a long, b long", make)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets have 100 * intersection >= percent * union."""
    met = skew_join(skew_join(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a"), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")

    def make():
        def run(batches):
            for b in batches:
                keep = []
                for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                    if _alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent):
                        keep.append(k)
                yield {"a": b.column(0).to_numpy()[keep], "b": b.column(1).to_numpy()[keep]}

        return run

    return emit(met.select("a", "b", "sa", "sb"), "a long, b long", make)


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _owned(equal: np.ndarray, key: int) -> np.ndarray:
    """Whether `key` is the first of the keys that pairs share; equal: a row of agreeing symbols for each pair."""
    agree = equal.reshape(len(equal), CHUNKS, WIDE)
    shared = agree.sum(axis=2) >= WIDE - ERRORS
    chunk = shared.argmax(axis=1)
    own = agree[np.arange(len(equal)), chunk]
    picks = np.stack([own[:, PICKS[j]].all(axis=1) for j in range(EACH)], axis=1)
    return chunk * EACH + picks.argmax(axis=1) == key


def _searched(percent: int):
    """Links between different components of a block, checked on the full sets; a pair whose components a link of the block
    joins already needs none, so a block gives fewer links than it has components."""

    def run(batches):
        for b in batches:
            for key, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([r["id"] for r in rows], dtype=np.int64)
                sig = np.frombuffer(b"".join(r["sig"] for r in rows), "<u2").reshape(-1, SYMBOLS)
                sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
                size = np.array([len(x) for x in sets], dtype=np.int64)
                side = np.array([r["side"] for r in rows])  # 0: the block's rest, 1: others, 2: the rest of a block by itself
                c = np.array([r["component"] for r in rows], dtype=np.int64)
                found: list[tuple[int, int]] = []
                for k in np.flatnonzero(side != 1).tolist():
                    later = np.arange(len(rows)) > k
                    at = np.flatnonzero((c != c[k]) & np.where(side == side[k], later & (side == 2), True))
                    at = at[100 * np.minimum(size[at], size[k]) >= percent * np.maximum(size[at], size[k])]
                    equal = sig[at] == sig[k]
                    close = equal.sum(axis=1) >= SYMBOLS - FAR
                    at, equal = at[close], equal[close]
                    for j in at[_owned(equal, key)].tolist():
                        if c[j] != c[k] and _alike(sets[k], sets[j], percent):
                            c[c == c[j]] = c[k]
                            found.append((int(ids[k]), int(ids[j])))
                yield {"a": [x for x, _ in found], "b": [y for _, y in found]}

    return run


def _blocks(left: DataFrame) -> DataFrame:
    """key, p, q, own, other, side ..: left's rows, dealt to blocks. left has key, id, component, size (of the set) and rest (not in the
    bucket's largest component). Rows: those of the largest component once for each part of the rest, of the rest once for every part."""
    part = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(8 * F.col(size) / BLOCK_BYTES), F.lit(1)).cast("int")
    sums = left.groupBy("key").agg(F.count(F.when(F.col("rest"), 1)).alias("nr"), F.count(F.when(~F.col("rest"), 1)).alias("nm"), F.coalesce(F.sum(F.when(F.col("rest"), F.col("size"))), F.lit(0)).alias("sr"), F.coalesce(F.sum(F.when(~F.col("rest"), F.col("size"))), F.lit(0)).alias("sm"))
    parts = stored(sums.select("key", part("nr", "sr").alias("rs"), part("nm", "sm").alias("ms")), "parts")
    met = skew_join(left, parts, "key")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("rs")).otherwise(F.col("ms"))).cast("int")
    # blocks (j, m): part j of the rest with part m of the largest component (m >= 0), or with part -1 - m of the rest (m < 0)
    rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("ms") - 1), lambda m: F.struct(F.col("own").alias("j"), m.alias("m"), F.when(m == 0, 2).otherwise(0).alias("side"))),
        F.filter(F.transform(F.sequence(F.lit(0), F.col("rs") - 1), lambda j: F.struct(F.least(j, "own").alias("j"), (-1 - F.greatest(j, F.col("own"))).alias("m"), F.when(j < F.col("own"), 1).otherwise(0).alias("side"))), lambda x: x["j"] != -1 - x["m"]),
    )
    main = F.transform(F.sequence(F.lit(0), F.col("rs") - 1), lambda j: F.struct(j.alias("j"), F.col("own").alias("m"), F.lit(1).alias("side")))
    return met.withColumn("own", own).withColumn("at", F.explode(F.when(F.col("rest"), rest).otherwise(main))).select("key", "pick", "id", "component", F.col("at.j").alias("j"), F.col("at.m").alias("m"), F.col("at.side").alias("side"))


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of links (a, b). Every round each node points at its smallest neighbour, if
    that is smaller; pointers are followed to their roots by doubling, and links contract to the roots. Two rounds at least halve the
    number of nodes that still have links, so a chain of n nodes takes about log n tables, whatever its ids."""
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "parents")
        as_ = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))  # noqa: E731, B023
        while not (far := up.alias("x").join(up.where("node <> up").alias("y"), F.expr("x.up = y.node"), "left_semi")).isEmpty():  # some pointer's end points on
            del far
            up = stored(skew_join(up, as_("up"), "up").select("node", F.col("up_up").alias("up")), "parents")
        labels = stored(skew_join(labels, as_("component"), "component", "left").select("node", F.coalesce("up_component", "component").alias("component")), "labels")
        moved = skew_join(skew_join(edges, as_("a"), "a"), as_("b"), "b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
        edges = stored(moved.where("a <> b").distinct(), "links")
    return labels


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, rk, rk2, n_shingles, same, component (null for empty sets), least (smallest doc_id of the component) for every row of
    docs (doc_id, text as bytes, rk, rk2)."""
    with batches_of(docs.sparkSession):
        return _searched_groups(docs, width, percent)


def _searched_groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    every = stored(_sketches(docs.select("doc_id", "rk", "rk2", "text"), width), "sketches")
    classes = stored(every.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk"), F.min("sig").alias("sig")).withColumn("id", F.monotonically_increasing_id()), "classes")
    sigs = classes.select("id", "sig")

    def keys(some: DataFrame, bits=None) -> DataFrame:
        def make():
            def run(batches):
                for b in batches:
                    k = keys_of(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS)) if b.num_rows else np.empty((0, len(PICKS)), np.int64)
                    ids, pick, k = np.repeat(b.column(0).to_numpy(), k.shape[1]), np.tile(np.arange(k.shape[1], dtype=np.int32), len(k)), k.ravel()
                    if bits is not None:
                        at = _hit(bits.value, k)
                        ids, pick, k = ids[at], pick[at], k[at]
                    yield {"key": k, "pick": pick, "id": ids}

            return run

        return emit(some.select("id", "sig"), "key long, pick int, id long", make)

    shared = stored(keys(sigs).groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("n")).where("hub <> last"), "buckets")
    bits = sc.broadcast(_bitmap(shared, "key"))
    rows = stored(skew_join(stored(keys(sigs, bits), "keys"), shared.select("key", "hub", "n"), "key"), "bucket-rows")
    stars = stored(rows.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    near = stored(_near(stars, sigs), "near")
    wanted = lambda ids: stored(classes.select("id", "same", "rk").join(ids, "id", "left_semi"), "ids")
    sets = stored(_sets(docs, wanted(near.select(F.explode(F.array("a", "b")).alias("id"))), width), "sets")
    with batches_of(docs.sparkSession, 50):  # a row holds two sets
        links = stored(_confirmed(near, sets, percent), "confirmed")
    first = components(links)

    # buckets of three or more that still hold several components
    many = stored(rows.where("n > 2").select("key", "pick", "id"), "large")
    label = first.select(F.col("node").alias("id"), "component")
    many = stored(many.join(label, "id", "left").select("key", "pick", "id", F.coalesce("component", "id").alias("component")), "large")
    open_ = many.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    left = stored(skew_join(many, stored(open_, "open"), "key"), "open-rows")
    if not left.isEmpty():
        sizes = left.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
        found = stored(_sets(docs, wanted(left.select("id")), width).join(sigs, "id"), "sets")
        left = stored(skew_join(left, stored(sizes, "main"), "key").select("key", "pick", "id", "component", (F.col("component") != F.col("main")).alias("rest")), "open-rows")
        left = stored(skew_join(left, found.select("id", F.expr("octet_length(shingles) / 8").cast("long").alias("size")), "id"), "open-rows")
        dealt = stored(_blocks(left), "dealt")
        full = skew_join(dealt, found, "id").groupBy("key", "pick", "j", "m").agg(F.collect_list(F.struct("id", "component", "side", "sig", "shingles")).alias("rows"))
        with batches_of(docs.sparkSession, 1):
            more = stored(emit(full.select("pick", "rows"), "a long, b long", lambda: _searched(percent)).distinct(), "more")
        first = components(links.unionByName(more))
    told = stored(classes.select("id", "same", "least").join(first.select(F.col("node").alias("id"), "component"), "id", "left").select("same", "least", F.coalesce("component", "id").alias("component")), "told")
    told = stored(skew_join(told.select("same", "component"), told.groupBy("component").agg(F.min("least").alias("least")), "component"), "told")
    cols = ("doc_id", "rk", "rk2", "n_shingles", "same", "component", "least")
    out = skew_join(every.where(F.col("same").isNotNull()), told, "same", "left").select(*cols)
    return out.unionByName(every.where(F.col("same").isNull()).select("doc_id", "rk", "rk2", "n_shingles", "same", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("least")))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return named.select("doc_id", "text", *_row_key("doc_id", "text"))


def groups(docs: DataFrame, width: int = 2, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept for every document."""
    out = _grouped(_keyed(docs, doc_id, text), width, percent)
    return out.select("doc_id", "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("least"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, and all rows with empty sets. Only rows whose key hits a bitmap of keys to go are
    shuffled."""
    told = stored(_grouped(_keyed(docs, doc_id, text), width, percent).where(F.col("same").isNotNull()).select("doc_id", "rk", "rk2", "component"), "groups")
    best = told.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "rk2")).alias("w"), F.count("*").alias("n")).where("n > 1")
    best = stored(best.select("component", F.col("w.rk").alias("wk"), F.col("w.rk2").alias("wk2")), "stays")
    lost = stored(skew_join(told, best, "component").where("rk <> wk or rk2 <> wk2").select("rk", "rk2").distinct(), "going")
    again = stored(told.groupBy("rk", "rk2").agg(F.count("*").alias("n")).where("n > 1").select("rk", "rk2"), "repeated")
    bits = prepare(docs.sparkSession).sparkContext.broadcast(_bitmap(lost.select("rk").unionAll(again.select("rk")), "rk"))

    def make():
        return lambda b: {"maybe": _hit(bits.value, b.column(b.schema.names.index("rk")).to_numpy())}

    cols = docs.columns
    rows = docs.select(F.struct(*cols).alias("row"), *_row_key(F.col(doc_id).cast("long"), F.col(text).cast("binary")))
    marked = append(rows, [field("maybe", "boolean")], make)
    some = stored(marked.where("maybe").select("row", "rk", "rk2"), "maybe").join(lost, ["rk", "rk2"], "left_anti")
    some = stored(some, "maybe")
    once = some.join(again, ["rk", "rk2"], "left_semi").dropDuplicates(["rk", "rk2"])
    return marked.where("not maybe").select("row.*").unionByName(some.join(again, ["rk", "rk2"], "left_anti").select("row.*")).unionByName(once.select("row.*"))


def op10_near(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), width=2)


OP10_SQL = """
with recursive d as (select row_number() over () as r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct r, w[k : k + 1] as x from d, unnest(range(1, greatest(2, len(w)))) t(k) where len(w) > 0),
n as (select r, count(*) as n from s group by r),
sets as (select min(r) as r, list(r) as rows from (select r, list(x order by x) as xs from s group by r) g group by xs),
p as (select a.r as a, b.r as b, count(*) as c from s a join s b on a.x = b.x and a.r < b.r where a.r in (select r from sets) and b.r in (select r from sets) group by a.r, b.r),
l as (select a, b from p join n x on x.r = a join n y on y.r = b where 100 * c >= 80 * (x.n + y.n - c)),
copies as (select r as a, unnest(rows) as b from sets),
e as (select a, b from l union select b, a from l),
reach(a, b) as (select r, r from sets union select reach.a, e.b from reach join e on reach.b = e.a),
top as (select reach.a as r, min(d.doc_id) as component_id from reach join copies on copies.a = reach.b join d on d.r = copies.b group by reach.a),
told as (select copies.b as r, component_id from top join copies on copies.a = top.r)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept
from d left join n using (r) left join told using (r)
"""
