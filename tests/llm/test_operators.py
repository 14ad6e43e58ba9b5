"""The operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, licenses, lm, near, pieces, quality, secrets, sharding, topk, wavelet

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words long"


@pytest.fixture(scope="session")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{D}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and long texts, repeated rows, a clashing column."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, None, "en", "a", 1), (2, "", "en", None, 2), (3, long, None, "a", 3), (4, "one two", "en", "a", None), (4, "one two", "en", "a", None), (None, "x password: abcdef12 y", "en", "b", 5), (6, "x password: abcdef12 y", "en", "c", 6), (7, " " * 50, "en", "c", 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontaminate(spark, texts, odd, none):
    items = duckdb.sql(f"select item_id, text from '{D}/benchmark.parquet'").fetchall()
    got = {r["doc_id"]: r for r in decontaminate.op3_decontaminate(spark, D).collect()}
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
        assert tuple(got[i][1:]) == want, i
    bench = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None), (None, "one"), (3, "")], "item_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(odd, bench, block_words=1).collect())
    assert (4, 2, 2, ["1"], True) in rows and (1, 0, 0, [], False) in rows and (3, 30000, 0, [], False) in rows and len(rows) == 8
    assert decontaminate.decontaminate(none, bench).count() == 0
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{D}/documents.parquet'; create view benchmark as select * from '{D}/benchmark.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(tuple(r[k] for k in cols) for r in got.values()) == sorted(c.sql(f"select {', '.join(cols)} from ({decontaminate.OP3_SQL})").fetchall())
    clash = odd.withColumns({"_bytes": F.lit(1), "hits": F.lit(2), "_bytes_": F.lit(3)})
    assert decontaminate.decontaminate(clash, bench).where("contaminated").count() == 2 and "_bytes" in decontaminate.decontaminate(clash, bench).columns
    assert decontaminate.decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0


def test_decontaminate_frequent_prefix_tokens(monkeypatch):
    """Few words that make many windows each: all occurrences, whatever the number of candidates verified together."""
    r = random.Random(3)
    make = lambda n: " ".join(r.choices("abc", k=n)).encode()
    hashed = lambda t: decontaminate.word_hashes(np.frombuffer(t, np.uint8), np.array([len(t)]), decontaminate.WORDS)[0]
    items, docs = [make(r.randrange(1, 40)) for _ in range(60)], [make(r.randrange(1, 200)) for _ in range(30)]
    known = np.unique(hashed(b"a b c"))
    found = decontaminate.index([(str(k), hashed(t)) for k, t in enumerate(items)], known, np.array([3, 1, 2]), 4)
    windows = {tuple(w[k : k + 4]) for w in (t.split() for t in items) for k in range(max(1, len(w) - 3))}
    want = sorted((d, k, k + n) for d, w in enumerate(t.split() for t in docs) for n in (1, 2, 3, 4) for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows)
    x, ends = np.concatenate([hashed(t) for t in docs]), np.cumsum([len(t.split()) for t in docs])
    for size in (1, 7, 1000, 10**6):
        monkeypatch.setattr(decontaminate, "CANDIDATES", size)
        doc, a, e, _ = decontaminate.matches(found, x, ends)
        assert sorted(zip(doc.tolist(), a.tolist(), e.tolist(), strict=True)) == want


def test_topk(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{D}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op5_topk(spark, D).collect())) == sorted(c.sql(topk.OP5_SQL).fetchall())
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, [1.0, 5.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.search(df, df["vec_id"] < 2, k=2, block=1).collect()]
    assert sorted(got) == [(0, 1, 1, 65536), (0, 2, 2, 65536), (1, 1, 0, 65536), (1, 2, 2, 65536)]
    assert topk.search(df.limit(0), df["vec_id"] < 2).count() == 0


def base_spans(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate((("assign", secrets.ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{e}" for a, _, e, kind in sorted(out))


def test_secrets(spark, texts, odd, none):
    got = {r["doc_id"]: r for r in secrets.op6_secrets(spark, D).collect()}
    assert all(got[i]["base_sha256"] == hashlib.sha256(base_spans(t).encode()).hexdigest() for i, t in texts.items())
    token = "Ab3" + "xY9kQ" * 5
    more = spark.createDataFrame([(10, f"é {token} z", "en", "a", 0), (11, f"q {token[::-1]}", "en", "a", 0), (12, f"q {token[::-1]}", "en", "b", 0)], SCHEMA)
    rows = {r["doc_id"]: r for r in secrets.scan(odd.unionByName(more)).collect()}
    assert [(s["start"], s["end"]) for s in rows[10]["added"]] == [(2, 30)] and not rows[11]["added"] and rows[6]["n_example"] == 1
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(odd.unionByName(more)).collect()}
    assert clean[6] == "x [SECRET] y" and clean[10] == "é [SECRET] z" and clean[1] is None and clean[4] == "one two"
    assert secrets.scan(none).count() == 0


def test_near(spark, texts, odd, none):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    got = {r["doc_id"]: tuple(r)[1:] for r in near.op10_near(spark, D).collect()}
    assert got == {i: (len(x), top(i), top(i) == i) for i, x in sets.items()}
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.groups(odd).collect()]
    assert (1, 0, 1) in rows and (2, 0, 2) in rows and rows.count((4, 1, 4)) == 2 and (None, 3, 6) in rows and len(rows) == 8
    assert near.groups(none).count() == 0


def test_near_chain_of_many(spark):
    """A dense group whose members aren't all like the first one."""
    random.seed(3)
    base, rows = [f"t{k}" for k in range(120)], []
    for k in range(60):
        w = [f"t{j}" for j in range(k, k + 120)]
        rows.append((k, " ".join(w), "en", "a", 0))
    random.shuffle(rows)
    got = near.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0} and len(base) == 120


def test_lm(spark, texts, odd, none, tmp_path):
    got = {r["doc_id"]: r for r in lm.op8_lm(spark, D).collect()}
    token = {i: t.encode().lower().split() + [b" end"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, t in token.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in token.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])
    # the score by hand: bigrams smoothed by a unigram with absolute discount, stored in steps of 1 / GRID of log10
    pair = collections.Counter(x for i, t in token.items() if not held[i] for x in zip([None, *t], t, strict=False))
    uses = c | collections.Counter({None: sum(not h for h in held.values())})
    ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
    d = ones / (ones + 2 * twos)
    p1 = lambda w: (c[w] - d) / n if c[w] else d * v / n / (v + 1)
    for i, t in token.items():
        want = [math.log10((pair[u, w] + lm.PRIOR * p1(w)) / (uses[u] + lm.PRIOR)) for u, w in zip([None, *t], t, strict=False)]
        known = sum(pair[x] > 0 for x in zip([None, *t], t, strict=False))
        assert abs(got[i]["score"] - sum(want)) <= known / (2 * lm.GRID) + 1e-6 * len(t)
    rows = lm.score(odd, chunk_tokens=10, model_path=str(tmp_path / "model")).collect()
    assert len(rows) == 8 and all(r["score"] < 0 for r in rows)
    by = {(r["doc_id"], r["n_tokens"]): r for r in rows}
    assert by[1, 1]["held_out"] is (zlib.crc32(b"1") % 7 == 2) and by[None, 5]["held_out"] is False and by[2, 1]["n_known"] == 1
    assert by[3, 30_001]["n_tokens"] == 30_001 and by[1, 1]["score"] == by[2, 1]["score"] == by[7, 1]["score"]
    assert [r["score"] for r in rows if r["doc_id"] == 4][0] == [r["score"] for r in rows if r["doc_id"] == 4][1]
    blob = spark.read.parquet(str(tmp_path / "model")).first()["trie"]
    (tmp_path / "trie").write_bytes(blob)
    mapped = lm.Trie.open(str(tmp_path / "trie"))
    at = np.arange(mapped.successors.n)
    rank = (mapped.successors.get(at) >> np.uint64(40)).astype(np.int64)
    words_, contexts = mapped.successors.get(at) & np.uint64((1 << 40) - 1), mapped.contexts.get(rank)
    assert mapped.successors.n > 0 and (mapped.look(contexts, np.ones(len(at), np.int64), words_) == mapped.codes).all()
    assert not mapped.look(contexts, np.ones(len(at), np.int64), words_ ^ np.uint64(1)).any()
    assert lm.score(none).count() == 0


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1 << 63), (2, 3), (1000, 1 << 20), (200_000, 1 << 40), (5000, 1 << 51)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    x = np.unique(r.integers(0, top, n, dtype=np.uint64)) if n != 1000 else np.unique(np.concatenate([r.integers(0, top, n, dtype=np.uint64), np.arange(5000, 6000, dtype=np.uint64)]))
    e = lm.EliasFano(lm.EliasFano.build(x))
    at = np.arange(len(x))
    assert e.n == len(x) and (e.get(at) == x).all() and (e.find(x) == at).all()
    asked = r.integers(0, 1 << 63, 3000, dtype=np.uint64) % np.uint64(min(2 * top, (1 << 64) - 1))
    there = dict(zip(x.tolist(), at.tolist(), strict=True))
    assert e.find(asked).tolist() == [there.get(int(v), -1) for v in asked]
    if len(x) > 10:
        assert (e.find(x, np.full(len(x), 3), np.full(len(x), 9)) == np.where((at >= 3) & (at < 9), at, -1)).all()


def encoded(encode, texts):
    """Ids of each text as lists."""
    import pyarrow as pa

    ids, n = encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_wavelet(spark, texts, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, got = 0, {r["doc_id"]: tuple(r)[1:] for r in wavelet.op9_wavelet(spark, D).collect()}
    for i in sorted(texts):
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = wavelet.write_files(odd, public_tokenizers.path("byte_bpe_50k.json"), file_tokens=100)
    assert wavelet.read_files(files).count() == 8 and wavelet.read_files(wavelet.write_files(none, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    x = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint32) ** 2
    w = wavelet.Wavelet(wavelet.Wavelet.build(x))
    assert (w.ids() == x).all() and all(w.access(k) == x[k] for k in (0, 511, 512, 4999))
    at = np.flatnonzero(x == x[7])
    assert w.count(int(x[7])) == len(at) and [w.find(int(x[7]), k) for k in range(len(at))] == at.tolist() and w.count(7) == 0
    enc = wavelet.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd_texts = ["".join(random.choice(" ae\n\t.é<") for _ in range(30)) for _ in range(500)]
    assert all(a == tok.encode(t, add_special_tokens=False).ids for a, t in zip(encoded(enc, odd_texts), odd_texts, strict=True))


def test_pieces(spark, texts, odd, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), pieces.compile_model(path)
    some = ["a  b", " a", "", "ﬁ Ⅳ\n\tx", "<s> <0x41>", "▁x", "aaaa " * 9, " " * 37 + "x", "日本語 🎉", *texts.values(), *("".join(random.choice(" abcth\n▁é日") for _ in range(40)) for _ in range(500))]
    assert all(t.encode(x) == sp.encode(x) and t.decode(t.encode(x)) == sp.decode(sp.encode(x)) for x in some)
    assert all(r["round_trip"] for r in pieces.op1_pieces(spark, D).collect())
    assert {len(r["ids"]) for r in pieces.encode(odd.where("doc_id < 3"), path).collect()} == {0} and pieces.encode(none, path).count() == 0


def test_sharding(spark, odd, none, tmp_path):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{D}/documents.parquet'")
    got = sharding.op2_sharding(spark, D)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, c.sql(f"select {', '.join(got.columns)} from ({sharding.OP2_SQL})").fetchall()))
    one = spark.createDataFrame([(1, "x" * 100, "en", "a", k) for k in range(40)], SCHEMA)
    sizes = collections.Counter()
    for r in sharding.plan(one, limit=300).collect():
        sizes[r["shard"]] += r["bytes"]
    assert max(sizes.values()) <= 300 and sum(sizes.values()) == 4000
    assert sharding.plan(odd, limit=100).count() == 8 and sharding.plan(none).count() == 0


@pytest.mark.parametrize("name", ["op6_secrets", "op10_near"])
def test_sql(spark, name):
    from tallyspark.llm import registry

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{D}/documents.parquet'")
    got = registry.QUERIES[name](spark, D)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"select {', '.join(got.columns)} from ({registry.SQL[name]})").fetchall())


def test_sql_of_planted_rows(spark, odd, tmp_path):
    """Ownership, weak spans, copies and chains that the driver's small tables lack."""
    from tallyspark.llm import registry

    live, copied, wide = "Ab3" + "xY9kQ" * 5, "Zq7" + "mN2pR" * 5, "Tt1" + "uV5wX" * 5
    chain = [" ".join(f"c{j}" for j in range(k, k + 60)) for k in range(0, 24, 3)]
    rows = [(20, f"é {live} z password = {live}", "en", "a", 0), (21, f"{live}", "fr", "a", 0), (22, copied, "en", "a", 0), (23, f"token:'{copied}'", "en", "b", 0), (24, "AKIA" + "Q7" * 10 + " " + "0af1" * 8, "en", "c", 0)]
    rows += [(30 + k, wide, x, "d", 0) for k, x in enumerate(("en", "fr", "de", "es"))] + [(50 + k, x, "en", "e", 0) for k, x in enumerate(chain)] + [(48, chain[5].upper(), "en", "e", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd.where("doc_id is not null"))
    docs.withColumnRenamed("n_words", "n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op6_secrets", "op10_near"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"select {', '.join(got.columns)} from ({registry.SQL[name]})").fetchall()), name
    said = {r["doc_id"]: r for r in registry.QUERIES["op6_secrets"](spark, str(tmp_path)).collect()}
    assert "token:2:30" in said[20]["spans"] and said[20]["n_live"] == 1 and said[22]["n_example"] == 1 and "token" not in said[22]["spans"] and said[30]["n_example"] == 1 and said[21]["spans"] == "token:0:28"


def test_sharding_writes_every_row(spark, odd, none, tmp_path, monkeypatch):
    """A round trip of the writer with null and repeated keys and clashing names, with and without a broadcast directory."""
    docs = odd.unionByName(spark.createDataFrame([(None, "y" * k, "en", None, k) for k in range(40)], SCHEMA)).withColumns({"h": F.lit(1), "h2": F.lit(2), "bytes": F.lit(3), "cell": F.lit("c"), "leaf": F.lit("l")})
    want = sorted(map(repr, (tuple(r) for r in docs.collect())))
    for most in (100_000, 0):
        monkeypatch.setattr(sharding, "DIRECTORY", most)
        told = sharding.write(docs, str(tmp_path / f"shards{most}"), limit=200)
        back = spark.read.parquet(str(tmp_path / f"shards{most}"))
        assert sorted(map(repr, (tuple(r) for r in back.select("row.*").collect()))) == want
        sizes = {r["shard"]: (r["bytes"], r["rows"]) for r in told.collect()}
        got = {r["shard"]: (r["b"], r["n"]) for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("row.text"), F.lit(0))).cast("long").alias("b"), F.count("*").alias("n")).collect()}
        assert got == sizes and all(b <= 200 or n == 1 for b, n in sizes.values())
    by_h = sharding.plan(docs, limit=200, key="h")
    assert by_h.columns == ["h", "bytes", "shard", "depth", "shard_bytes"] and by_h.count() == 48
    assert sharding.plan(docs, key="bytes").columns[0] == "key_bytes"
    assert sharding.write(none, str(tmp_path / "none")).count() == 0


def test_quality(spark, odd, none):
    train, test = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{train}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{train}/labels.parquet"))
    assert model.cuts == sorted(model.cuts)
    rows = quality.classify(spark.read.parquet(f"{test}/documents.parquet"), model).join(spark.read.parquet(f"{test}/labels.parquet"), "doc_id").collect()
    assert sum(r["accepted"] == (r["quality"] == 1 and r["toxic"] == 0) for r in rows) >= 0.85 * len(rows)
    assert quality.classify(odd, model).count() == 8 and quality.classify(none, model).count() == 0
    assert quality.classify(odd, quality.train(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).where("accepted").count() == 8


def test_licenses(spark, odd, none):
    rows = [(1, "word " * 9 + "\nLicensed under the Apache License, Version 2.0.", "a/b/1"), (2, "Released under the MIT License.", "a/LICENSE"), (3, "of the and with", "a/b/c/3"), (4, None, "z/4"), (5, "", None)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got[1]["licenses"] == ["Apache-2.0"] and got[1]["inherited"] == "MIT" and got[3]["inherited_from"] == "a" and got[3]["licenses"] == [] and got[4]["inherited"] is None and got[5]["inherited"] is None
    assert licenses.scan(none.withColumn("path", none["source"])).count() == 0


def test_pieces_composed_together():
    """Parts composed together, alone, and by the library give the same ids."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, t, r = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(path), random.Random(5)
    some = ["", " ", "  a  b ", "x" * 300, "né 漢字 \U0001f600 a▁b", "a\tb\nc"] + ["".join(r.choice("abst  eé漢\U0001f600▁\n") for _ in range(r.randrange(90))) for _ in range(1500)]
    for text, got in zip(some, t.encoded_many(some), strict=True):
        want = sp.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert [i for part in t._cut(text) for i in t.compose(part)] == want


def field_of(number, value):
    """A protocol buffer field: bytes, float or whole number."""
    import struct

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram(path, fallback, spec):
    """A model file of weighted pieces, written by hand."""
    r = random.Random(2)
    letters = "abcdeéstk▁"
    words = {*letters} | {"".join(r.choice(letters[:-1]) for _ in range(r.randrange(2, 6))) for _ in range(300)}
    words |= {"▁" + x for x in list(words)[:120] if not x.startswith("▁")}
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256) if fallback] + [(x, -r.randrange(1024, 12 * 1024) / 1024, 1) for x in sorted(words)]
    model = b"".join(field_of(1, field_of(1, x.encode()) + field_of(2, w) + field_of(3, kind)) for x, w, kind in pieces_)
    path.write_bytes(model + field_of(2, field_of(3, 1) + (field_of(35, 1) if fallback else b"")) + field_of(3, spec))


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc_cf"])
def test_pieces_with_weights(fallback, rule, tmp_path):
    """A unigram model: the shortest path by weight, with a rewriting normaliser, gives the library's ids."""
    import sentencepiece

    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=rule != "identity")
    spec = dict(pieces.fields(norm.serialized_model_proto()))[3]
    unigram(tmp_path / "m.model", fallback, spec)
    sp, t, r = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model")), pieces.compile_model(str(tmp_path / "m.model")), random.Random(6)
    assert not t.merges and bool(t.rules.units) == (rule != "identity")
    some = ["", " ", "  ab  ", "ab" * 40, "ﬁ ABÉ\tst\u00a0ａb", "①㍿ É", "x▁ ▁"] + ["".join(r.choice("aabbcdeéEstk  ▁xﬁＡ①\t\u3000e\u0301漢\U0001f600") for _ in range(r.randrange(60))) for _ in range(3000)]
    for text, got in zip(some, t.encoded_many(some), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == sp.encode(text), repr(text)


def test_licenses_of_real_files(spark):
    """Full licence texts, with a holder or wrapped anew, are licence files whose licence the files beside and below inherit."""
    full = {n: x[0] for n, x in licenses.full_texts().items()}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "ISC", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-3.0", "MPL-2.0"} <= set(full)
    rows = []
    for n, x in full.items():
        rows += [(f"{n}/LICENSE", "Copyright (c) 2019 Jane Roe and contributors\n\n" + x), (f"{n}/wrapped/LICENSE", "\n".join(x.split())), (f"{n}/src/a.py", "print(1)")]
    rows += [("none/a.py", "print(1)"), ("none/LICENSE", "the license of the work and of any " * 400)]
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert all(got[f"{n}/{f}"]["file_license"] == n for n in full for f in ("LICENSE", "wrapped/LICENSE"))
    assert all((got[f"{n}/src/a.py"]["inherited"], got[f"{n}/src/a.py"]["inherited_from"]) == (n, n) for n in full)
    assert got["none/a.py"]["inherited"] is None and got["none/LICENSE"]["file_license"] is None
    own = licenses.scan(spark.createDataFrame(rows, "path string, text string"), templates={"X": ["one two three"]}).collect()
    assert all(r["file_license"] is None for r in own)


def test_wavelet_gaps_of_other_white_space():
    """Tabs, CR and no-break spaces in one gap don't make up for several spaces in another."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("byte_bpe_50k.json"), random.Random(9)
    tok, enc = Tokenizer.from_file(path), wavelet.encoder(path)
    some = ["le mot" + " \u00a0 \u00a0 " + "dit\u00a0: non\u00a0!", "a  b\tc", " a\rb", "a\u2003b c ", "", " ", "a\nb c"]
    some += ["".join(r.choice(["mot", "a", "é", ".", " ", " ", "\u00a0", "\t", "\r", "\n", "\u2003", "\x85", "\x1c"]) for _ in range(24)) for _ in range(4000)]
    parts = ["mot", "a", "É", "×", "÷", "ĳ", "7", ".", ",", "'", "'s", "'LL", "-", "…", "—", " ", " ", "\n", "  ", "<|", "<|endoftext|>", "e\u0301", "漢", "\U0001f600", "\u1680", "\u202f", "\u3000", "\x7f", "\x00"]
    some += ["".join(r.choice(parts[: r.choice([19, 19, 29])]) for _ in range(r.randrange(30))) for _ in range(20_000)]
    for t, got in zip(some, encoded(enc, some), strict=True):
        assert got == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_near_blocks_of_a_dense_bucket(spark, monkeypatch):
    """Many classes of mutual similarity about 0.75 in common buckets, dealt to small blocks, against brute force."""
    monkeypatch.setattr(near, "BLOCK", 7)
    r = random.Random(4)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(200), r.choice([3, 12, 15, 18])):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w), "en", "a", 0))
    sets = {i: frozenset(zip(t.split(), t.split()[1:], strict=False)) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    assert 20 < len({top(i) for i in sets}) < 150
    got = {x["doc_id"]: x["component_id"] for x in near.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: top(i) for i in sets}


def test_near_components_of_a_chain(spark, monkeypatch):
    """A chain with ascending ids takes few rounds."""
    made = []
    plain = near.stored
    monkeypatch.setattr(near, "stored", lambda df, tag: made.append(tag) or plain(df, tag))
    n = 2000
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(9000, 8000), (8000, 8500)], "a long, b long"))
    got = {x["node"]: x["component"] for x in near.components(links).collect()}
    assert got == {k: 0 for k in range(n)} | {9000: 8000, 8000: 8000, 8500: 8000}
    assert len(made) < 40


def test_near_recall_at_the_threshold(spark):
    """Pairs just above 0.8 are all found, pairs just below are not linked."""
    r, rows, want = random.Random(8), [], {}
    for i in range(600):
        w = [f"p{i}_{k}" for k in range(120)]
        v, k = list(w), 0
        a = frozenset(zip(w, w[1:], strict=False))
        while True:  # change words until the next change would go below
            x = list(v)
            x[r.randrange(120)] = f"q{i}_{k}"
            k += 1
            b = frozenset(zip(x, x[1:], strict=False))
            if 100 * len(a & b) < 80 * len(a | b):
                break
            v = x
        rows += [(3 * i, " ".join(w), "en", "a", 0), (3 * i + 1, " ".join(v), "en", "a", 0)]
        want |= {3 * i: 3 * i, 3 * i + 1: 3 * i}
    got = {x["doc_id"]: x["component_id"] for x in near.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_near_odd_rows(spark, odd, none):
    """Rows that share an id, rows without one, repeated rows, clashing names."""
    t, u = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, t, 7), (1, u, 7), (2, u, 7), (2, u, 7), (None, t, 7), (None, "lone text of no id at all", 7), (None, "lone text of no id at all", 8), (3, "", 7), (3, "", 7), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, maybe long").withColumns({"rk": F.lit("x"), "component": F.lit("y"), "row": F.lit(1)})
    got = sorted(((x["doc_id"] or 0, x["n_shingles"], x["component_id"] or 0, x["kept"]) for x in near.groups(docs).collect()))
    assert got == sorted([(1, 49, 1, True), (1, 49, 1, True), (2, 49, 1, False), (2, 49, 1, False), (0, 49, 1, False), (0, 6, 0, False), (0, 6, 0, False), (3, 0, 3, True), (3, 0, 3, True), (4, 0, 4, True)])
    kept = near.deduplicate(docs)
    assert kept.dtypes == docs.dtypes
    left = sorted(((x["doc_id"] or 0, x["text"]) for x in kept.collect()), key=repr)
    assert left == sorted([(1, t), (1, u), (0, "lone text of no id at all"), (3, ""), (3, ""), (4, None)], key=repr)
    assert sorted((x["doc_id"] or 0) for x in near.deduplicate(odd).collect()) == [1, 2, 3, 4, 6, 7] and near.deduplicate(none).count() == 0


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The odd rows with columns named like results and internal columns."""
    names = ["ids", "n_pieces", "ids_crc32", "decoded", "bytes", "_bytes", "h", "shard", "n_words_", "hits", "items", "contaminated", "accepted", "p_good", "base", "weak", "spans", "row", "row_key", "owner_key", "licenses", "directory", "inherited", "chunk", "start", "component_id", "kept", "same", "sig", "maybe", "rk", "_doc", "_hit", "path"]
    return odd.withColumns({n: F.lit(f"own {n}") for n in names})


def test_odd_rows_everywhere(spark, clashing, none):
    """Nulls, empty and long texts, repeated rows and clashing names: values are those that single rows have on their own."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    n = len(rows)
    arrow = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    # 1
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    both = [sorted(tuple(r) for r in x.select("ids_crc32", "n_pieces").collect()) for x in (pieces.digest(pieces.encode(clashing, path)), pieces.encode(clashing, path, digested=True))]
    assert both[0] == both[1]
    got = pieces.digest(pieces.decode(pieces.encode(clashing, path), path)).select("doc_id", "text", "ids", "decoded", "n_pieces", "h").collect()
    assert len(got) == n and all(list(r["ids"]) == sp.encode(r["text"] or "") and r["decoded"] == (r["text"] or "") and r["n_pieces"] == len(r["ids"]) and r["h"] == "own h" for r in got)
    # 2
    assert sorted(r["bytes"] for r in sharding.plan(clashing, limit=50).collect()) == sorted(len((t or "").encode()) for _, t in rows)
    # 3
    bench = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    got = decontaminate.decontaminate(clashing, bench)
    assert sorted((r["doc_id"] or 0, r["n_words"], r["contaminated"]) for r in got.collect()) == sorted((i or 0, len(words(t)), words(t) == ["one", "two"]) for i, t in rows)
    # 4
    labels = spark.createDataFrame([(k, k % 2, 0, "x") for k in (1, 2, 3, 4, 6, 7, 999)] + [(3, None, 0, "y"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, accepted string")
    model = quality.train(clashing, labels)
    got = quality.classify(clashing, model).select("text", "p_fair", "p_good", "accepted", "expected_grade", "row").collect()
    assert len(got) == n and all(abs(r["p_good"] - model.tails((r["text"] or "").encode())[-1]) < 1e-9 and r["accepted"] == (r["p_good"] >= 0.5) and r["row"] == "own row" for r in got)
    # 6
    got = secrets.scan(clashing, keep=["doc_id", "text"]).collect()
    assert len(got) == n and all(",".join(f"{secrets.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["base"]) == base_spans(r["text"] or "") for r in got)
    red = secrets.redact(clashing)
    assert red.columns == clashing.columns and sum("[SECRET]" in (r["text"] or "") for r in red.collect()) == 2
    # 7
    got = licenses.scan(clashing.withColumn("path", F.concat_ws("/", "source", "lang", "doc_id")))
    assert got.count() == n and got.where("size(licenses) > 0 or inherited is not null").count() == 0 and {"h", "row", "rk"} <= set(got.columns)
    # 8
    got = lm.score(clashing).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i or 0, len((t or "").encode().split()) + 1) for i, t in rows)
    # 9
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    back = wavelet.read_files(wavelet.write_files(clashing, public_tokenizers.path("byte_bpe_50k.json"), file_tokens=100)).collect()
    want = {(i or 0, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in rows}
    assert len(back) == n and {(r["doc_id"] or 0, r["ids_crc32"]) for r in back} == want
    back.sort(key=lambda r: r["start"])
    assert [r["start"] for r in back] == np.cumsum([0] + [r["n_tokens"] for r in back])[:-1].tolist() and [r["doc_id"] or 0 for r in back] == sorted(i or 0 for i, _ in rows)
    # 10
    assert near.groups(clashing).count() == n and near.deduplicate(clashing).columns == clashing.columns
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") in ("10000", "500")
    # 5
    v = spark.createDataFrame([(0, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x"), (1, [2.0, 1.0], "y"), (None, [1.0, 1.0], "z"), (50, None, None), (100, [0.5, 0.5], "w")], "vec_id long, embedding array<float>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(v, F.col("vec_id") % 50 == 0, k=2).collect())
    assert got == sorted([(0, 1, 1, 262144), (0, 2, 100, 98304)] * 2 + [(100, 1, 0, 98304), (100, 2, 0, 98304)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)


def test_quality_by_hand(spark):
    """Scores from weights and thresholds by a plain loop, and a fit whose loss has no better thresholds near."""
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.classify(docs, model).select("doc_id", "p_fair", "p_good", "expected_grade").collect():
        total = sum(model.weights.get(x, 0.0) for x in {zlib.crc32(t) % (1 << quality.BITS) for t in quality.tokens(texts[r["doc_id"]].encode())})
        tails = [1 / (1 + math.exp(c - total)) for c in model.cuts]
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip((r["p_fair"], r["p_good"], r["expected_grade"]), (*tails, sum(tails)), strict=True))
    graded = {r["doc_id"]: 0 if r["toxic"] else 1 if r["quality"] == 0 else 2 for r in labels.collect()}

    def loss(weights, cuts):
        out = 0.0
        for i, g in graded.items():
            f = sum(weights.get(quality.spot(t), 0.0) for t in quality.tokens(texts[i].encode()))
            p = [1.0, *(1 / (1 + math.exp(c - f)) for c in cuts), 0.0]
            out -= math.log(max(1e-12, p[g] - p[g + 1]))
        return out / len(graded)

    share = [sum(g >= k for g in graded.values()) / len(graded) for k in (1, 2)]
    assert loss(model.weights, model.cuts) < 0.6 * loss({}, [-math.log(s / (1 - s)) for s in share])
    # labels without a document push none out of the sample
    more = labels.select("doc_id", "quality", "toxic").unionByName(spark.range(10_000, 30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert quality.train(docs, more, rows=200).weights == quality.train(docs, labels, rows=200).weights


def test_licenses_by_hand(spark):
    """Cosines of lines by a plain loop, and inheritance by walking up the planted directories."""
    r = random.Random(3)
    notices = [x for n in sorted(licenses.TEMPLATES) for x in licenses.TEMPLATES[n]]
    names = [n for n in sorted(licenses.TEMPLATES) for _ in licenses.TEMPLATES[n]]
    filler = [f"w{k}" for k in range(40)] + ["license", "the", "of", "version"]
    rows = []
    for k in range(120):
        lines = [" ".join(r.choices(filler, k=6)) for _ in range(3)]
        if k % 3 == 0:
            w = r.choice(notices).split()
            lines.insert(1, " ".join(x for x in w if r.random() > r.choice([0, 0.2, 0.5])))
        if k % 11 == 0:
            lines = [r.choice(notices)]
        rows.append((k, "\n".join(lines), "/".join(r.choices("abc", k=r.randrange(1, 4))) + f"/f{k}"))
    got = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), templates=licenses.TEMPLATES).collect()}
    bags = {i: licenses.terms(t.lower().encode()) for i, t, _ in rows}
    vocabulary = set().union(*(licenses.terms(x.encode()) for x in notices))
    idf = lambda t: math.log((len(rows) + 1) / (sum(t in b for b in bags.values()) + 1)) + 1 if t in vocabulary else math.log((len(rows) + 1) / 2) + 1
    weigh = lambda bag: {t: c * idf(t) for t, c in bag.items()}
    made = [weigh(licenses.terms(x.encode())) for x in notices]
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def best(text):
        v = weigh(licenses.terms(text.lower().encode()))
        scores = [sum(x * m.get(t, 0) for t, x in v.items()) / (size(v) * size(m)) if v else 0.0 for m in made]
        top = max(scores)
        return names[next(k for k, x in enumerate(scores) if x > top - 1e-12)] if top >= licenses.LEAST else None

    whole = {i: best(t) for i, t, _ in rows}
    declared = collections.defaultdict(set)
    for i, _, p in rows:
        if whole[i]:
            declared[p.rpartition("/")[0]].add(whole[i])
    for i, t, p in rows:
        assert set(got[i]["licenses"]) == {x for line in t.split("\n") if (x := best(line))}, t
        assert got[i]["file_license"] == whole[i]
        up = p.rpartition("/")[0]
        while up and up not in declared:
            up = up.rpartition("/")[0]
        assert got[i]["inherited"] == (",".join(sorted(declared[up])) if up in declared else None)
    assert sum(x is not None for x in whole.values()) > 5 and sum(bool(x["licenses"]) for x in got.values()) > 15
