"""The pipeline against its operators' rules, written plainly."""

import collections

import duckdb

D = "/root/testdata/sf0.001"


def docs_of(spark, rows, columns):
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows.values()], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline(spark):
    import corpus_pipeline as p
    from tallyspark.llm import decontaminate, pieces, secrets
    from tallyspark.llm.common import stored, table

    docs, kept = table(spark, D, "documents"), []
    columns = docs.columns
    for _, stage in p.STAGES:
        docs = stored(stage(spark, docs, D), "test")
        kept.append({r["doc_id"]: r for r in docs.collect()})
    a, b, c, d, e = kept
    assert all(x.keys() <= y.keys() for x, y in zip(kept[1:], kept, strict=False))
    assert list(next(iter(d.values())).asDict()) == columns
    sets = {}
    for i, r in a.items():
        w = r["text"].encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    up = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = i, j
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)
    assert set(b) == {i for i in sets if up[i] == i}
    told = {r["doc_id"]: r["contaminated"] for r in decontaminate.op3_decontaminate(spark, D).collect()}
    assert set(c) == {i for i in b if not told[i]}
    assert set(d) == set(c) == set(e)
    found = {r["doc_id"]: r["base"] or r["added"] for r in secrets.scan(docs_of(spark, c, columns)).collect()}
    assert all(bool(found[i]) == ("[SECRET]" in d[i]["text"]) and (found[i] or d[i]["text"] == c[i]["text"]) for i in c)
    assert all(not duckdb.sql("select regexp_matches($1, $2)", params=[r["text"], "AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}"]).fetchall()[0][0] for r in d.values())
    assert all(len(r["text"]) == r["n_chars"] for r in d.values()) and len(secrets.KINDS) == 4
    import public_tokenizers

    t = pieces.compile_model(public_tokenizers.path("piece_bpe_32k.model"))
    assert all(list(e[i]["ids"]) == t.encode(d[i]["text"]) for i in list(d)[:50])
    assert collections.Counter(map(len, (x.asDict() for x in e.values())))


def test_stages_with_odd_rows(spark, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows, clashing names and an empty table."""
    import corpus_pipeline as p

    bench = " ".join(f"q{k}" for k in range(20))
    spark.createDataFrame([(1, bench), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(9)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, None, "en", "a", 1), (2, "", "en", None, 2), (3, long, None, "a", None), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (None, "one two", "en", "a", 7), (5, f"{bench} end", "en", "b", 9), (6, "my password: abcdef12 is here now", "en", "c", 33), (7, " " * 50, "en", "c", 7)]
    names = ["accepted", "p_good", "contaminated", "items", "hits", "row", "maybe", "base", "_doc", "_bytes", "ids", "component"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        docs = docs.selectExpr("*", f"'own {n}' as {n}")
    # without labels of two grades everything is accepted
    want = {"quality": [1, 2, 3, 4, 4, 5, 6, 7, None], "near_dedup": [1, 2, 3, 4, 5, 6, 7], "decontaminate": [1, 2, 3, 4, 6, 7], "secrets": [1, 2, 3, 4, 6, 7], "pieces": [1, 2, 3, 4, 6, 7]}
    now = docs
    for name, stage in p.STAGES:
        now = stage(spark, now, str(tmp_path))
        got = now.collect()
        assert sorted((r["doc_id"] for r in got), key=lambda x: (x is None, x)) == want[name], name
        if name != "pieces":
            assert now.columns == docs.columns and all(r[n] == f"own {n}" for r in got for n in names), name
        if name == "secrets":
            by = {r["doc_id"]: r for r in got}
            assert by[6]["text"] == "my [SECRET] is here now" and by[6]["n_chars"] == 23 and by[1]["text"] is None and by[3]["text"] == long
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
