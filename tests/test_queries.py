"""Every query with SQL gives the rows that DuckDB gives; goldens of the daily report."""

import collections
import datetime
import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark import catalog
from tallyspark.functions import text as X
from tallyspark.operators import visits
from tallyspark.sources import files

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in ("events", "pages", "orders"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(f"select {', '.join(cols)} from ({catalog.SQL[name]})")
    want = sorted((tuple(norm(x) for x in r) for r in rel.fetchall()), key=repr)
    assert got == want


def test_rows_only(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.SQL)):
        assert catalog.QUERIES[name](spark, D).count() > 0, name


def test_report_is_byte_exact(spark, tmp_path):
    log = ["https://a.example/blog/rows,2026-01-24T01:16:58+00:00", "https://a.example/blog/enums,2024-01-24T01:16:58+00:00", "https://b.example/blog/rows?x#y,2026-01-24T01:12:11+00:00", "https://a.example/blog/rows,2025-01-24T01:15:20+00:00"]
    (tmp_path / "log.csv").write_text("\n".join(log) + "\n")
    doc = visits.document(visits.of_log(files.visit_log(spark, str(tmp_path / "log.csv")))).first()[0]
    assert doc == '{\n    "\\/blog\\/enums": {\n        "2024-01-24": 1\n    },\n    "\\/blog\\/rows": {\n        "2025-01-24": 1,\n        "2026-01-24": 2\n    }\n}'
    assert visits.document(visits.of_log(files.visit_log(spark, str(tmp_path / "log.csv")).limit(0))).first()[0] == "[]"


def test_checkpoint_is_double_arithmetic(spark):
    assert spark.createDataFrame([(2.53,)], "x double").select(X.checkpoint(F.col("x"))).first()[0] == 2.52


def test_generator_does_not_depend_on_partitions(spark):
    from tallyspark.sources import generate

    uris = spark.createDataFrame([("https://a.example/x",), ("https://a.example/y",)], "uri string")
    one, two = (sorted(map(tuple, generate.visits(spark, uris, "1_000", 7, p).collect())) for p in (1, 5))
    assert one == two and len(one) == 1000


def test_generator_draws_every_uri(spark):
    from tallyspark.sources import generate

    uris = spark.range(100_500).select(F.format_string("https://a.example/%07d", "id").alias("uri"))
    places = generate.numbered(uris).where("url <> format_string('https://a.example/%07d', k)")
    assert places.count() == 0
    log = generate.visits(spark, uris, 1_200_000, 7)
    assert log.count() == 1_200_000
    last = log.where("url >= 'https://a.example/0100000'").select("url").distinct().count()
    assert last > 490
    assert catalog.QUERIES["generate_visits"](spark, D).count() == spark.read.parquet(f"{D}/events.parquet").count()


def test_long_added_lines_are_whole(spark):
    from tallyspark.operators import difflog

    long = "x" * (1 << 20)
    rows = spark.createDataFrame([(f"+{long},{long}y,2.5",), ("+a;b;1.5",)], "line string")
    assert sorted(map(tuple, difflog.added_rows(rows).collect())) == [("b", 1.5), (long + "y", 2.5)]


def simulated(entries, excluded):
    """The records, finalists and history by a plain loop over (ts, branch, secs)."""
    best, cp, reached = {}, {}, {}
    records = []
    for k, (ts, branch, secs) in enumerate(entries):
        if branch not in best or secs < best[branch]:
            best[branch] = secs
            records.append(k)
            c = math.floor(secs * 100) / 100
            if branch not in cp or c < cp[branch]:
                cp[branch], reached[branch] = c, ts
    some = {b: c for b, c in cp.items() if b not in excluded}
    top = sorted(set(some.values()))[:3]
    chosen = sorted((b for b in some if some[b] in top), key=lambda b: (some[b], reached[b]))[:3]  # stable: first appearance
    now, rows = {}, {}
    for ts, branch, secs in entries:
        if branch in chosen:
            now[branch] = min(secs, now.get(branch, secs))
            rows[ts] = dict(now)
    lines, old = [], None
    for ts, row in rows.items():
        if row != old:
            lines.append((ts, *(row.get(b) for b in sorted(chosen))))
        old = row
    return records, [(b, cp[b], best[b], reached[b]) for b in chosen], lines


@pytest.mark.parametrize("seed", range(3))
def test_history_like_a_loop(spark, tmp_path, seed):
    """Ties of checkpoints and times, several runs at one time, excluded branches."""
    from tallyspark.operators import records

    r = random.Random(seed)
    stamps = [datetime.datetime(2026, 3, 1) + datetime.timedelta(hours=h) for h in sorted(r.choices(range(80), k=120))]
    entries = [(t, f"b{r.randrange(9)}", r.choice([2.0, 2.53, 2.531, 2.6, 2.61, 2.9, 3.0])) for t in stamps]
    runs = spark.createDataFrame([(k, *e) for k, e in enumerate(entries)], "event_id long, ts timestamp, branch string, secs double")
    want_records, want, lines = simulated(entries, ("b0", "b1"))
    assert sorted(x[0] for x in records.record_events(runs).select("event_id").collect()) == want_records
    best = {}
    for x in records.running_best(runs).orderBy("event_id").collect():
        best[x["branch"]] = min(entries[x["event_id"]][2], best.get(x["branch"], 99))
        assert x["best"] == best[x["branch"]]
    chosen = records.finalists(records.entrants(runs, ("b0", "b1")))
    assert [tuple(x)[1:] for x in chosen.orderBy("rnk").select("rnk", "branch", "checkpoint", "secs", "reached_at").collect()] == want
    report = records.history_report(records.history_days(runs, chosen, day=F.col("ts")), chosen)
    number = lambda x: "" if x is None else f"{x:g}"
    text = ["entry_date," + ",".join(sorted(b for b, *_ in want))] + [",".join([str(t), *map(number, row)]) for t, *row in lines]
    files.write_matrix(report, str(tmp_path / "history.csv"))
    assert (tmp_path / "history.csv").read_text() == "\n".join(text) + "\n"
    files.write_matrix(records.finalists_report(chosen), str(tmp_path / "finalists.csv"))
    want_text = ["rank,branch_name,checkpoint,time,reached_at"] + [f"{k + 1},{b},{c:.2f},{number(s)},{t}" for k, (b, c, s, t) in enumerate(want)]
    assert (tmp_path / "finalists.csv").read_text() == "\n".join(want_text) + "\n"


def test_change_log_to_files(spark, tmp_path):
    """Commits with offsets and blank lines, empty diffs, odd lines, a date from which on."""
    from tallyspark import jobs
    from tallyspark.operators import difflog

    log = spark.createDataFrame([("a1|2026-02-27 10:00:00 +0000",), ("",), ("b2|2026-03-01 01:30:00 +0200",), ("c3|2026-03-02 00:00:00 +0000",), ("d4|2026-03-03 00:00:00 +0000",)], "line string")
    diffs = spark.createDataFrame([("a1", "+1,old,1.0"), ("b2", "+++ b/x.csv\n+entry_date,branch_name,time\n+1,x,3.5s\n-1,y,1\n+\n+0\n+a,b"), ("c3", ""), ("d4", "+1;y;1234.5\n+2,x,2.53,more\n+3,z,none")], "hash string, diff_text string")
    rows = sorted(tuple(x) for x in difflog.ingest(log, diffs, "2026-02-28").select("ts", "branch", "secs", "line_no").collect())
    assert rows == [(datetime.datetime(2026, 2, 28, 23, 30), "x", 3.5, 2), (datetime.datetime(2026, 3, 3), "x", 2.53, 1), (datetime.datetime(2026, 3, 3), "y", 1234.5, 0), (datetime.datetime(2026, 3, 3), "z", 0.0, 2)]
    assert jobs.history(spark, log, diffs, str(tmp_path / "h"), str(tmp_path / "f"), "2026-02-28", excluded=("z",)) == 2
    assert (tmp_path / "f").read_text() == "rank,branch_name,checkpoint,time,reached_at\n1,x,2.52,2.53,2026-03-03 00:00:00\n2,y,\"1,234.50\",1234.5,2026-03-03 00:00:00\n".replace('"', "")
    assert (tmp_path / "h").read_text() == "entry_date,x,y\n2026-02-28 23:30:00,3.5,\n2026-03-03 00:00:00,2.53,1234.5\n"
    assert jobs.history(spark, log, diffs.limit(0), str(tmp_path / "none"), str(tmp_path / "none2")) == 0 and not (tmp_path / "none").exists()


def test_log_file_to_document_file(spark, tmp_path):
    """The whole job, file in and file out, with paths that need escapes, against Python's own JSON."""
    from tallyspark import jobs

    paths = ["/blog/a", '/q"uote', "/back\\slash", "/é漢\U0001f600", "/tab\there", "/bell\x07", "/del\x7f", "/sp ace+,x"]
    days = ["2026-01-24", "2025-12-31", "2024-02-29"]
    r = random.Random(1)
    rows = [(r.choice(paths), r.choice(days)) for _ in range(500)]
    (tmp_path / "log.csv").write_text("".join(f"https://a.example{p},{d}T01:16:58+00:00\n" for p, d in rows), encoding="utf-8", newline="")
    assert jobs.parse(spark, str(tmp_path / "log.csv"), str(tmp_path / "out.json")) == len({p for p, _ in rows})
    got = (tmp_path / "out.json").read_bytes().decode("ascii")
    count = collections.Counter(rows)
    want = {p: {d: count[p, d] for d in sorted(days) if count[p, d]} for p in sorted(paths, key=lambda x: x.encode())}
    assert got.replace("\x7f", "\\u007f") == json.dumps(want, indent=4).replace("/", "\\/").replace("\x7f", "\\u007f")
    assert json.loads(got) == want
    (tmp_path / "empty.csv").write_text("")
    jobs.parse(spark, str(tmp_path / "empty.csv"), str(tmp_path / "empty.json"))
    assert (tmp_path / "empty.json").read_text() == "[]"


def test_generated_log_is_parsed(spark, tmp_path):
    from tallyspark import jobs

    jobs.generate_log(spark, spark.createDataFrame([("https://a.example/x",), ("https://a.example/y",)], "uri string"), "2_000", str(tmp_path / "log"), 7)
    jobs.parse(spark, str(tmp_path / "log"), str(tmp_path / "doc"))
    assert sum(n for days in json.loads((tmp_path / "doc").read_text()).values() for n in days.values()) == 2000
    with pytest.raises(ValueError, match="no URI"):
        jobs.generate_log(spark, spark.createDataFrame([], "uri string"), 5, str(tmp_path / "no"))


def test_iso_off_utc(spark):
    x = spark.sql("select timestamp_seconds(0) as t, timestamp_ntz'1970-01-01 00:00:00' as n")
    assert x.select(X.format_iso(F.col("t"))).first()[0] == "1970-01-01T00:00:00+00:00"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert tuple(x.select(X.format_iso(F.col("t")), X.format_iso_utc(F.col("n"))).first()) == ("1969-12-31T19:00:00-05:00", "1970-01-01T00:00:00+00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_board_file_and_repeated_keys(spark, tmp_path):
    from tallyspark.operators import board

    base = spark.createDataFrame([(1, 10, " a", 5.0), (2, 20, "b", 2.0), (3, 30, "b", 4.0)], "seq long, entry_date long, branch_name string, time double")
    new = spark.createDataFrame([(90, "b", 3.5), (91, "c", 0.0), (92, "d", None), (93, "e", 9.25)], "entry_date long, branch_name string, time double")
    merged = board.merge(base, new, "branch_name", "entry_date", "time", seq="seq")
    files.write_file(board.report(merged), str(tmp_path / "board.csv"), end="\n")
    assert (tmp_path / "board.csv").read_text() == "entry_date,branch_name,time\n30,b,3.5\n10, a,5\n93,e,9.25\n"
    assert sorted(map(tuple, files.board(spark, str(tmp_path / "board.csv")).collect())) == [(10, " a", 5.0), (30, "b", 3.5), (93, "e", 9.25)]


def test_pages_end_at_the_first_gap(spark):
    """Empty and failing pages end the scan, whatever stride they are in; with abort the error comes through."""
    full = lambda n: [{"x": 10 * n + k} for k in range(3)]
    ids = lambda fetch, **k: sorted(r["x"] for r in files.pages(spark, fetch, "x long", strides=3, **k).collect())
    upto = lambda n: [10 * p + k for p in range(1, n + 1) for k in range(3)]
    assert ids(lambda n: full(n) if n <= 25 else []) == upto(25)
    assert ids(lambda n: []) == []

    def failing(n):
        if n == 5:
            raise ValueError("no page")
        return full(n) if n < 20 else []

    assert ids(failing) == upto(4)
    ends = {r["_page"]: r["_end"] for r in files.page_scan(spark, failing, "x long", strides=3).where("_end is not null").collect()}
    assert ends[5] == "ValueError: no page"
    with pytest.raises(Exception, match="no page"):
        ids(failing, abort=True)


def test_cached_rows(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    path = str(tmp_path / "cache")
    assert [files.cached(spark, path, make, s).count() for s in (3600, 3600, 0, 3600)] == [1, 1, 2, 2] and len(made) == 2


def test_result_document(spark, tmp_path):
    from tallyspark.operators import gate

    (tmp_path / "r.json").write_text('{"results": [{"mean": 2.5, "min": 2.25}, {"mean": 1}]}')
    assert files.json_documents(spark, str(tmp_path / "r.json"), files.RESULT).first()["results"][0]["mean"] == 2.5
    rows = files.whole_text(spark, str(tmp_path / "r.json")).unionByName(spark.createDataFrame([("{}",), ("no json",), (None,), ('{"results": []}',)], "value string"))
    assert [tuple(x["r"]) for x in rows.select(gate.result_seconds(F.col("value"), files.RESULT).alias("r")).collect()] == [(2.5, 2.25)] + 4 * [(None, None)]


def test_text_functions(spark):
    x = spark.createDataFrame([("1,234_567", " 2026-03-01 01:30:00 +0200 ", "2026-03-01T00:00:00Z", "soon")], "n string, a string, b string, c string")
    t = x.select(X.clean_count(F.col("n")), *(F.unix_timestamp(X.instant(F.col(k))) for k in "abc")).first()
    assert tuple(t) == (1234567, 1772321400, 1772323200, None)


def test_malformed_lines_and_first_seen(spark, tmp_path):
    (tmp_path / "log").write_text("https://a.example/x,2026-01-24T01:16:58+00:00\nbroken\n,2026-01-24T01:16:58+00:00\n")
    assert sorted(r[0] for r in files.malformed(spark, str(tmp_path / "log")).collect()) == [",2026-01-24T01:16:58+00:00", "broken"]
    seen = spark.createDataFrame([("https://a.example/b", 1), ("https://a.example/a", 2), ("https://z.example/b", 3)], "url string, at long")
    order = visits.first_seen(seen, "at")
    assert {r["path"]: r["seen"] for r in order.collect()} == {"/b": 1, "/a": 2}
    doc = visits.document(visits.daily(seen.withColumn("day", F.lit("2026-01-01"))), order).first()[0]
    assert list(json.loads(doc)) == ["/b", "/a"]


def test_streams_repeat_batches(spark, tmp_path):
    """Two starts over a growing folder count everything once."""
    from tallyspark.streaming import visits as streams

    rows = spark.createDataFrame([("https://a.example/x", "2026-01-01")] * 5, "url string, day string").select("url", F.col("day").cast("date").alias("day"))
    for want in (5, 10):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("url string, day date").parquet(str(tmp_path / "in"))
        streams.run_daily(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert [r["visits"] for r in streams.daily_result(spark, str(tmp_path / "out")).collect()] == [want]
