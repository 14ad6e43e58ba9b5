"""All queries of the library over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import board, difflog, gate, records, validate, visits
from .plans import oracle
from .plans.inputs import boards, runs, table
from .plans.inputs import visits as visit_rows
from .sources import files, generate
from .store import folder
from .streaming import visits as streams

EXCLUDED = ("1", "2")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return visits.daily(visit_rows(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    v = visit_rows(spark, d)
    return v.select(F.concat_ws(",", "url", X.format_iso_utc(F.col("ts"))).alias("value"))


def _cut(lines: DataFrame) -> DataFrame:
    stamp = F.expr("substring(value, length(value) - 24, 25)")
    return lines.select(F.expr("substring(value, 1, length(value) - 26)").alias("url"), X.day_of(stamp).alias("day"))


def _fin(spark: SparkSession, d: str) -> DataFrame:
    return records.finalists(records.entrants(runs(spark, d), EXCLUDED))


def _history(spark: SparkSession, d: str) -> DataFrame:
    return records.history_days(runs(spark, d), _fin(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _diff_lines(spark: SparkSession, d: str) -> DataFrame:
    e, k = _events(spark, d), F.col("event_id") % 6
    u, v, i = F.col("user_id").cast("string"), F.col("value").cast("string"), F.col("event_id").cast("string")
    line = F.when(k == 0, "+++ b/board.csv").when(k == 1, F.concat(F.lit("-1,"), u, F.lit(","), v)).when(k == 2, "+").when(k == 3, "+entry_date,branch_name,time")
    return e.select(line.when(k == 4, F.concat(F.lit("+"), i, F.lit(";"), u, F.lit(";"), v)).otherwise(F.concat(F.lit("+"), i, F.lit(","), u, F.lit(","), v)).alias("line"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    base, new = (b.withColumnRenamed("first_ts", "entry_ts") for b in boards(spark, d))
    return board.merge(base, new, "contestant")


def _gate(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    commits = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("committed_at"))
    return gate.eligibility(commits, gate.latest_label(e, "user_id", "ts", F.col("event_type") == "signup"), "user_id")


def _pulls(spark: SparkSession, d: str) -> DataFrame:
    """Every user's day as a pull request: its event types are labels, an error makes a draft."""
    day = F.to_date("ts")
    tags = _events(spark, d).groupBy("user_id", day.alias("day")).agg(F.collect_set("event_type").alias("tags"))
    return tags.select((F.col("user_id") * 1000 + F.dayofyear("day")).alias("number"), "user_id", "day", F.transform("tags", lambda x: F.struct(x.alias("name"))).alias("labels"), F.array_contains("tags", "error").alias("draft"))


def _queue_one(spark: SparkSession, d: str) -> DataFrame:
    """The draft with the smallest number among those with a label, asked for by number."""
    pulls = _pulls(spark, d)
    number = pulls.where("draft and exists(labels, x -> x.name = 'view')").agg(F.min("number")).first()[0]
    return gate.queue(pulls, number=number, label="view").select("number", "user_id", "day")


def _change_log(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a commit that adds a board row."""
    e = _events(spark, d).select(F.col("event_id").cast("string").alias("hash"), "ts", F.concat(F.lit("+++ b/board.csv\n+"), F.col("event_id").cast("string"), F.lit(";"), F.col("user_id").cast("string"), F.lit(";"), F.col("value").cast("string"), F.lit("s\n-1,2,3\n+\n+entry_date,branch_name,time")).alias("diff_text"))
    log = e.select(F.concat("hash", F.lit("|"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000")).alias("line"))
    return difflog.ingest(log, e.select("hash", "diff_text")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _history_by_time(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    return records.history_matrix(records.history_days(r, _fin(spark, d), day=r["ts"]))


def _subset(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    some = _events(spark, d).where("event_type = 'purchase' and value < 1").select(F.col("user_id").cast("string").alias("branch")).distinct()
    return r.join(some, "branch", "left_semi").select("event_id", "branch", "secs")


def _status(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return _events(spark, d).select("event_id", gate.status((v.isNull(), "no_result"), (F.col("event_type") == "error", "run_failed"), (v >= 300, "timeout"), "ok").alias("status"))


def _validate(spark: SparkSession, d: str) -> DataFrame:
    v = visit_rows(spark, d)
    counted = lambda x: visits.daily(x).withColumnRenamed("visits", "n")
    return validate.diff(counted(v), counted(v.where("event_type <> 'error'")))


def _scan_board(spark: SparkSession, d: str) -> DataFrame:
    base, _ = boards(spark, d)
    path = folder(spark, "board")
    files.write_board(base.select(F.unix_timestamp(F.col("first_ts").cast("timestamp")).alias("entry_date"), F.concat(F.lit(" "), F.col("contestant")).alias("branch_name"), F.col("secs").alias("time")), path)
    return files.board(spark, path).select("branch_name", "time")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    pages = [[{"number": 10 * p + k, "title": f"t{k}"} for k in range(3)] for p in range(4)]
    return files.pages(spark, lambda n: pages[n - 1] if n <= len(pages) else [], "number long, title string")


def _stream_daily(spark: SparkSession, d: str) -> DataFrame:
    path, out = folder(spark, "visits"), folder(spark, "daily")
    visit_rows(spark, d).select("url", "day").repartition(3).write.parquet(path)
    stream = spark.readStream.schema("url string, day date").option("maxFilesPerTrigger", 1).parquet(path)
    streams.run_daily(stream, out, folder(spark, "stream")).awaitTermination()
    return streams.daily_result(spark, out)


def _stream_board(spark: SparkSession, d: str) -> DataFrame:
    path, out = folder(spark, "results"), folder(spark, "versions")
    _events(spark, d).where("value > 0").select("user_id", F.col("ts").alias("entry_ts"), F.col("value").alias("secs")).repartition(3).write.parquet(path)
    stream = spark.readStream.schema("user_id long, entry_ts timestamp_ntz, secs double").option("maxFilesPerTrigger", 1).parquet(path)
    streams.run_board(stream, out, "user_id", folder(spark, "stream")).awaitTermination()
    return streams.last_version(spark, out).select("user_id", "secs")


def _generated(spark: SparkSession, d: str) -> DataFrame:
    return generate.visits(spark, table(spark, d, "pages").select("url").distinct(), _events(spark, d).count())


QUERIES = {
    "daily_visits": _daily,
    "daily_visits_nested": lambda s, d: visits.nested(_daily(s, d)),
    "daily_report_document": lambda s, d: visits.document(_daily(s, d)),
    "scan_visit_lines": lambda s, d: _cut(_lines(s, d)),
    "page_dimension": lambda s, d: visit_rows(s, d).select("url").distinct().select(X.url_path(F.col("url")).alias("path")).distinct(),
    "running_best": lambda s, d: records.running_best(runs(s, d)),
    "record_events": lambda s, d: records.record_events(runs(s, d)),
    "best_per_branch": lambda s, d: records.entrants(runs(s, d), EXCLUDED).select("branch", "secs", "checkpoint"),
    "checkpoint_bucket": lambda s, d: runs(s, d).select("event_id", X.checkpoint(F.col("secs")).alias("checkpoint")),
    "checkpoint_reached": lambda s, d: records.entrants(runs(s, d), EXCLUDED).select("branch", "checkpoint", "reached_at"),
    "distinct_checkpoints": lambda s, d: records.best_checkpoints(records.entrants(runs(s, d), EXCLUDED)),
    "finalists": _fin,
    "finalist_runs": lambda s, d: records.runs_of(runs(s, d), _fin(s, d)).select("event_id", "branch", "secs"),
    "history_long": lambda s, d: records.history_long(_history(s, d), _fin(s, d)),
    "history_matrix": lambda s, d: records.history_matrix(_history(s, d)),
    "board_merge": _merged,
    "board_new_entries": lambda s, d: board.new_entries(*boards(s, d), "contestant").select("contestant", "secs"),
    "board_collapse": lambda s, d: board.collapse(_events(s, d), "user_id", "value", "event_id"),
    "board_ranked": lambda s, d: board.ranked(boards(s, d)[0].select("contestant", "secs"), "secs", "contestant"),
    "board_text": lambda s, d: board.text(boards(s, d)[0], "contestant"),
    "latest_label": lambda s, d: gate.latest_label(_events(s, d), "user_id", "ts", F.col("event_type") == "signup"),
    "eligibility_gate": _gate,
    "review_queue": lambda s, d: gate.queue(_pulls(s, d), label="purchase").select("number", "user_id", "day"),
    "review_queue_one": _queue_one,
    "change_log": _change_log,
    "history_by_time": _history_by_time,
    "result_json": lambda s, d: _events(s, d).select("event_id", gate.result_seconds(F.concat(F.lit('{"results":[{"mean":'), F.col("value").cast("string"), F.lit(',"min":'), (F.col("value") / 2).cast("string"), F.lit("}]}")), files.RESULT).alias("r")).select("event_id", "r.mean", "r.least"),
    "queue_size": lambda s, d: _events(s, d).where("event_type = 'signup'").agg(F.count("*").alias("n")),
    "single_thread_subset": _subset,
    "measure_two_stage": lambda s, d: gate.measured(_events(s, d).where("event_type = 'click'"), "user_id", "value", 20.0),
    "measure_json": lambda s, d: _events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")),
    "run_status": _status,
    "truncate_millis": lambda s, d: runs(s, d).select("event_id", X.truncate_millis(F.col("secs")).alias("secs")),
    "validate_diff": _validate,
    "validate_status": lambda s, d: _events(s, d).select("event_id", gate.status((F.col("props").isNull(), "missing"), (F.col("props") == "", "empty"), (F.col("props") == '{"k": 1}', "ok"), "unequal").alias("status")),
    "diff_ingest": lambda s, d: difflog.added_rows(_diff_lines(s, d)),
    "strip_ansi": lambda s, d: _events(s, d).select("event_id", X.strip_ansi(F.concat(F.lit("\x1b[31m"), F.col("event_type"), F.lit("\x1b[0m"))).alias("msg")),
    "encode_url": lambda s, d: table(s, d, "orders").select("o_orderkey", F.url_encode("o_orderpriority").alias("enc")),
    "format_iso": lambda s, d: _events(s, d).select("event_id", X.format_iso_utc(F.col("ts")).alias("iso")),
    "lenient_number": lambda s, d: _events(s, d).select("event_id", X.lenient_number(F.concat(F.col("event_id").cast("string"), F.col("event_type"))).alias("num")),
    "runs_ordered": lambda s, d: runs(s, d).select("event_id", "branch", "secs", "ts").orderBy("ts", "event_id"),
    "scan_board": _scan_board,
    "page_fetch": _pages,
    "generate_visits": _generated,
    "stream_daily_visits": _stream_daily,
    "stream_board": _stream_board,
}

_MORE = {
    "review_queue_one": "select number, user_id, day from pulls where number = (select min(number) from pulls where list_contains(tags, 'error') and list_contains(tags, 'view'))",
    "truncate_millis": "select event_id, floor(secs*1000)/1000 as secs from runs",
    "validate_status": "select event_id, case when props is null then 'missing' when props = '' then 'empty' when props = '{\"k\": 1}' then 'ok' else 'unequal' end as status from events",
    "runs_ordered": "select event_id, branch, secs, ts from runs",
    "scan_board": "select ' ' || contestant as branch_name, secs as time from base",
    "stream_daily_visits": "select path, day, count(*) as visits from visits group by path, day",
    "stream_board": "select user_id, min(value) as secs from events where value > 0 group by user_id",
}
SQL = {k: oracle.SHARED + v for k, v in (oracle.QUERIES | _MORE).items()}
