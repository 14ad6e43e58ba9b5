"""Running best, records, checkpoints, finalists and their history. Runs have branch, secs, ts and a sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import checkpoint, plain_number


def _with_prior(runs: DataFrame, seq: str) -> DataFrame:
    """runs with _prior, the branch's best before the run. Days are summed up first, so a task holds a branch's days or the runs
    of one branch and day, not all runs of a branch."""
    day = F.to_date("ts")
    days = runs.groupBy("branch", day.alias("_day")).agg(F.min("secs").alias("_best"))
    earlier = Window.partitionBy("branch").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(F.col("branch").alias("_b"), F.col("_day").alias("_d"), F.min("_best").over(earlier).alias("_before"))
    met = runs.withColumn("_day", day).join(before, F.col("branch").eqNullSafe(F.col("_b")) & F.col("_day").eqNullSafe(F.col("_d")))
    own = Window.partitionBy("branch", "_day").orderBy("ts", seq).rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("_prior", F.least("_before", F.min("secs").over(own)))


def running_best(runs: DataFrame, seq: str = "event_id") -> DataFrame:
    return _with_prior(runs, seq).select(seq, "branch", F.least("_prior", "secs").alias("best"))


def record_events(runs: DataFrame, seq: str = "event_id") -> DataFrame:
    """Runs strictly better than all before them."""
    return _with_prior(runs, seq).where("_prior is null or secs < _prior").select(seq, "branch", "secs")


def entrants(runs: DataFrame, excluded: tuple[str, ...] = (), seq: str = "event_id") -> DataFrame:
    """branch, secs, checkpoint, reached_at, seen: best time, best checkpoint, when it was first reached, and the place (ts, seq) of
    the branch's first run, in one aggregation."""
    kept = runs.where(~F.col("branch").isin(*excluded)) if excluded else runs
    cp = checkpoint(F.col("secs"))
    found = kept.groupBy("branch").agg(F.min("secs").alias("secs"), F.min(F.struct(cp.alias("checkpoint"), F.col("ts").alias("reached_at"))).alias("m"), F.min(F.struct("ts", seq)).alias("seen"))
    return found.select("branch", "secs", "m.checkpoint", "m.reached_at", "seen")


def best_checkpoints(entered: DataFrame, n: int = 3) -> DataFrame:
    return entered.select("checkpoint").distinct().orderBy("checkpoint").limit(n)


def finalists(entered: DataFrame, n: int = 3) -> DataFrame:
    """rnk, branch, checkpoint, secs, reached_at: the first n branches by checkpoint and time of reaching it; ties go to the branch that
    appeared first. The first n rows lie within the n best checkpoints, so a top-n selection suffices before they are numbered."""
    order = ("checkpoint", "reached_at", "seen", "branch")
    top = entered.orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rnk"), "branch", "checkpoint", "secs", "reached_at")


def runs_of(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    return runs.join(F.broadcast(chosen.select("branch")), "branch", "left_semi")


def history_days(runs: DataFrame, chosen: DataFrame, day: Column | None = None, names: list | None = None) -> DataFrame:
    """entry_day, b1.. bn: each finalist's best up to the day, for days with a run of any finalist. The pivot's values are
    the ranks, so its columns are fixed."""
    ranks = names or [1, 2, 3]
    met = runs.join(F.broadcast(chosen.select("branch", "rnk")), "branch")
    wide = met.groupBy((F.to_date("ts") if day is None else day).alias("entry_day")).pivot("rnk", ranks).agg(F.min("secs"))
    w = Window.orderBy("entry_day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return wide.select("entry_day", *(F.min(str(k)).over(w).alias(f"b{k}") for k in ranks))


def history_matrix(days: DataFrame) -> DataFrame:
    """Days on which some value differs from the day before."""
    values = [c for c in days.columns if c != "entry_day"]
    now = F.struct(*values)
    w = Window.orderBy("entry_day")
    marked = days.withColumn("_old", F.lag(now).over(w)).withColumn("_n", F.row_number().over(w))
    return marked.where((F.col("_n") == 1) | ~now.eqNullSafe(F.col("_old"))).drop("_old", "_n")


def history_long(days: DataFrame, chosen: DataFrame) -> DataFrame:
    """entry_day, branch, secs, from the matrix: branches that have a run so far."""
    values = [c for c in days.columns if c != "entry_day"]
    tall = days.unpivot("entry_day", values, "b", "secs").where("secs is not null")
    return tall.join(F.broadcast(chosen), F.col("b") == F.concat(F.lit("b"), F.col("rnk").cast("string"))).select("entry_day", "branch", tall["secs"])


def history_report(days: DataFrame, chosen: DataFrame, stamp: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """The matrix under the finalists' names, in the order of the names; blanks before a first result. chosen has a few rows."""
    names = sorted((r["branch"], r["rnk"]) for r in chosen.select("branch", "rnk").collect())
    made = history_matrix(days).orderBy("entry_day")
    return made.select(F.date_format("entry_day", stamp).alias("entry_date"), *(F.coalesce(plain_number(F.col(f"b{k}")), F.lit("")).alias(n) for n, k in names))


def finalists_report(chosen: DataFrame, stamp: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """rank, branch_name, checkpoint (two digits, thousands parted by commas), time, reached_at as texts."""
    return chosen.orderBy("rnk").select(F.col("rnk").alias("rank"), F.col("branch").alias("branch_name"), F.format_number("checkpoint", 2).alias("checkpoint"), plain_number(F.col("secs")).alias("time"), F.date_format("reached_at", stamp).alias("reached_at"))
