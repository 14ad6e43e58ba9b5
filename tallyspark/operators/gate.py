"""Eligibility by the latest label, review queues and run statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_label(events: DataFrame, key: str, stamp: str, labelled) -> DataFrame:
    return events.where(labelled).groupBy(key).agg(F.max(stamp).alias("labeled_at"))


def eligibility(commits: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Eligible: labelled, and the last commit is strictly before the latest label."""
    return commits.join(labels, key, "left").select(key, F.coalesce(F.col("committed_at") < F.col("labeled_at"), F.lit(False)).alias("eligible"))


def queue(pulls: DataFrame, number: int | None = None, verify: bool = True, label: str = "verified") -> DataFrame:
    """Pull requests with the label that aren't drafts. One asked for by number may be a draft."""
    found = pulls.where(F.coalesce(F.exists(F.coalesce("labels", F.array()), lambda x: x["name"] == label), F.lit(False))) if verify else pulls
    return found.where(F.col("number") == number).limit(1) if number is not None else found.where(~F.coalesce("draft", F.lit(False)))


def measured(runs: DataFrame, key: str, value: str, limit: float = 5.0) -> DataFrame:
    """The mean, or for means under the limit the minimum, cut to milliseconds."""
    mean = F.avg(value)
    secs = F.when(mean < limit, F.min(value)).otherwise(mean)
    return runs.groupBy(key).agg((F.floor(secs * F.lit(1000.0)) / F.lit(1000.0)).alias("secs"))


def result_seconds(document: Column, schema: str) -> Column:
    """mean and least seconds of the first result in a benchmark's JSON document; nulls where it has none."""
    first = F.get(F.from_json(document, schema)["results"], F.lit(0))
    return F.struct(first["mean"].alias("mean"), first["min"].alias("least"))


def status(*cases):
    """The first case whose condition holds: (condition, name) pairs, then a name."""
    *conditions, last = cases
    out = None
    for condition, name in conditions:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(last)
