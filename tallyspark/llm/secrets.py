"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Base spans come from three fixed patterns. Further candidates are long mixed runs that no base span touches. The values of all
candidates are hashed, and each hash is counted over distinct repositories and distinct owners: a value that more than
`max_owners` owners or `max_repos` repositories hold is a widely copied example, one that stays with its owner looks live. Owner-specific weak candidates
become spans of the kind `token`; widely copied ones do not. Base spans stay whatever their class, which is reported.

Defined results: a null text is empty and has no spans; null owners or repositories count as one unnamed owner; repeated rows
are scanned one by one and count once in ownership; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored, table

#: Fixed patterns: kind, expression, group of the value, least characters of that group.
ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = [("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]
#: Weak candidates: 20 or more characters with a digit and letters of both cases.
WEAK = ("token", "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}", 0, 20)
KINDS = [x[0] for x in (*BASE, WEAK)]
MAX_OWNERS, MAX_REPOS = 1, 3


def spans(text: Column, kind: str) -> Column:
    """Array of (start, kind, end, hash of the value) of the kind's matches, leftmost and not overlapping. Matches are what
    stands between the pieces that split() leaves, so their places follow from the pieces' lengths."""
    _, pattern, group, least = next(x for x in (*BASE, WEAK) if x[0] == kind)
    # rlike first: few texts have matches
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,hash:string>>)")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("n"), value.alias("value"))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (acc["at"] + x["gap"] + x["n"]).alias("end"), F.sha2(x["value"], 256).alias("hash"), F.length(x["value"]).alias("len")))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,kind:int,end:int,hash:string,len:int>>)").alias("out"))
    found = F.aggregate(rows, start, step, lambda acc: F.transform(F.filter(acc["out"], lambda s: s["len"] >= least), lambda s: s.dropFields("len")))
    return F.when(text.rlike(pattern), found).otherwise(none)


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", repo: list[str] | None = None) -> DataFrame:
    """docs with base (array of base spans), weak (array of weak candidates), row_key, owner_key and repo_key."""
    t = F.coalesce(F.col(text), F.lit(""))
    clear = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = docs.withColumn("base", F.array_sort(F.concat(*(spans(t, k[0]) for k in BASE))))
    out = out.withColumn("weak", F.filter(spans(t, WEAK[0]), clear))
    return out.withColumn("owner_key", named(owner)).withColumn("repo_key", F.concat_ws("\x01", *(named(c) for c in repo or [owner]))).withColumn("row_key", F.sha2(t, 256))


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """hash, n_repos, n_owners, live: over the whole corpus. Distinct (hash, repository, owner) are made on the map side first."""
    each = found.select(F.explode(F.concat("base", "weak")).alias("s"), "repo_key", "owner_key").select("s.hash", "repo_key", "owner_key").distinct()
    repos = each.groupBy("hash", "owner_key").agg(F.count("*").alias("r"))
    return repos.groupBy("hash").agg(F.sum("r").alias("n_repos"), F.count("*").alias("n_owners")).withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def judged(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """row_key, added (array of owner-specific weak candidates), n_live, n_example (distinct values by class): a row for each distinct
    text with any candidate. found: a stored result of candidates()."""
    texts = found.where(F.size("base") + F.size("weak") > 0).groupBy("row_key").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    each = stored(texts.select("row_key", F.explode(F.concat("base", "weak")).alias("s")).select("row_key", "s", F.col("s.hash").alias("hash")), "secret-candidates")
    told = skew_join(each, ownership(found, max_owners, max_repos).select("hash", "live"), "hash")
    weak = F.col("s.kind") == len(BASE)
    return told.groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.when(weak & F.col("live"), F.col("s")))).alias("added"),
        F.count_distinct(F.when(F.col("live"), F.col("hash"))).alias("n_live"),
        F.count_distinct(F.when(~F.col("live"), F.col("hash"))).alias("n_example"),
    )


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: list[str] | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with base, added (arrays of spans), n_live and n_example."""
    keep = keep or ["doc_id"]
    found = stored(candidates(docs, text, owner, repo).select(*keep, "base", "weak", "row_key", "owner_key", "repo_key"), "secret-spans")
    some = F.size("base") + F.size("weak") > 0
    told = stored(judged(found, max_owners, max_repos), "secret-judged")
    hit = skew_join(found.where(some), told, "row_key").select(*keep, "base", "added", "n_live", "n_example")
    rest = found.where(~some).select(*keep, "base", F.col("weak").alias("added"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"))
    return hit.unionByName(rest)


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repo: list[str] | None = None, mark: str = "[SECRET]", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """docs with every span, base or added, replaced by a mark. Columns stay as they are."""
    cols = docs.columns
    found = stored(candidates(docs.select(text, owner, *[c for c in repo or [] if c not in (text, owner)]), text, owner, repo).where(F.size("base") + F.size("weak") > 0).select("base", "weak", "row_key", "owner_key", "repo_key"), "secret-spans")
    told = stored(judged(found, max_owners, max_repos).join(found.groupBy("row_key").agg(F.first("base").alias("base")), "row_key").select("row_key", F.array_sort(F.concat("base", "added")).alias("_spans")), "secret-judged")
    t = F.coalesce(F.col(text), F.lit(""))
    hits = F.lit(False)
    for _, pattern, _, _ in (*BASE, WEAK):
        hits = hits | t.rlike(pattern)
    keyed = docs.select(F.struct(*cols).alias("_doc"), F.sha2(t, 256).alias("row_key"), hits.alias("_hit"))
    old = F.col(f"_doc.`{text}`")
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(old, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out")))
    new = F.aggregate(F.col("_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(old, acc["at"] + 1, F.length(old))))
    some = stored(keyed.where("_hit"), "secret-hits")
    done = skew_join(some, told, "row_key", "left").select(F.col("_doc").withField(text, F.coalesce(F.when(F.size("_spans") > 0, new), old)).alias("_doc"))
    return keyed.where("not _hit").select("_doc").unionByName(done).select("_doc.*")


def _line(spans_: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), repo=["source", "lang"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_example")


def _sql_spans(kind: int, pattern: str, group: int, least: int) -> str:
    """Rows r, kind, a, e, v of a kind's matches: they stand between the pieces that splitting leaves."""
    p = pattern.replace("'", "''")
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    return f"""select r, {kind} as kind, ({size("s[1:i]")} + {size("m[1:i - 1]")})::bigint as a, ({size("s[1:i]")} + {size("m[1:i]")})::bigint as e, g[i] as v
  from (select r, regexp_split_to_array(t, '{p}') as s, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {group}) as g from d) x, unnest(range(1, len(m) + 1)) n(i)
  where length(g[i]) >= {least}"""


_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_SHOWN = f"{_NAMES}[kind + 1] || ':' || a || ':' || e"
OP6_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source, '') as owner, coalesce(lang, '') as lang from documents),
base as ({" union all ".join(_sql_spans(k, *x[1:]) for k, x in enumerate(BASE))}),
runs as ({_sql_spans(len(BASE), "[A-Za-z0-9+/_-]{20,}", 0, 20)}),
weak as (select * from runs where regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')
  and not exists (select 1 from base b where b.r = runs.r and b.a < runs.e and runs.a < b.e)),
found as (select * from base union all select * from weak),
own as (select v, count(distinct owner) <= {MAX_OWNERS} and count(distinct owner || chr(1) || lang) <= {MAX_REPOS} as live from found join d using (r) group by v),
told as (select found.*, live from found join own using (v)),
one as (select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  coalesce(string_agg({_SHOWN}, ',' order by a, kind, e) filter (kind < {len(BASE)}), '') as base,
  coalesce(string_agg({_SHOWN}, ',' order by a, kind, e) filter (kind < {len(BASE)} or live), '') as spans,
  count(distinct v) filter (live) as n_live, count(distinct v) filter (not live) as n_example from told group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_example, 0)::bigint as n_example from d left join one using (r)
"""
