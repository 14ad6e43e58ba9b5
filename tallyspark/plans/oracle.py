"""SQL for DuckDB that gives the queries' rows. SHARED stands in front of each."""

SHARED = """
with visits as (select e.event_id, e.event_type, p.url,
    regexp_extract(p.url,'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)',1) as path, cast(e.ts as date) as day
  from events e cross join (select count(*) as c from pages) n join pages p on p.page_id = e.event_id % n.c),
runs as (select event_id, ts, cast(user_id as string) as branch, value as secs from events where value is not null),
entrants as (select branch, min(secs) as secs, min(floor(secs*100)/100) as checkpoint
  from runs where branch not in ('1','2') group by branch),
reached as (select e.branch, e.secs, e.checkpoint, min(r.ts) as reached_at from entrants e
  join runs r on r.branch = e.branch and floor(r.secs*100)/100 = e.checkpoint group by e.branch, e.secs, e.checkpoint),
seen as (select branch, min(ts) as first_ts, arg_min(event_id, (ts, event_id)) as first_id from runs group by branch),
fin as (select branch, secs, checkpoint, reached_at, cast(rnk as bigint) as rnk from (
    select branch, secs, checkpoint, reached_at, row_number() over (order by checkpoint, reached_at, first_ts, first_id) as rnk
    from (select *, dense_rank() over (order by checkpoint) as dr from reached) z join seen using (branch) where dr <= 3) y where rnk <= 3),
pulls as (select user_id * 1000 + dayofyear(ts) as number, user_id, cast(ts as date) as day, list(distinct event_type) as tags from events group by all),
boards as (select event_type, user_id || '@' || strftime(ts, '%Y-%m-%d') as contestant, min(value) as secs, min(ts) as first_ts from events group by all),
base as (select contestant, secs, first_ts from boards where event_type = 'click'),
inc as (select contestant, secs, first_ts from boards where event_type = 'view')
"""

QUERIES = {
    "daily_visits": """
select path, day, count(*) as visits from visits group by path, day
""",
    "daily_visits_nested": """
select path, '{' || string_agg('"'||day||'":'||n, ',' order by day) || '}' as doc
from (select path, cast(day as string) as day, count(*) as n from visits group by path, cast(day as string)) g group by path
""",
    "scan_visit_lines": """
select substring(line,1,length(line)-26) as url, substring(line,length(line)-24,10) as day from (
 select concat(v.url, ',', strftime(e.ts,'%Y-%m-%dT%H:%M:%S'), '+00:00') as line from visits v join events e on e.event_id = v.event_id) t
""",
    "page_dimension": """
select distinct path from visits
""",
    "running_best": """
select event_id, branch, min(secs) over (partition by branch order by ts, event_id rows between unbounded preceding and current row) as best from runs
""",
    "record_events": """
select event_id, branch, secs from (select *, min(secs) over (partition by branch order by ts, event_id
  rows between unbounded preceding and 1 preceding) as prev_best from runs) w where prev_best is null or secs < prev_best
""",
    "best_per_branch": """
select branch, secs, checkpoint from entrants
""",
    "checkpoint_reached": """
select branch, checkpoint, reached_at from reached
""",
    "distinct_checkpoints": """
select distinct checkpoint from entrants order by checkpoint limit 3
""",
    "checkpoint_bucket": """
select event_id, floor(secs*100)/100 as checkpoint from runs
""",
    "finalists": """
select rnk, branch, checkpoint, secs, reached_at from fin
""",
    "finalist_runs": """
select event_id, branch, secs from runs where branch in (select branch from fin)
""",
    "history_long": """
select d.entry_day, f.branch, min(r.secs) as secs from (select distinct cast(ts as date) as entry_day from runs where branch in (select branch from fin)) d
cross join fin f join runs r on r.branch = f.branch and cast(r.ts as date) <= d.entry_day group by d.entry_day, f.branch
""",
    "history_matrix": """
select entry_day, b1, b2, b3 from (
 select *, lag(b1) over (order by entry_day) as p1, lag(b2) over (order by entry_day) as p2, lag(b3) over (order by entry_day) as p3,
   row_number() over (order by entry_day) as rn from (
  select entry_day, min(b1) over (order by entry_day) as b1, min(b2) over (order by entry_day) as b2, min(b3) over (order by entry_day) as b3 from (
   select cast(r.ts as date) as entry_day, min(case when f.rnk=1 then r.secs end) as b1, min(case when f.rnk=2 then r.secs end) as b2,
     min(case when f.rnk=3 then r.secs end) as b3 from runs r join fin f on f.branch = r.branch group by cast(r.ts as date)) p) q) l
where rn = 1 or b1 is distinct from p1 or b2 is distinct from p2 or b3 is distinct from p3
""",
    "board_merge": """
select coalesce(b.contestant,i.contestant) as contestant, coalesce(b.first_ts,i.first_ts) as entry_ts,
  case when b.contestant is null then i.secs when i.secs < b.secs then i.secs else b.secs end as secs
from base b full outer join inc i on b.contestant = i.contestant
""",
    "board_new_entries": """
select contestant, secs from inc i where not exists (select 1 from base b where b.contestant = i.contestant)
""",
    "board_collapse": """
select user_id, max_by(value, event_id) as secs from events group by user_id
""",
    "board_ranked": """
select cast(row_number() over (order by secs, contestant) as bigint) as rnk, contestant, secs from base
""",
    "board_text": """
select concat_ws(',', contestant, printf('%.2f', secs)) as line from base
""",
    "latest_label": """
select user_id, max(ts) as labeled_at from events where event_type = 'signup' group by user_id
""",
    "eligibility_gate": """
select c.user_id, (l.labeled_at is not null and c.committed_at < l.labeled_at) as eligible
from (select user_id, max(ts) as committed_at from events where event_type = 'view' group by user_id) c
left join (select user_id, max(ts) as labeled_at from events where event_type = 'signup' group by user_id) l on l.user_id = c.user_id
""",
    "review_queue": """
select number, user_id, day from pulls where list_contains(tags, 'purchase') and not list_contains(tags, 'error')
""",
    "single_thread_subset": """
select event_id, branch, secs from runs where branch in (select branch from runs r join events e on e.event_id = r.event_id where e.event_type = 'purchase' and e.value < 1)
""",
    "queue_size": """
select count(*) as n from events where event_type = 'signup'
""",
    "measure_two_stage": """
select user_id, floor((case when avg(value) < 20 then min(value) else avg(value) end)*1000)/1000 as secs from events where event_type = 'click' group by user_id
""",
    "measure_json": """
select event_id, cast(json_extract_string(props,'$.k') as bigint) as k from events
""",
    "run_status": """
select event_id, case when value is null then 'no_result' when event_type = 'error' then 'run_failed' when value >= 300 then 'timeout' else 'ok' end as status from events
""",
    "validate_diff": """
select path, day, n, 'actual_only' as side from (select path,day,count(*) as n from visits group by path,day except select path,day,count(*) as n from visits where event_type <> 'error' group by path,day) x
union all select path, day, n, 'expected_only' as side from (select path,day,count(*) as n from visits where event_type <> 'error' group by path,day except select path,day,count(*) as n from visits group by path,day) y
""",
    "diff_ingest": """
select split_part(body,',',2) as branch, cast(split_part(body,',',3) as double) as secs from (
 select replace(substring(line,2),';',',') as body from (
  select case event_id % 6 when 0 then '+++ b/board.csv' when 1 then concat('-1,', user_id, ',', value) when 2 then '+'
    when 3 then '+entry_date,branch_name,time' when 4 then concat('+', event_id, ';', user_id, ';', value)
    else concat('+', event_id, ',', user_id, ',', value) end as line from events) a
 where line like '+%' and line not like '+++%') b
where body <> '' and body not like 'entry_date,%' and length(body) - length(replace(body,',','')) >= 2
""",
    "strip_ansi": """
select event_id, regexp_replace(concat(chr(27),'[31m',event_type,chr(27),'[0m'), '\\x1B(?:[@-Z\\-_]|\\[[0-?]*[ -/]*[@-~])', '', 'g') as msg from events
""",
    "encode_url": """
select o_orderkey, replace(url_encode(o_orderpriority),'%20','+') as enc from orders
""",
    "format_iso": """
select event_id, concat(strftime(ts,'%Y-%m-%dT%H:%M:%S'),'+00:00') as iso from events
""",
    "lenient_number": """
select event_id, coalesce(cast(nullif(regexp_extract(concat(cast(event_id as string), event_type),'^[0-9]+',0),'') as double),0.0) as num from events
""",
    "history_by_time": """
select entry_day, b1, b2, b3 from (
 select *, lag(b1) over (order by entry_day) as p1, lag(b2) over (order by entry_day) as p2, lag(b3) over (order by entry_day) as p3,
   row_number() over (order by entry_day) as rn from (
  select entry_day, min(b1) over (order by entry_day) as b1, min(b2) over (order by entry_day) as b2, min(b3) over (order by entry_day) as b3 from (
   select r.ts as entry_day, min(case when f.rnk=1 then r.secs end) as b1, min(case when f.rnk=2 then r.secs end) as b2,
     min(case when f.rnk=3 then r.secs end) as b3 from runs r join fin f on f.branch = r.branch group by r.ts) p) q) l
where rn = 1 or b1 is distinct from p1 or b2 is distinct from p2 or b3 is distinct from p3
""",
    "daily_report_document": """
select '{' || chr(10) || string_agg('    "' || replace(path, '/', '\\/') || '": {' || chr(10) || days || chr(10) || '    }', ',' || chr(10) order by path) || chr(10) || '}' as doc
from (select path, string_agg('        "' || day || '": ' || n, ',' || chr(10) order by day) as days from (select path, day, count(*) as n from visits group by path, day) g group by path) p
""",
    "page_fetch": """
select 10 * p + k as number, 't' || k as title from range(4) a(p), range(3) b(k)
""",
    "result_json": """
select event_id, value as mean, value / 2 as least from events
""",
    "change_log": """
select cast(user_id as varchar) as branch, value as secs, date_trunc('second', ts) as ts, cast(event_id as varchar) as hash, 1 as line_no from events
""",
}
