"""The registered queries in DuckDB SQL, written independently of the Spark code."""

from verification.snapshot_view import (
    BASE_CTES,
    BROKEN_CTES,
    CALL_CTES,
    CUT_CTES,
    DAMAGED_CTES,
    KIND_CTES,
    LIST_CTES,
    ODD_CTES,
)
from workload_lens.config import CONTEXT_PATTERNS
from workload_lens.schemas import METRICS

TIMINGS = [m for m in METRICS if m.endswith("_time")]
COUNTERS = [m for m in METRICS if not m.endswith("_time")]
KEY = "window_start, window_end, project, environment, cluster, role, fqdn"
ADDITIVE = COUNTERS + ["total_time", "blk_read_time", "blk_write_time"]


def f7(expr: str, name: str | None = None) -> str:
    """Seven significant digits, as the Spark side does it."""
    value = f"case when abs({expr}) < 1e-9 then 0.0 else ({expr})::float::double end"
    return f"{value} as {name or expr}"


def hid(*parts: str) -> str:
    """60-bit id of a natural key; NULL if a part is NULL."""
    text = " || chr(31) || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


def context(label: str) -> str:
    pattern = CONTEXT_PATTERNS[label]
    group = 2 if "(_" in pattern else 1
    return (
        f"case when regexp_matches(query, '{pattern}')"
        f" then regexp_extract(query, '{pattern}', {group}) end as {label}"
    )


def canonical(q: str, collapse: bool = False) -> str:
    """What the fingerprint of the statements of the test data comes down to."""
    x = rf"regexp_replace({q}, '/\*.*?\*/', ' ', 'g')"
    x = rf"regexp_replace({x}, '\$\d+|\b\d+\b', '?', 'g')"
    x = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    x = rf"""regexp_replace({x}, ' ?([^\w\s"$?]) ?', '\1', 'g')"""
    x = f"lower(trim({x}))"
    x = rf"regexp_replace({x}, '\b(from )\w+\.', '\1some_schema.', 'g')"
    x = rf"regexp_replace({x}, '(\w+)_temp_table_[0-9a-z]{{6,}}', '\1_temp_table_x', 'g')"
    x = rf"regexp_replace({x}, '(\w+)_cursor_[0-9a-z]+', '\1_cursor_x', 'g')"
    if collapse:
        x = rf"regexp_replace({x}, '\bin\(\?(,\?)+\)', 'in(?)', 'g')"
        x = rf"regexp_replace({x}, '\bvalues(\([^()]*\))(,\([^()]*\))+', 'values\1', 'g')"
    return x


DAY = "observed_date::varchar as observed_date"
MASKED = r"regexp_replace(query, '\$\d+|\b\d+\b', '?', 'g')"

_GROUPED = ", ".join(f"sum({m}) as {m}" for m in ADDITIVE)


def merged_cte(name: str, keys: str) -> str:
    """Merged statements; means and deviations are those of the single calls."""
    return f""",
{name}_sums as (
  select {keys}, {_GROUPED}, min(min_time) as min_time, max(max_time) as max_time
  from st group by {keys}),
{name}_calls as (
  select {keys}, avg(value) as mean_time, stddev_pop(value) as stddev_time from one group by {keys}),
{name} as (select * from {name}_sums join {name}_calls using ({keys}))"""


_ONE = """select ws as window_start, ws + interval '1' day as window_end, 'shop' as project,
  'production' as environment, concat('c', cl) as cluster,
  case when ro = 0 then 'primary' else 'secondary' end as role,
  concat('db-c', cl, '-', ro, '.example') as fqdn, fingerprint, value
from stmt join lab on stmt.query = lab.query"""


LABELLED = f"""{BASE_CTES},
txt as (select query, count(*) as rows_seen, min(window_start) as first_seen from snap group by query),
lab as (
  select query, rows_seen, first_seen, md5({canonical("query")}) as fingerprint,
    {", ".join(context(c) for c in CONTEXT_PATTERNS)}
  from txt),
st as (select s.*, l.fingerprint, l.controller, l.action, l.job_tag
       from snap s join lab l on s.query = l.query),
one as ({_ONE})"""

MERGED = LABELLED + merged_cte("merged", KEY + ", fingerprint")

EVENT_ID = hid(
    "fingerprint", "project", "environment", "cluster", "role", "fqdn", "epoch_us(window_start)::varchar"
)
LOGICAL_ID = hid("project", "environment", "cluster", "role")

STAR = f"""{MERGED},
ctx as (select {KEY}, fingerprint, controller, action, job_tag, sum(calls)::bigint as c
        from st group by all having sum(calls) > 0),
ev as (
  select {EVENT_ID} as id, {hid("fingerprint")} as fingerprint_id, {LOGICAL_ID} as logical_source_id,
    {hid("fqdn")} as physical_source_id, window_start as observed_window_start,
    window_end as observed_window_end, calls, total_time as time,
    cast(window_start as date) as observed_date
  from merged),
ec as (
  select {EVENT_ID} as event_id, {hid("fingerprint")} as fingerprint_id,
    {LOGICAL_ID} as logical_source_id, window_start as observed_window_start,
    window_end as observed_window_end, {hid("controller")} as controller_id,
    {hid("action")} as action_id, {hid("job_tag")} as job_tag_id, c,
    cast(window_start as date) as observed_date
  from ctx),
controllers as (select distinct {hid("controller")} as id, controller from lab where controller is not null),
actions as (select distinct {hid("action")} as id, action from lab where action is not null),
job_tags as (select distinct {hid("job_tag")} as id, job_tag from lab where job_tag is not null),
logical_sources as (
  select 0::bigint as id, 'all' as project, 'all' as environment, 'all' as cluster, 'all' as role
  union all
  select distinct {LOGICAL_ID}, project, environment, cluster, role from snap),
physical_sources as (select distinct {hid("fqdn")} as id, fqdn from snap),
fingerprints as (
  select {hid("fingerprint")} as id, fingerprint, {MASKED} as normalized
  from (select fingerprint, query,
          row_number() over (partition by fingerprint order by first_seen, query) as nth from lab)
  where nth = 1)"""

_SAMPLES = " union all ".join(
    f"select {hid('fingerprint')} as fingerprint_id, source as logical_source_id, "
    f"'{m}' as type, window_end, {m} as v from both_sources"
    for m in METRICS
)


def stats_cte(merged: str = "merged") -> str:
    return f""",
both_sources as (
  select *, 0::bigint as source from {merged}
  union all select *, {LOGICAL_ID} as source from {merged}),
samples as ({_SAMPLES}),
stats as (
  select fingerprint_id, logical_source_id, type, count(*) as count, avg(v) as mean,
    coalesce(stddev_samp(v), 0) as deviation, max(window_end) as last
  from samples group by fingerprint_id, logical_source_id, type)"""


STATS = STAR + stats_cte()
STATS_SELECT = (
    f"select fingerprint_id, logical_source_id, type, count, {f7('mean')}, {f7('deviation')}, last from stats"
)

# The reporting period: three days up to the end of the data, cluster c1.
def period(table: str) -> str:
    return (
        f"{table}.observed_window_start >= timestamp '2024-01-28'"
        f" and {table}.observed_window_end <= timestamp '2024-01-31'"
    )


PERIOD_STAR = f"""{STAR},
sources as (select * from logical_sources
            where project = 'shop' and environment = 'production' and cluster = 'c1'),
pe as (select ev.* from ev join sources on sources.id = logical_source_id where {period('ev')}),
totals as (
  select fingerprint_id, sum(calls) as calls, sum(time) as total_ms,
    sum(time) / sum(calls) as avg_ms_per_call from pe group by fingerprint_id)"""


def top_cte(by: str) -> str:
    return f""",
top as (
  select fingerprint_id, calls, {f7("total_ms")}, {f7("avg_ms_per_call")} from totals
  order by {by} desc, fingerprint_id limit 20)"""


def contexts_cte() -> str:
    """Context rows of the events of the top fingerprints, joined by event id."""
    return f""",
tc as (
  select ec.* from ec join pe on pe.id = ec.event_id
  where ec.fingerprint_id in (select fingerprint_id from top) and {period('ec')}),
times as (select fingerprint_id, controller_id, action_id, job_tag_id, sum(c)::bigint as times
          from tc group by all),
ranked as (
  select *, row_number() over (partition by fingerprint_id order by times desc,
    controller_id nulls last, action_id nulls last, job_tag_id nulls last) as r from times
  qualify r <= 5),
named as (
  select fingerprint_id, times, r, controller, action, job_tag from ranked
  left join controllers on controller_id = controllers.id
  left join actions on action_id = actions.id
  left join job_tags on job_tag_id = job_tags.id),
as_json as (
  select fingerprint_id, to_json(list(struct_pack(times := times, controller := controller,
    action := action, job_tag := job_tag) order by r))::varchar as context
  from named group by fingerprint_id)"""


def role_cte(keys: list[str], weight: str = "calls") -> str:
    ids = ", ".join(f"{k}_id" for k in keys)
    some = " or ".join(f"ec.{k}_id is not null" for k in keys)
    match = " and ".join(f"p.{k}_id = s.{k}_id" for k in keys)
    pick = ", ".join(f"p.{k}_id" for k in keys)
    return f""",
by_role as (
  select cluster, role, {ids}, sum({weight}) as calls
  from ev join logical_sources l on l.id = ev.logical_source_id
  join ec on ec.event_id = ev.id
  where project = 'shop' and environment = 'production' and {period('ev')} and ({some})
  group by cluster, role, {ids}),
pairs as (
  select p.cluster, {pick}, p.calls as primary_calls, s.calls as secondary_calls
  from by_role p join by_role s on p.cluster = s.cluster and {match}
  where p.role = 'primary' and s.role = 'secondary')"""


def role_share(keys: list[str], weight: str = "calls") -> str:
    joins = " ".join(f"left join {k}s on {k}s.id = pairs.{k}_id" for k in keys)
    total = "(primary_calls + secondary_calls)"
    return f"""with {STAR}{role_cte(keys, weight)}
select {", ".join(keys)}, cluster, {total} as total_calls,
  {f7(f"primary_calls / {total} * 100", "primary_percentage")},
  {f7(f"secondary_calls / {total} * 100", "secondary_percentage")}
from pairs {joins}"""


def report_top(by: str) -> str:
    average = "round(t.avg_raw, 1)" if by == "calls" else "t.avg_raw"
    return f"""with {PERIOD_STAR},
top as (
  select fingerprint_id, calls, total_ms, avg_ms_per_call as avg_raw from totals
  order by {by} desc, fingerprint_id limit 20){contexts_cte()}
select t.calls, {f7("t.total_ms", "total_ms")}, {f7(average, "avg_ms_per_call")},
  left(replace(normalized, chr(10), ' '), 250) as example, context
from top t join fingerprints f on f.id = t.fingerprint_id
join as_json j on j.fingerprint_id = t.fingerprint_id"""


REPORT_VS_HISTORY = f"""with {PERIOD_STAR}{stats_cte()},
top as (
  select fingerprint_id, avg(time) as avg_ms from pe group by fingerprint_id
  order by avg_ms desc, fingerprint_id limit 20){contexts_cte()},
history as (
  select distinct mean, deviation, s.logical_source_id, s.fingerprint_id
  from stats s join top on top.fingerprint_id = s.fingerprint_id
  join sources on s.logical_source_id = 0 or s.logical_source_id = sources.id
  where type = 'total_time')
select {f7("avg_ms", "avg_ms_this_window")}, {f7("mean", "avg_ms_overall")},
  {f7("deviation", "deviation_ms_overall")}, l.project, l.environment, l.cluster, l.role,
  left(replace(normalized, chr(10), ' '), 150) as example, context
from top join fingerprints f on f.id = top.fingerprint_id
join history h on h.fingerprint_id = top.fingerprint_id
join logical_sources l on l.id = h.logical_source_id
join as_json j on j.fingerprint_id = top.fingerprint_id"""

_SNAP_COLUMNS = f"{KEY}, userid, dbid, query, " + ", ".join(
    f7(m) if m in TIMINGS else m for m in METRICS
)
SNAPSHOTS = f"with {BASE_CTES} select {_SNAP_COLUMNS} from snap"

RANKED = f"""{BASE_CTES},
r7 as (select {_SNAP_COLUMNS} from snap)"""
_RANKS = ", ".join(
    f"row_number() over (partition by {KEY} order by {m} desc nulls first, md5(query), userid, dbid)"
    f" as r_{m}"
    for m in METRICS
)

_TUMBLING = f"""with {CALL_CTES},
six as (select date_trunc('day', ts) + to_hours(6 * (hour(ts) // 6)) as window_start, * from call)
select window_start, window_start + interval '6 hours' as window_end, project, environment,
  cluster, role, fqdn, userid, dbid, query, count(*)::double as calls,
  {f7("sum(duration)", "total_time")}, {f7("min(duration)", "min_time")},
  {f7("max(duration)", "max_time")}, {f7("avg(duration)", "mean_time")},
  {f7("stddev_pop(duration)", "stddev_time")}, sum(rows)::double as rows
from six group by window_start, project, environment, cluster, role, fqdn, userid, dbid, query"""

_REASON = """case when query = '' then 'empty'
  when query like '%''cut' and regexp_matches(query, '_temp_table_[0-9a-z]{6}|_cursor_[0-9a-z]')
  then 'unfingerprintable' end"""
BROKEN = f"""{BROKEN_CTES},
judged as (
  select *, {_REASON} as reject_reason,
    case when {_REASON} is null then md5(case when query like '%''cut' then query
      else {canonical("query")} end) end as fingerprint
  from broken)"""


def _fk(column: str, table: str, fact: str = "ec") -> str:
    return f"""select '{column}' as column_name, {column} as id, count(*) as uses from {fact}
      where {column} is not null and {column} not in (select id from {table}) group by {column}"""


_ODD_RULES = """concat_ws(',',
  case when project is null then 'not_null_project' end,
  case when role is null then 'not_null_role' end,
  case when not window_end > window_start then 'window_order' end)"""


def dim(table: str) -> str:
    return f"with {STAR} select * from {table}"


ORACLES: dict[str, str] = {
    "snapshot_scan": SNAPSHOTS,
    "snapshot_adapt_v13": SNAPSHOTS,
    "events_fact": f"with {STAR} select * replace ({f7('time')}, {DAY}) from ev",
    "event_context_fact": f"with {STAR} select * replace ({DAY}) from ec",
    **{
        f"dim_{t}": dim(t)
        for t in (
            "logical_sources",
            "physical_sources",
            "fingerprints",
            "controllers",
            "actions",
            "job_tags",
        )
    },
    "retention_kept": f"""with {STAR}
      select {DAY}, count(*) as events, sum(calls) as calls from ev
      where ev.observed_date >= date '2024-01-10' group by ev.observed_date""",
    "check_violations": f"""with {DAMAGED_CTES},
      judged as (select *, concat_ws(',',
          case when query is null then 'not_null_query' end,
          case when not c > 0 then 'positive_count' end,
          case when not window_end > window_start then 'window_order' end) as violations
        from damaged)
      select * from judged where violations <> ''""",
    "unique_violations": f"""with {LABELLED}
      select window_start, cluster, role, fingerprint, count(*) as copies from st
      group by all having count(*) > 1""",
    "fk_violations": f"""with {STAR},
      known_controllers as (select id from controllers where controller <> 'click'),
      known_job_tags as (select id from job_tags where job_tag not in ('j1', 'j3'))
      {_fk("controller_id", "known_controllers")}
      union all {_fk("action_id", "actions")}
      union all {_fk("job_tag_id", "known_job_tags")}""",
    "stats_domain_complete": f"""with {STATS}
      select fingerprint_id, logical_source_id, count(distinct type) as known_types,
        count(*) as stored_types from stats
      where not (type = 'rows' and fingerprint_id % 2 = 0)
      group by fingerprint_id, logical_source_id having count(*) <> 19""",
    "fingerprint_rejects": f"""with {BROKEN}
      select window_start, cluster, role, query, calls, reject_reason from judged
      where reject_reason is not null""",
    "fingerprint": f"with {LABELLED} select query, rows_seen, fingerprint from lab",
    "normalized_text": f"with {LABELLED} select query, rows_seen, {MASKED} as normalized from lab",
    "context_extract": f"""with {LABELLED}
      select query, rows_seen, controller, action, job_tag from lab""",
    "statement_preview": f"with {LABELLED} select query, left(query, 60) as preview from lab",
    "collapse_in_list": f"""with {LIST_CTES}
      select {canonical("query", collapse=True)} as collapsed, count(distinct query) as texts,
        count(*) as calls from lists group by 1""",
    "window_merge": f"""with {MERGED}
      select {KEY}, fingerprint, {", ".join(f7(m) if m in TIMINGS else m for m in METRICS)}
      from merged""",
    "pooled_moments": f"""with {LABELLED}{merged_cte("pooled", "fingerprint")}
      select fingerprint, calls, {f7("mean_time")}, {f7("stddev_time")} from pooled""",
    "tumbling_window_stats": _TUMBLING,
    "window_gaps": f"""with {CUT_CTES},
      g as (select *, epoch_us(window_end) / 1e6 - epoch_us(window_start) / 1e6 as width_seconds,
          epoch_us(window_start) / 1e6 - lag(epoch_us(window_end)) over (
            partition by project, environment, cluster, role, fqdn order by window_start) / 1e6
            as gap_seconds
        from cut)
      select *, width_seconds > 86000 or coalesce(gap_seconds, 0) > 0 as overrun from g""",
    "window_quality": f"""with {BROKEN}
      select {KEY}, count(*) as statements, count(distinct fingerprint) as unique_fingerprints,
        count(reject_reason) as rejected from judged group by {KEY}""",
    "topk_calls": f"""with {RANKED}
      select window_start, window_end, cluster, role, userid, dbid, query, calls from r7
      qualify row_number() over (partition by {KEY}
        order by calls desc nulls first, md5(query), userid, dbid) <= 5""",
    "topk_union": f"""with {RANKED}, ranks as (select *, {_RANKS} from r7)
      select distinct {KEY}, userid, dbid, query, {", ".join(METRICS)} from ranks
      where least({", ".join(f"r_{m}" for m in METRICS)}) <= 5""",
    "fingerprint_stats": f"with {STATS} {STATS_SELECT}",
    "fingerprint_stats_merge": f"with {STATS} {STATS_SELECT}",
    "lifetime_counters": f"""with {MERGED},
      w as (select fingerprint, window_start, sum(calls) as calls, sum(total_time) as total_time
            from merged group by fingerprint, window_start)
      select fingerprint, window_start,
        sum(calls) over (partition by fingerprint order by window_start) as calls_since_start,
        {f7("sum(total_time) over (partition by fingerprint order by window_start)", "time_since_start")}
      from w""",
    "window_containment_filter": f"""with {STAR}
      select * replace ({f7("time")}, {DAY}) from ev where {period('ev')}""",
    "fingerprint_totals": f"""with {PERIOD_STAR}
      select fingerprint_id, calls, {f7("total_ms")}, {f7("avg_ms_per_call")} from totals""",
    "fingerprint_window_avg": f"""with {PERIOD_STAR}
      select fingerprint_id, {f7("avg(time)", "avg_ms")} from pe group by fingerprint_id""",
    "event_ids_by_fingerprint": f"""with {PERIOD_STAR}
      select fingerprint_id, logical_source_id, {DAY},
        string_agg(id::varchar, ',' order by id) as event_ids from pe group by all""",
    "top_fingerprints_by_calls": f"with {PERIOD_STAR}{top_cte('calls')} select * from top",
    "top_fingerprints_by_time": f"with {PERIOD_STAR}{top_cte('total_ms')} select * from top",
    "context_for_top_events": f"""with {PERIOD_STAR}{top_cte("calls")}{contexts_cte()}
      select * replace ({DAY}) from tc""",
    "context_totals": f"with {PERIOD_STAR}{top_cte('calls')}{contexts_cte()} select * from times",
    "top_contexts": f"with {PERIOD_STAR}{top_cte('calls')}{contexts_cte()} select * from ranked",
    "context_labels": f"""with {STAR}
      select event_id, fingerprint_id, logical_source_id, observed_window_start,
        observed_window_end, c, controller, action, job_tag from ec
      left join controllers on controller_id = controllers.id
      left join actions on action_id = actions.id
      left join job_tags on job_tag_id = job_tags.id""",
    "context_json": f"with {PERIOD_STAR}{top_cte('calls')}{contexts_cte()} select * from as_json",
    "stats_for_sources": f"""with {PERIOD_STAR}{stats_cte()}
      select distinct fingerprint_id, logical_source_id, count, {f7("mean")}, {f7("deviation")}
      from stats join sources on logical_source_id = 0 or logical_source_id = sources.id
      where type = 'total_time'""",
    "role_utilization_job_tag": f"with {STAR}{role_cte(['job_tag'])} select * from pairs",
    "role_utilization_controller_action": f"""with {STAR}{role_cte(["controller", "action"])}
      select * from pairs""",
    "report_most_frequent": report_top("calls"),
    "report_most_time": report_top("total_ms"),
    "report_vs_history": REPORT_VS_HISTORY,
    "report_role_share_job": role_share(["job_tag"]),
    "report_role_share_action": role_share(["controller", "action"]),
    "report_role_share_job_by_context": role_share(["job_tag"], "c::double"),
    "ad_hoc_sql": f"""with {STAR}
      select fqdn, {DAY}, count(distinct fingerprint_id) as fingerprints,
        sum(calls) as calls, {f7("sum(time)", "total_ms")}
      from ev join physical_sources p on p.id = physical_source_id
      group by fqdn, ev.observed_date""",
    "streaming_tumbling_stats": _TUMBLING,
    "streaming_ingest_stats": f"with {STATS} {STATS_SELECT}",
    "stats_upsert": f"with {STATS} {STATS_SELECT}",
    "stats_since": f"""with {STAR},
      kept as (select * from merged where window_start >= timestamp '2024-01-16'){stats_cte("kept")}
      {STATS_SELECT}""",
    "ingest_window_in_pieces": f"with {STAR} select * replace ({f7('time')}, {DAY}) from ev",
    "ingest_pieces_stats": f"with {STATS} {STATS_SELECT}",
    "ingest_redelivery": f"with {STAR} select * replace ({DAY}) from ec",
    "ingest_batch_rewritten": f"""with {STAR}
      select * replace ({f7('time')}, {DAY}) from ev where ev.observed_date < date '2024-01-21'""",
    "ingest_rejects": f"""with {ODD_CTES},
      judged as (select *, {_ODD_RULES} as broken from odd)
      select {KEY}, query, case when broken <> '' then broken else 'empty' end as reject_reason,
        count(*) as statements, cast(window_start as date)::varchar as observed_date
      from judged where broken <> '' or query = '' group by all""",
    "ingest_quality": f"""with {ODD_CTES},
      judged as (select *, {canonical("query")} as form from odd where {_ODD_RULES} = '')
      select {KEY}, count(*) as statements,
        count(distinct case when query <> '' then form end) as unique_fingerprints,
        sum(case when query = '' then 1 else 0 end)::bigint as rejected from judged group by {KEY}""",
    "dim_fingerprints_upsert": dim("fingerprints"),
    "fk_violations_events": f"""with {STAR},
      some_fingerprints as (select id from fingerprints where id % 3 <> 0),
      some_hosts as (select id from physical_sources where id % 2 <> 0)
      {_fk("fingerprint_id", "some_fingerprints", "ev")}
      union all {_fk("logical_source_id", "logical_sources", "ev")}
      union all {_fk("physical_source_id", "some_hosts", "ev")}""",
    "fk_violations_stats": f"""with {STATS},
      some_fingerprints as (select id from fingerprints where id % 3 <> 0),
      some_sources as (select id from logical_sources where id <> 0)
      {_fk("fingerprint_id", "some_fingerprints", "stats")}
      union all {_fk("logical_source_id", "some_sources", "stats")}""",
    "fingerprint_statement_kinds": f"""with {KIND_CTES}
      select case kind when 0 then 'set role some_role'
        when 1 then 'grant select on ' || event_type || ' to some_role'
        when 2 then 'lock table some_schema.' || event_type || ',some_schema.other in share mode'
        when 3 then 'truncate some_schema.x,y,some_schema.' || event_type
        when 4 then 'alter sequence some_schema.' || event_type || ' restart with ?'
        when 5 then 'create index some_index on some_schema.some_table(' || event_type || ')'
        when 6 then 'select table_7,index_8 from some_schema.some_table join ' || event_type || ' using(a)'
        when 7 then 'move ? from ' || event_type || '_cursor_x'
        else 'alter table ' || event_type || ' owner to some_role' end as form,
        count(distinct query) as texts, count(*) as calls from kinds group by 1""",
    "context_custom_patterns": f"""with {KIND_CTES}
      select distinct query, regexp_extract(query, 'tenant.(t[0-9])', 1) as controller,
        null::varchar as action, null::varchar as job_tag from kinds""",
    "window_merge_shifted": f"""with {LABELLED}
      select {KEY}, fingerprint, count(*)::double as calls,
        round(stddev_pop(value + 1e10) + 0.0314, 1) as stddev_near
      from one group by {KEY}, fingerprint""",
}
