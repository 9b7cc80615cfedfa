"""Statement snapshots derived from the ``events`` table of the test data.

One window per day and six sources. The texts mix schemas, temp tables, cursors, fetch
counts and literals, with full, partial and missing context comments. The same text runs
in Spark and in DuckDB.
"""

from pyspark.sql import DataFrame, SparkSession

from workload_lens.session import tune
from workload_lens.sources.snapshots import as_snapshots

BASE_CTES = """
base as (
  select event_id, user_id, event_type, value,
         cast(regexp_extract(props, '[0-9]+', 0) as bigint) as k,
         cast(date_trunc('day', ts) as timestamp) as ws
  from events),
stmt as (
  select ws, user_id, user_id % 3 as cl, user_id % 2 as ro, value, k,
    concat(
      case when k % 10 = 0 then ''
           when k % 10 = 1 then concat('/*application:shop,controller:', event_type, ',action:a', cast(k % 5 as varchar(10)), '*/ ')
           else concat('/*application:shop,controller_with_namespace:', event_type, ',action:a', cast(k % 5 as varchar(10)), ',job_tag:j', cast(k % 7 as varchar(10)), '*/ ') end,
      case when k % 3 = 0 then concat('SELECT c', cast(k % 2 as varchar(10)), ' FROM s', cast(user_id % 4 as varchar(10)), '.', event_type, ' WHERE id = $1')
           when k % 3 = 1 then concat('select  c', cast(k % 2 as varchar(10)), ' from ', event_type, '_temp_table_abc', lpad(cast(k as varchar(10)), 3, '0'), ' where id = ', cast(k as varchar(10)))
           else concat('FETCH ', cast(k as varchar(10)), ' FROM ', event_type, '_cursor_', cast(user_id as varchar(10))) end) as query
  from base),
snap as (
  select ws as window_start, ws + interval '1' day as window_end,
    'shop' as project, 'production' as environment, concat('c', cast(cl as varchar(10))) as cluster,
    case when ro = 0 then 'primary' else 'secondary' end as role,
    concat('db-c', cast(cl as varchar(10)), '-', cast(ro as varchar(10)), '.example') as fqdn,
    ro + 10 as userid, cl + 1 as dbid, query, cast(count(*) as double) as calls,
    sum(value) as total_time, min(value) as min_time, max(value) as max_time,
    avg(value) as mean_time, stddev_pop(value) as stddev_time, cast(sum(k) as double) as rows,
    cast(sum(k * 3) as double) as shared_blks_hit, cast(sum(k % 7) as double) as shared_blks_read,
    cast(sum(k % 5) as double) as shared_blks_dirtied, cast(sum(k % 3) as double) as shared_blks_written,
    cast(sum(k % 11) as double) as local_blks_hit, cast(sum(k % 13) as double) as local_blks_read,
    cast(sum(k % 17) as double) as local_blks_dirtied, cast(sum(k % 19) as double) as local_blks_written,
    cast(sum(k % 23) as double) as temp_blks_read, cast(sum(k % 29) as double) as temp_blks_written,
    sum(value) * 0.25 as blk_read_time, sum(value) * 0.125 as blk_write_time
  from stmt group by ws, cl, ro, query)
"""


# Snapshots with rows that break constraints.
DAMAGED_CTES = (
    BASE_CTES
    + """,
damaged as (
  select window_start,
    case when cast(rows as bigint) % 7 = 3 then window_start else window_end end as window_end,
    cluster, role, userid, dbid,
    case when cast(rows as bigint) % 11 = 5 then null else query end as query,
    cast(calls as bigint) - cast(rows as bigint) % 2 as c, rows
  from snap)
"""
)

# Snapshots in which some statements are cut off or empty.
BROKEN_CTES = (
    BASE_CTES
    + """,
broken as (
  select window_start, window_end, project, environment, cluster, role, fqdn, userid, dbid, calls,
    case when cast(rows as bigint) % 17 = 4 then ''
         when cast(rows as bigint) % 5 = 2 then concat(query, ' and x = ''cut')
         else query end as query
  from snap)
"""
)

# Statements with lists of constants of different lengths.
LIST_CTES = (
    BASE_CTES
    + """,
lists as (
  select case when k % 2 = 0
      then concat('select * from t where k in (', cast(k as varchar(10)), repeat(', 7', cast(user_id % 4 as int)), ')')
      else concat('insert into t (a, b) values (', cast(k as varchar(10)), ', 1)', repeat(', (2, 3)', cast(user_id % 3 as int))) end as query
  from stmt)
"""
)

# Snapshots with rows that cannot be stored: without a label, with an empty window or text.
ODD_CTES = (
    BASE_CTES
    + """,
odd as (
  select * from (
    select window_start,
      case when cast(rows as bigint) % 13 = 6 then window_start else window_end end as window_end,
      case when cast(rows as bigint) % 7 = 3 then null else project end as project, environment, cluster,
      case when cast(rows as bigint) % 5 = 1 and cast(rows as bigint) % 2 = 0 then null else role end as role,
      fqdn, userid, dbid,
      case when cast(rows as bigint) % 17 = 4 then '' else query end as query,
      calls, total_time, min_time, max_time, mean_time, stddev_time, rows, shared_blks_hit, shared_blks_read,
      shared_blks_dirtied, shared_blks_written, local_blks_hit, local_blks_read, local_blks_dirtied,
      local_blks_written, temp_blks_read, temp_blks_written, blk_read_time, blk_write_time
    from snap) o)
"""
)

# Snapshots of calls that all take a very long time, in which a few milliseconds differ.
FAR_CTES = (
    BASE_CTES
    + """,
far as (
  select ws as window_start, ws + interval '1' day as window_end,
    'shop' as project, 'production' as environment, concat('c', cast(cl as varchar(10))) as cluster,
    case when ro = 0 then 'primary' else 'secondary' end as role,
    concat('db-c', cast(cl as varchar(10)), '-', cast(ro as varchar(10)), '.example') as fqdn,
    ro + 10 as userid, cl + 1 as dbid, query, cast(count(*) as double) as calls,
    sum(value + 1e10) as total_time, min(value + 1e10) as min_time, max(value + 1e10) as max_time,
    avg(value + 1e10) as mean_time, stddev_pop(value + 1e10) as stddev_time
  from stmt group by ws, cl, ro, query)
"""
)

# Statements of other kinds: roles, lists of relations, sequences, generated names, cursors.
KIND_CTES = (
    BASE_CTES
    + """,
kinds as (
  select k % 9 as kind, event_type, concat(case when k % 2 = 0 then '/*tenant:t' else '/*tenant=t' end, cast(user_id % 5 as varchar(10)), '*/ ',
    case k % 9
      when 0 then concat('SET ROLE r', cast(user_id as varchar(10)))
      when 1 then concat('grant select on ', event_type, ' to u', cast(user_id as varchar(10)), ', v', cast(k as varchar(10)))
      when 2 then concat('LOCK TABLE s', cast(user_id as varchar(10)), '.', event_type, ', s', cast(k as varchar(10)), '.other IN SHARE MODE')
      when 3 then concat('truncate s', cast(k as varchar(10)), '.x, y, s', cast(user_id as varchar(10)), '.', event_type)
      when 4 then concat('ALTER SEQUENCE s', cast(user_id as varchar(10)), '.', event_type, ' RESTART WITH ', cast(k as varchar(10)))
      when 5 then concat('create index index_', cast(k as varchar(10)), ' on s', cast(user_id as varchar(10)), '.table_', cast(k as varchar(10)), ' (', event_type, ')')
      when 6 then concat('select table_7, index_8 from s', cast(user_id as varchar(10)), '.table_', cast(k as varchar(10)), ' join ', event_type, ' using (a)')
      when 7 then concat('MOVE FORWARD ', cast(k as varchar(10)), ' FROM ', event_type, '_cursor_', cast(user_id as varchar(10)))
      else concat('alter table ', event_type, ' owner to u', cast(user_id as varchar(10))) end) as query
  from base)
"""
)

# Windows that reach from the first to the last call of a day.
CUT_CTES = """
cut as (
  select min(ts) as window_start, max(ts) + interval '1' second as window_end,
    'shop' as project, 'production' as environment,
    concat('c', cast(user_id % 3 as varchar(10))) as cluster,
    case when user_id % 2 = 0 then 'primary' else 'secondary' end as role,
    concat('db-c', cast(user_id % 3 as varchar(10)), '-', cast(user_id % 2 as varchar(10)), '.example') as fqdn
  from (select cast(ts as timestamp) as ts, user_id from events) e
  group by date_trunc('day', ts), user_id % 3, user_id % 2)
"""


def events_table(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    if not stream:
        return spark.read.parquet(path)
    # As a pattern, so that one file serves as well as a folder of files.
    pattern = f"{sf_dir}/event[s].parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def with_ctes(
    spark: SparkSession, sf_dir: str, ctes: str, body: str, stream: bool = False
) -> DataFrame:
    """Run ``body`` over the events table and common table expressions."""
    tune(spark)
    text = f"with {ctes} {body}".replace("from events", "from {events}")
    return spark.sql(text, events=events_table(spark, sf_dir, stream))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_snapshots(with_ctes(spark, sf_dir, BASE_CTES, "select * from snap"))


CALL_CTES = (
    BASE_CTES.split("snap as (")[0]
    .replace("select ws, user_id,", "select ts, ws, user_id,")
    .replace("select event_id,", "select cast(ts as timestamp) as ts, event_id,")
    + """call as (
  select ts, 'shop' as project, 'production' as environment,
    concat('c', cast(cl as varchar(10))) as cluster,
    case when ro = 0 then 'primary' else 'secondary' end as role,
    concat('db-c', cast(cl as varchar(10)), '-', cast(ro as varchar(10)), '.example') as fqdn,
    ro + 10 as userid, cl + 1 as dbid, query, value as duration, k as rows,
    k * 3 as shared_blks_hit, k % 7 as shared_blks_read, k % 5 as shared_blks_dirtied,
    k % 3 as shared_blks_written, k % 11 as local_blks_hit, k % 13 as local_blks_read,
    k % 17 as local_blks_dirtied, k % 19 as local_blks_written, k % 23 as temp_blks_read,
    k % 29 as temp_blks_written, value * 0.25 as blk_read_time, value * 0.125 as blk_write_time
  from stmt)
"""
)


def calls(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The single calls behind the snapshots."""
    return with_ctes(spark, sf_dir, CALL_CTES, "select * from call", stream)
