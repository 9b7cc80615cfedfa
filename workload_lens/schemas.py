"""Column lists and schemas shared by every stage.

All times are UTC instants, all counters are doubles once they are ingested, and every key
is a bigint, so that tables written by different jobs can be combined without casts.
"""

from pyspark.sql import types as T

# The 19 per-statement metrics in canonical order. The same names are the
# allowed labels of the ``type`` column in the statistics table.
METRICS = [
    "calls",
    "total_time",
    "min_time",
    "max_time",
    "mean_time",
    "stddev_time",
    "rows",
    "shared_blks_hit",
    "shared_blks_read",
    "shared_blks_dirtied",
    "shared_blks_written",
    "local_blks_hit",
    "local_blks_read",
    "local_blks_dirtied",
    "local_blks_written",
    "temp_blks_read",
    "temp_blks_written",
    "blk_read_time",
    "blk_write_time",
]

# Metrics that add up when statements are merged; the other four are min, max and moments.
MOMENT_METRICS = ["min_time", "max_time", "mean_time", "stddev_time"]
ADDITIVE_METRICS = [m for m in METRICS if m not in MOMENT_METRICS]

# Timings that newer sources report separately for planning and execution.
SPLIT_TIMINGS = ["total", "min", "max", "mean", "stddev"]

WINDOW = ["window_start", "window_end"]
LOGICAL_SOURCE = ["project", "environment", "cluster", "role"]
SOURCE = LOGICAL_SOURCE + ["fqdn"]
STATEMENT_ID = ["userid", "dbid", "queryid", "query"]
CONTEXT = ["controller", "action", "job_tag"]

# One merged statement per observation window, source and fingerprint.
EVENT_KEY = WINDOW + SOURCE + ["fingerprint"]

# Id and labels of the logical source that stands for all sources together.
EVERYWHERE_ID = 0
EVERYWHERE_LABEL = "all"


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


_LONG, _TEXT, _DOUBLE, _TIME = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType()

SNAPSHOT = _struct(
    *[(c, _TIME, False) for c in WINDOW],
    *[(c, _TEXT, False) for c in SOURCE],
    *[(c, _LONG, True) for c in ("userid", "dbid", "queryid")],
    ("query", _TEXT, True),
    *[(m, _DOUBLE, True) for m in METRICS],
)

# Newer sources: total/min/max/mean/stddev arrive as a planning and an execution part.
SNAPSHOT_SPLIT = T.StructType(
    [f for f in SNAPSHOT.fields if f.name not in [f"{t}_time" for t in SPLIT_TIMINGS]]
    + [
        T.StructField(f"{t}_{part}_time", _DOUBLE, True)
        for t in SPLIT_TIMINGS
        for part in ("plan", "exec")
    ]
)

_EVENT_FIELDS = [
    ("id", _LONG, False),
    ("fingerprint_id", _LONG, False),
    ("logical_source_id", _LONG, False),
    ("physical_source_id", _LONG, False),
    ("observed_window_start", _TIME, False),
    ("observed_window_end", _TIME, False),
    ("recorded_at", _TIME, False),
    ("calls", _DOUBLE, False),
    ("time", _DOUBLE, False),
]
_CONTEXT_FIELDS = [
    ("event_id", _LONG, False),
    ("fingerprint_id", _LONG, False),
    ("logical_source_id", _LONG, False),
    ("observed_window_start", _TIME, False),
    ("observed_window_end", _TIME, False),
    ("controller_id", _LONG, True),
    ("action_id", _LONG, True),
    ("job_tag_id", _LONG, True),
    ("c", _LONG, False),
]
_PARTITION_FIELDS = [("batch_id", _TEXT, True), ("observed_date", T.DateType(), True)]

# The star schema, by table name.
STAR = {
    "controllers": _struct(("id", _LONG, False), ("controller", _TEXT, False)),
    "actions": _struct(("id", _LONG, False), ("action", _TEXT, False)),
    "job_tags": _struct(("id", _LONG, False), ("job_tag", _TEXT, False)),
    "logical_sources": _struct(
        ("id", _LONG, False), *[(c, _TEXT, False) for c in LOGICAL_SOURCE]
    ),
    "physical_sources": _struct(("id", _LONG, False), ("fqdn", _TEXT, False)),
    "fingerprints": _struct(
        ("id", _LONG, False), ("fingerprint", _TEXT, False), ("normalized", _TEXT, False)
    ),
    "statement_events": _struct(*_EVENT_FIELDS, *_PARTITION_FIELDS),
    "event_context": _struct(*_CONTEXT_FIELDS, *_PARTITION_FIELDS),
    "fingerprint_stats": _struct(
        ("fingerprint_id", _LONG, False),
        ("logical_source_id", _LONG, False),
        ("type", _TEXT, False),
        ("count", _LONG, True),
        ("mean", _DOUBLE, True),
        ("deviation", _DOUBLE, True),
        ("last", _TIME, True),
    ),
}

# Tables of a store beside the star schema. ``ledger`` has every statement row that a batch
# has brought, without its text; all facts and statistics follow from it.
_KEY_FIELDS = [(c, _TIME, False) for c in WINDOW] + [(c, _TEXT, False) for c in SOURCE]
_DAY = ("observed_date", T.DateType(), True)
STORE = {
    **STAR,
    "ledger": _struct(
        *_KEY_FIELDS,
        ("fingerprint", _TEXT, True),
        ("reject_reason", _TEXT, True),
        *[(c, _TEXT, True) for c in CONTEXT],
        *[(m, _DOUBLE, True) for m in METRICS],
        ("row_a", _LONG, False),
        ("row_b", _LONG, False),
        ("batch_id", _TEXT, False),
        _DAY,
    ),
    "day_stats": T.StructType([*STAR["fingerprint_stats"].fields, T.StructField(*_DAY)]),
    "window_quality": _struct(
        *_KEY_FIELDS,
        ("statements", _LONG, True),
        ("unique_fingerprints", _LONG, True),
        ("rejected", _LONG, True),
        _DAY,
    ),
    "rejects": _struct(
        *[(name, kind, True) for name, kind, _ in _KEY_FIELDS],
        ("query", _TEXT, True),
        ("reject_reason", _TEXT, False),
        ("statements", _LONG, False),
        ("batch_id", _TEXT, False),
        _DAY,
    ),
}
# Tables of a store with a folder for each day.
DAILY = ["ledger", "statement_events", "event_context", "day_stats", "window_quality", "rejects"]

# Dimension table -> natural key.
DIMENSIONS = {
    "controllers": ["controller"],
    "actions": ["action"],
    "job_tags": ["job_tag"],
    "logical_sources": LOGICAL_SOURCE,
    "physical_sources": ["fqdn"],
    "fingerprints": ["fingerprint"],
}
