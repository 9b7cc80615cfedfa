"""Statement-statistics snapshots: files, streams of files, and a JDBC source."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload_lens.schemas import METRICS, SNAPSHOT, SNAPSHOT_SPLIT, SPLIT_TIMINGS


def adapt_split_timings(df: DataFrame) -> DataFrame:
    """Add up planning and execution parts of the five timings of newer sources.

    For min, max and stddev the sum is the customary approximation, kept as it is.
    """
    sums = [
        (F.col(f"{t}_plan_time") + F.col(f"{t}_exec_time")).alias(f"{t}_time")
        for t in SPLIT_TIMINGS
    ]
    return as_snapshots(df.select("*", *sums))


def as_snapshots(df: DataFrame) -> DataFrame:
    """Project to the canonical columns and types; optional ids may be missing."""
    present = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f.name if f.name in present else 'null'} as {f.dataType.simpleString()})"
            f" as {f.name}"
            for f in SNAPSHOT.fields
        ]
    )


def read_snapshots(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", split_timings: bool = False
) -> DataFrame:
    """Snapshot files with an explicit schema, so nothing is inferred or scanned twice."""
    schema = SNAPSHOT_SPLIT if split_timings else SNAPSHOT
    df = spark.read.format(fmt).schema(schema).load(path)
    return adapt_split_timings(df) if split_timings else as_snapshots(df)


def stream_snapshots(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    split_timings: bool = False,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The same as an unbounded source: every new file is one or more whole windows."""
    schema = SNAPSHOT_SPLIT if split_timings else SNAPSHOT
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.load(path)
    return adapt_split_timings(df) if split_timings else as_snapshots(df)


def worst_statements_query(
    relation: str = "pg_stat_statements", k: int | None = 100, split_timings: bool = False
) -> str:
    """SQL for the observed database: the union of the top ``k`` rows of every metric.

    It runs over there, so at most ``19 * k`` rows leave the busy system.
    """
    timing = "({t}_plan_time + {t}_exec_time)" if split_timings else "{t}_time"
    names = {f"{t}_time": timing.format(t=t) for t in SPLIT_TIMINGS}
    metrics = ", ".join(f"{names.get(m, m)} as {m}" for m in METRICS)
    raw = f"select userid, dbid, queryid, query, {metrics} from {relation}"
    if k is None:
        return raw
    branches = " union ".join(
        f"select * from (select * from raw order by {m} desc limit {k}) top_{m}" for m in METRICS
    )
    return f"select * from (with raw as ({raw}) {branches}) worst"


def read_jdbc_snapshot(
    spark: SparkSession,
    options: dict[str, str],
    window: tuple[object, object],
    source: dict[str, str],
    relation: str = "pg_stat_statements",
    k: int | None = 100,
    split_timings: bool = False,
) -> DataFrame:
    """One snapshot pulled from a live database and stamped with its window and source.

    ``options`` are those of Spark's JDBC source (url, driver, user, ...).
    """
    query = worst_statements_query(relation, k, split_timings)
    rows = spark.read.format("jdbc").options(**options).option("query", query).load()
    return stamp(rows, window, source)


def stamp(df: DataFrame, window: tuple[object, object], source: dict[str, str]) -> DataFrame:
    """Put the bounds of the observation window and the source labels on every row.

    Bounds without a time zone are taken to be in the zone of the driver.
    """
    start, end = window
    labels = {name: F.lit(value) for name, value in source.items()}
    return as_snapshots(
        df.withColumns({"window_start": F.lit(start), "window_end": F.lit(end), **labels})
    )
