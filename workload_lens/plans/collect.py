"""One observation window pulled from a live database into the star schema."""

from datetime import datetime

from pyspark.sql import SparkSession

from workload_lens.config import JobConfig
from workload_lens.operators.checks import PreconditionFailed
from workload_lens.plans.ingest import ingest_batch
from workload_lens.sources.snapshots import read_jdbc_snapshot


def require_observed(spark: SparkSession, options: dict[str, str], condition: str) -> None:
    """Run the boolean precondition on the observed database itself."""
    reader = spark.read.format("jdbc").options(**options).option("query", condition)
    rows = reader.load().limit(2).collect()
    if len(rows) != 1 or rows[0][0] is not True:
        raise PreconditionFailed(f"precondition does not hold: {condition}")


def collect_window(
    spark: SparkSession,
    options: dict[str, str],
    root: str,
    window: tuple[datetime, datetime],
    config: JobConfig,
    relation: str = "pg_stat_statements",
    split_timings: bool = True,
) -> None:
    """Check, pull the worst statements, and ingest them under the start of the window.

    ``options`` are those of Spark's JDBC source. Top-k runs in the observed database, so
    the rows of one window are few; their number is bounded by 19 times ``top_k``.
    """
    if config.sanity_check:
        require_observed(spark, options, config.sanity_check)
    snapshot = read_jdbc_snapshot(
        spark, options, window, config.source, relation, config.top_k, split_timings
    )
    ingested = JobConfig(context_patterns=config.context_patterns, top_k=None)
    host = config.fqdn or "unknown"
    ingest_batch(snapshot, root, f"{host}-{int(window[0].timestamp())}", ingested)
