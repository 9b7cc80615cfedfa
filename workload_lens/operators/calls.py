"""Tumbling windows over a log of single calls, giving statement snapshots."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workload_lens.schemas import SOURCE


def tumbling_snapshots(
    calls: DataFrame,
    width: str = "300 seconds",
    by: list[str] | None = None,
    counters: list[str] | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Statistics per window, source and statement from rows ``(ts, duration, query, ...)``.

    The same plan serves a batch and, with a watermark, a stream. ``counters`` are numeric
    columns to add up as well. Aggregation is partial before the shuffle, so a statement
    that makes up most of the calls costs one row per input split.
    """
    by = [*SOURCE, "userid", "dbid", "query"] if by is None else by
    if watermark is not None:
        calls = calls.withWatermark("ts", watermark)
    duration = F.col("duration")
    aggregated = calls.groupBy(F.window("ts", width).alias("w"), *by).agg(
        F.count(F.lit(1)).cast("double").alias("calls"),
        F.sum(duration).alias("total_time"),
        F.min(duration).alias("min_time"),
        F.max(duration).alias("max_time"),
        F.avg(duration).alias("mean_time"),
        F.stddev_pop(duration).alias("stddev_time"),
        *[F.sum(c).cast("double").alias(c) for c in counters or []],
    )
    bounds = [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]
    return aggregated.select(*bounds, *aggregated.columns[1:])
