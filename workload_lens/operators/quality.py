"""How good the observation was: counts, gaps and overruns per window."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workload_lens.schemas import SOURCE, WINDOW


def window_quality(statements: DataFrame) -> DataFrame:
    """Statements seen, rejected and left as unique fingerprints, per window and source."""
    return statements.groupBy(*WINDOW, *SOURCE).agg(
        F.count(F.lit(1)).alias("statements"),
        F.count_distinct("fingerprint").alias("unique_fingerprints"),
        F.count("reject_reason").alias("rejected"),
    )


def window_gaps(windows: DataFrame, interval_seconds: int) -> DataFrame:
    """Time between the end of a window and the start of the next of the same source.

    ``overrun`` tells that a window took longer than the interval, or that the next one
    began late. Snapshot rows are reduced to windows before anything is ordered, so a task
    holds one row per window of a source.
    """
    bounds = windows.select(*SOURCE, *WINDOW).distinct()
    by_time = Window.partitionBy(*SOURCE).orderBy("window_start", "window_end")
    seconds = {c: F.unix_micros(c) / F.lit(1e6) for c in WINDOW}
    previous_end = F.lag(seconds["window_end"]).over(by_time)
    gap = seconds["window_start"] - previous_end
    width = seconds["window_end"] - seconds["window_start"]
    return bounds.select(
        *SOURCE, *WINDOW, width.alias("width_seconds"), gap.alias("gap_seconds")
    ).withColumn(
        "overrun",
        (F.col("width_seconds") > interval_seconds) | (F.coalesce("gap_seconds", F.lit(0.0)) > 0),
    )
