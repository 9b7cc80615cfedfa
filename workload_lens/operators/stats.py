"""Running statistics of the 19 metrics across windows."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workload_lens.functions.keys import hash_id_sql
from workload_lens.functions.moments import pooled_deviation
from workload_lens.schemas import EVERYWHERE_ID, LOGICAL_SOURCE, METRICS, STAR

STATS_KEY = ["fingerprint_id", "logical_source_id", "type"]
_STATS_COLUMNS = STAR["fingerprint_stats"].fieldNames()


def fingerprint_stats(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, mean and sample deviation per fingerprint, source and metric, and by further columns.

    Every merged statement is one sample for its own source and one for "everywhere" (id
    0). All metrics are aggregated side by side in one wide pass and turned into rows at
    the end, so the shuffle carries one row per key and split instead of nineteen.
    """
    sources = f"array({EVERYWHERE_ID}L, {hash_id_sql(*LOGICAL_SOURCE)})"
    by = by or []
    keyed = merged.selectExpr(
        *by,
        f"{hash_id_sql('fingerprint')} as fingerprint_id",
        f"explode({sources}) as logical_source_id",
        "window_end",
        *METRICS,
    )
    wide = keyed.groupBy(*by, "fingerprint_id", "logical_source_id").agg(
        F.max("window_end").alias("last"),
        *[F.expr(f"{f}({m}) as {m}_{f}") for m in METRICS for f in ("count", "avg", "stddev_samp")],
    )
    entries = [
        f"struct('{m}' as type, {m}_count as count, coalesce({m}_avg, 0D) as mean,"
        f" coalesce({m}_stddev_samp, 0D) as deviation)"
        for m in METRICS
    ]
    return wide.selectExpr(
        *by, "fingerprint_id", "logical_source_id", "last", f"inline(array({', '.join(entries)}))"
    ).select(*by, *_STATS_COLUMNS)


def merge_stats(*partials: DataFrame) -> DataFrame:
    """One row per key from a few statistics tables, as if over all samples.

    Counters have large means that lie close together, and squares of such numbers have no
    digits left for their differences. So every mean is taken relative to that of its key,
    which a window over the key computes: the aggregation by the same key needs no further
    shuffle. A key has one row in each table, so no key is a large group.
    """
    rows = reduce(DataFrame.unionByName, [p.select(*_STATS_COLUMNS) for p in partials])
    of_key = Window.partitionBy(*STATS_KEY)
    total = F.sum(F.expr("count * mean")).over(of_key)
    centre = F.coalesce(F.try_divide(total, F.sum("count").over(of_key)), F.lit(0.0))
    pooled = rows.withColumn("centre", centre).groupBy(*STATS_KEY).agg(
        F.max("last").alias("last"),
        F.first("centre").alias("mean"),
        F.sum("count").alias("n"),
        F.expr("sum(greatest(count - 1, 0) * deviation * deviation) as within"),
        F.expr(
            "case when min(case when count > 0 then mean end) < max(case when count > 0 then mean end)"
            " then sum(count * (mean - centre) * (mean - centre)) else 0D end as between"
        ),
    )
    return pooled.select(
        *STATS_KEY,
        F.col("n").alias("count"),
        "mean",
        pooled_deviation(ddof=1).alias("deviation"),
        "last",
    )


def incomplete_stats(stats: DataFrame) -> DataFrame:
    """Keys that do not have all 19 metrics exactly once, or have an unknown one."""
    known = F.col("type").isin(METRICS)
    per_key = stats.groupBy("fingerprint_id", "logical_source_id").agg(
        F.count_distinct(F.when(known, F.col("type"))).alias("known_types"),
        F.count(F.lit(1)).alias("stored_types"),
    )
    every = F.lit(len(METRICS))
    return per_key.where((F.col("known_types") != every) | (F.col("stored_types") != every))


def lifetime_counters(merged: DataFrame) -> DataFrame:
    """Calls and time of every fingerprint up to and including each window.

    Sources are added up per window first, so a running window holds one row per time
    window, not one per event.
    """
    per_window = merged.groupBy("fingerprint", "window_start").agg(
        F.sum("calls").alias("calls"), F.sum("total_time").alias("total_time")
    )
    so_far = Window.partitionBy("fingerprint").orderBy("window_start")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_window.select(
        "fingerprint",
        "window_start",
        F.sum("calls").over(so_far).alias("calls_since_start"),
        F.sum("total_time").over(so_far).alias("time_since_start"),
    )
