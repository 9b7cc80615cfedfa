"""Merging the statements of one observation window by fingerprint."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workload_lens.functions.context import extract_context
from workload_lens.functions.moments import (
    combine_parts,
    moment_parts,
    moment_shift,
    pooled_deviation,
    pooled_parts,
    with_centre,
)
from workload_lens.functions.text import add_fingerprint
from workload_lens.schemas import ADDITIVE_METRICS, CONTEXT, EVENT_KEY, METRICS


# How a metric of several statements is merged; the mean and the deviation are pooled.
_MERGE = {"min_time": "min", "max_time": "max"}
_DIRECT = [*ADDITIVE_METRICS, *_MERGE]


def statement_texts(
    snapshots: DataFrame,
    patterns: dict[str, str] | None = None,
    collapse_lists: bool = False,
) -> DataFrame:
    """Every distinct text once, with its fingerprint, its context and when it came first.

    A statement comes back in window after window, so this is far smaller than the
    snapshots, and the text work is done here only. What is derived from a text depends on
    an aggregate as well, so that Spark cannot move a filter on it, and with the filter the
    text work, below the aggregation and onto every row.
    """
    texts = snapshots.groupBy("query").agg(F.min("window_start").alias("first_seen"))
    texts = texts.withColumn("text", F.when(F.col("first_seen").isNotNull(), F.col("query")))
    texts = add_fingerprint(texts, "text", collapse_lists)
    return extract_context(texts, "text", patterns).drop("text")


def annotate(snapshots: DataFrame, texts: DataFrame | None = None, **options) -> DataFrame:
    """Snapshots with ``fingerprint``, ``reject_reason`` and the context labels.

    ``texts`` comes from ``statement_texts`` over the same snapshots and is joined by a
    128-bit digest of the text. There is no broadcast hint: the number of texts is not
    bounded, so Spark picks the join by the size it measures and splits a hot text.
    """
    texts = statement_texts(snapshots, **options) if texts is None else texts
    digest = {"t1": F.xxhash64(F.lit(1), "query"), "t2": F.xxhash64(F.lit(2), "query")}
    labels = texts.withColumns(digest).select(
        "t1", "t2", "fingerprint", "reject_reason", *CONTEXT
    )
    return snapshots.withColumns(digest).join(labels, ["t1", "t2"]).drop("t1", "t2")


def accepted(statements: DataFrame) -> DataFrame:
    return statements.where(F.col("reject_reason").isNull())


def _sums(counted: str) -> list:
    return [F.expr(counted), *[F.expr(f"{_MERGE.get(m, 'sum')}({m}) as {m}") for m in _DIRECT]]


def _first_batch(rows: DataFrame) -> list:
    """Rows of a store know their batch; what several have brought counts for the first."""
    return [F.min("batch_id").alias("batch_id")] if "batch_id" in rows.columns else []


def accumulate(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable sums, a few rows for each key: one for each shift of its means.

    All buffers have a fixed width, so Spark can aggregate by hash before it shuffles.
    """
    return statements.withColumn("m_shift", moment_shift("mean_time")).groupBy(*keys, "m_shift").agg(
        *_sums("count(1) as statements"),
        F.sum(F.col("calls").cast("long")).alias("c"),
        *moment_parts("calls", "mean_time", "stddev_time", shift="m_shift", prefix="m_"),
        *_first_batch(statements),
    )


def combine(accumulated: DataFrame, keys: list[str]) -> DataFrame:
    """The same sums at a coarser key."""
    return accumulated.groupBy(*keys, "m_shift").agg(
        *_sums("sum(statements) as statements"),
        F.sum("c").alias("c"),
        *combine_parts("m_"),
        *_first_batch(accumulated),
    )


def finish(accumulated: DataFrame, keys: list[str]) -> DataFrame:
    """Sums to metrics, one row for each key, with the pooled mean and population deviation."""
    pooled = with_centre(accumulated, keys, "m_shift", "m_").groupBy(*keys).agg(
        *_sums("sum(statements) as statements"),
        *pooled_parts("m_shift", "m_"),
        *_first_batch(accumulated),
    )
    batch = [c for c in ("batch_id",) if c in pooled.columns]
    return pooled.withColumns(
        {"mean_time": F.col("m_mean"), "stddev_time": pooled_deviation("m_")}
    ).select(*keys, *METRICS, *batch)


def window_merge(statements: DataFrame, keys: list[str] = EVENT_KEY) -> DataFrame:
    """One row per window, source and fingerprint with all 19 metrics.

    Neither the order of the rows nor any split of them matters, and means that are large and
    close together keep their deviation.
    """
    return finish(accumulate(accepted(statements), keys), keys)


def context_histogram(statements: DataFrame) -> DataFrame:
    """Calls per context within each merged statement, without empty entries."""
    calls = F.sum(F.col("calls").cast("long")).alias("c")
    return accepted(statements).groupBy(*EVENT_KEY, *CONTEXT).agg(calls).where("c > 0")


def fingerprint_rejects(statements: DataFrame) -> DataFrame:
    """The statements that have no fingerprint, with the reason."""
    return statements.where(F.col("reject_reason").isNotNull()).drop("fingerprint", *CONTEXT)
