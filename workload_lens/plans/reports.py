"""Parameterised reports on the star schema."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workload_lens.functions.text import statement_preview
from workload_lens.operators.stats import merge_stats
from workload_lens.schemas import CONTEXT, EVERYWHERE_ID
from workload_lens.sources.star import Star

# A list of at most this many rows may be broadcast; its length is a parameter.
_BROADCAST_ROWS = 10_000
_CONTEXT_IDS = [f"{c}_id" for c in CONTEXT]


def select_sources(
    star: Star,
    project: str | None = None,
    environment: str | None = None,
    cluster: str | None = None,
) -> DataFrame:
    """Logical sources with the given labels; a missing label does not filter."""
    wanted = {"project": project, "environment": environment, "cluster": cluster}
    sources = star.logical_sources
    for label, value in wanted.items():
        if value is not None:
            sources = sources.where(F.col(label) == value)
    return sources


def in_interval(
    facts: DataFrame, interval: str = "3 hours", as_of: datetime | Column | None = None
) -> DataFrame:
    """Facts whose whole window lies in ``[as_of - interval, as_of)``.

    The bounds on the day prune partitions; they are a day wide on either side, so the
    time zone of the session that wrote the day does not matter.
    """
    end = as_of if isinstance(as_of, Column) else F.lit(as_of) if as_of else F.current_timestamp()
    start = end - F.expr(f"INTERVAL {interval}")
    return facts.where(
        (F.col("observed_date") >= F.date_sub(F.to_date(start), 1))
        & (F.col("observed_date") <= F.date_add(F.to_date(end), 1))
        & (F.col("observed_window_start") >= start)
        & (F.col("observed_window_end") <= end)
    )


def _of_sources(facts: DataFrame, sources: DataFrame) -> DataFrame:
    ids = sources.select(F.col("id").alias("logical_source_id"))
    return facts.join(ids, "logical_source_id", "left_semi")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else df


def fingerprint_totals(events: DataFrame) -> DataFrame:
    """Calls, time and time per call of every fingerprint."""
    totals = events.groupBy("fingerprint_id").agg(
        F.sum("calls").alias("calls"), F.sum("time").alias("total_ms")
    )
    return totals.withColumn("avg_ms_per_call", F.try_divide("total_ms", "calls"))


def fingerprint_window_avg(events: DataFrame) -> DataFrame:
    """Mean over windows of the time a fingerprint took per window."""
    return events.groupBy("fingerprint_id").agg(F.avg("time").alias("avg_ms"))


def top_fingerprints(totals: DataFrame, by: str, n: int = 20) -> DataFrame:
    return totals.orderBy(F.desc(by), "fingerprint_id").limit(n)


def event_ids_by_fingerprint(events: DataFrame) -> DataFrame:
    """Event ids as sorted arrays, one per fingerprint, source and day.

    A source has a fixed number of windows a day, so no array grows with the history.
    """
    return events.groupBy("fingerprint_id", "logical_source_id", "observed_date").agg(
        F.sort_array(F.collect_list("id")).alias("event_ids")
    )


def contexts_of_events(
    contexts: DataFrame, events: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Context rows of the given events, with further ``columns`` of the event.

    An equi-join by event id within a day instead of membership in an array of ids. The
    other key columns make it exact even if two events shared an id.
    """
    keys = ["observed_date", "event_id", "fingerprint_id", "logical_source_id"]
    wanted = events.withColumnRenamed("id", "event_id").select(*keys, *(columns or []))
    return contexts.join(wanted, keys)


def context_totals(contexts: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Calls per fingerprint and context; contexts with missing parts are contexts too.

    ``carry`` names columns that depend on the fingerprint and should stay.
    """
    keys = ["fingerprint_id", *(carry or []), *_CONTEXT_IDS]
    return contexts.groupBy(*keys).agg(F.sum("c").alias("times"))


def top_contexts(totals: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent contexts of each fingerprint, ranked.

    The rank predicate limits every group before the shuffle.
    """
    order = [F.desc("times"), *[F.asc_nulls_last(c) for c in _CONTEXT_IDS]]
    rank = F.row_number().over(Window.partitionBy("fingerprint_id").orderBy(*order))
    return totals.withColumn("r", rank).where(F.col("r") <= k)


def with_context_labels(df: DataFrame, star: Star) -> DataFrame:
    """Replace context ids by their labels; unknown ids give NULL."""
    dims = {"controller": star.controllers, "action": star.actions, "job_tag": star.job_tags}
    for label, dim in dims.items():
        named = dim.select(F.col("id").alias(f"{label}_id"), label)
        df = df.join(named, f"{label}_id", "left").drop(f"{label}_id")
    return df


def context_json(labelled: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Ranked contexts of each fingerprint as one JSON array, missing parts as null."""
    entry = F.struct("r", F.struct("times", *CONTEXT).alias("x"))
    ranked = F.sort_array(F.collect_list(entry))
    return labelled.groupBy("fingerprint_id", *(carry or [])).agg(
        F.to_json(ranked["x"], {"ignoreNullFields": "false"}).alias("context")
    )


def _with_contexts(
    star: Star, sources: DataFrame, top: DataFrame, n: int, k: int, interval: str, as_of
) -> DataFrame:
    """The chosen fingerprints with their top contexts as JSON and their normalized text.

    The columns of ``top`` travel with the contexts, so that it is computed once. One
    without any context row drops out.
    """
    carry = [c for c in top.columns if c != "fingerprint_id"]
    contexts = _of_sources(in_interval(star.event_context, interval, as_of), sources)
    totals = context_totals(contexts.join(_small(top, n), "fingerprint_id"), carry)
    labelled = with_context_labels(top_contexts(totals, k), star)
    named = star.fingerprints.select(F.col("id").alias("fingerprint_id"), "normalized")
    return named.join(_small(context_json(labelled, carry), n), "fingerprint_id")


def report_top(
    star: Star,
    by: str = "calls",
    n: int = 20,
    contexts: int = 5,
    interval: str = "3 hours",
    as_of: datetime | None = None,
    project: str | None = None,
    environment: str | None = None,
    cluster: str | None = None,
) -> DataFrame:
    """The ``n`` most frequent (``calls``) or most time-consuming (``total_ms``) statements.

    A fingerprint without any context row does not appear.
    """
    sources = select_sources(star, project, environment, cluster)
    events = _of_sources(in_interval(star.statement_events, interval, as_of), sources)
    top = top_fingerprints(fingerprint_totals(events), by, n)
    average = F.col("avg_ms_per_call")
    return (
        _with_contexts(star, sources, top, n, contexts, interval, as_of)
        .orderBy(F.desc(by), "fingerprint_id")
        .select(
            "calls",
            "total_ms",
            (average.cast("decimal(18,1)") if by == "calls" else average).alias("avg_ms_per_call"),
            statement_preview("normalized", 250).alias("example"),
            "context",
        )
    )


def stats_of_sources(
    stats: DataFrame, sources: DataFrame, metric: str = "total_time"
) -> DataFrame:
    """Statistics of one metric for the given sources and for everywhere.

    "Everywhere or one of these" is written as membership in one list of ids, so that it
    is an equi-join.
    """
    everywhere = sources.sparkSession.range(EVERYWHERE_ID, EVERYWHERE_ID + 1)
    ids = sources.select("id").union(everywhere).distinct()
    wanted = ids.withColumnRenamed("id", "logical_source_id")
    of_metric = stats.where(F.col("type") == metric)
    return of_metric.join(wanted, "logical_source_id", "left_semi")


def report_vs_history(
    star: Star,
    n: int = 20,
    metric: str = "total_time",
    contexts: int = 5,
    interval: str = "3 hours",
    as_of: datetime | None = None,
    project: str | None = None,
    environment: str | None = None,
    cluster: str | None = None,
) -> DataFrame:
    """The ``n`` most expensive statements: this interval against all windows ever seen."""
    sources = select_sources(star, project, environment, cluster)
    events = _of_sources(in_interval(star.statement_events, interval, as_of), sources)
    top = top_fingerprints(fingerprint_window_avg(events), "avg_ms", n)
    stored = star.fingerprint_stats.join(
        _small(top.select("fingerprint_id"), n), "fingerprint_id", "left_semi"
    )
    history = merge_stats(stats_of_sources(stored, sources, metric)).select(
        "fingerprint_id", "logical_source_id", "mean", "deviation"
    )
    labels = star.logical_sources.withColumnRenamed("id", "logical_source_id")
    return (
        _with_contexts(star, sources, top, n, contexts, interval, as_of)
        .join(history, "fingerprint_id")
        .join(labels, "logical_source_id")
        .orderBy("fingerprint_id", F.desc("logical_source_id"))
        .select(
            F.col("avg_ms").alias("avg_ms_this_window"),
            F.col("mean").alias("avg_ms_overall"),
            F.col("deviation").alias("deviation_ms_overall"),
            "project",
            "environment",
            "cluster",
            "role",
            statement_preview("normalized", 150).alias("example"),
            "context",
        )
    )


def role_calls(
    star: Star,
    keys: list[str],
    interval: str = "3 hours",
    as_of: datetime | None = None,
    project: str | None = None,
    environment: str | None = None,
    weight: str = "event",
) -> DataFrame:
    """Calls by cluster, role and context ids, for rows with at least one of the ids.

    With ``weight="event"`` each context row counts all calls of its event; with
    ``weight="context"`` it counts its own calls and the facts need not be joined.
    """
    ids = [f"{k}_id" for k in keys]
    some_id = F.coalesce(*ids).isNotNull()
    contexts = in_interval(star.event_context, interval, as_of).where(some_id)
    if weight == "context":
        rows = contexts.select("logical_source_id", *ids, F.col("c").cast("double").alias("calls"))
    else:
        events = in_interval(star.statement_events, interval, as_of)
        rows = contexts_of_events(contexts, events, ["calls"]).select(
            "logical_source_id", *ids, "calls"
        )
    named = select_sources(star, project, environment).select(
        F.col("id").alias("logical_source_id"), "cluster", "role"
    )
    return (
        rows.join(named, "logical_source_id")
        .groupBy("cluster", "role", *ids)
        .agg(F.sum("calls").alias("calls"))
    )


def role_pairs(by_role: DataFrame, keys: list[str], roles: tuple[str, str]) -> DataFrame:
    """Both roles of each cluster and key side by side.

    One aggregation instead of a self-join. As in the join, a key that only one role has
    drops out, and so does a key with a NULL part.
    """
    ids = [f"{k}_id" for k in keys]
    first, second = (F.sum(F.when(F.col("role") == role, F.col("calls"))) for role in roles)
    return (
        by_role.where(F.col("role").isin(*roles))
        .dropna(subset=ids)
        .groupBy("cluster", *ids)
        .agg(first.alias("primary_calls"), second.alias("secondary_calls"))
        .where(F.col("primary_calls").isNotNull() & F.col("secondary_calls").isNotNull())
    )


def report_role_share(
    star: Star,
    keys: list[str],
    roles: tuple[str, str] = ("primary", "secondary"),
    interval: str = "3 hours",
    as_of: datetime | None = None,
    project: str | None = None,
    environment: str | None = None,
    weight: str = "event",
) -> DataFrame:
    """Share of the calls that each of two roles served, per cluster and context labels."""
    by_role = role_calls(star, keys, interval, as_of, project, environment, weight)
    pairs = role_pairs(by_role, keys, roles)
    dims = {"controller": star.controllers, "action": star.actions, "job_tag": star.job_tags}
    for key in keys:
        named = dims[key].select(F.col("id").alias(f"{key}_id"), key)
        pairs = pairs.join(named, f"{key}_id", "left")
    total = F.col("primary_calls") + F.col("secondary_calls")
    return pairs.select(
        *keys,
        "cluster",
        total.alias("total_calls"),
        (F.try_divide("primary_calls", total) * 100).alias("primary_percentage"),
        (F.try_divide("secondary_calls", total) * 100).alias("secondary_percentage"),
    ).orderBy(*[F.asc_nulls_last(k) for k in keys], "cluster")
