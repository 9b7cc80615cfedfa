"""From snapshots to the star schema."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from workload_lens.config import JobConfig
from workload_lens.operators.checks import rules_for, with_violations
from workload_lens.operators.dims import (
    everywhere_source,
    new_fingerprints,
    new_members,
)
from workload_lens.operators.facts import event_context_fact, events_fact, ledger_rows
from workload_lens.operators.merge import (
    accepted,
    annotate,
    context_histogram,
    statement_texts,
    window_merge,
)
from workload_lens.operators.stats import fingerprint_stats
from workload_lens.operators.topk import topk_union
from workload_lens.schemas import CONTEXT, DIMENSIONS, LOGICAL_SOURCE, SOURCE, WINDOW
from workload_lens.sources import manifest
from workload_lens.sources.manifest import Part, Parts
from workload_lens.sources.star import (
    Star,
    create_star,
    delete_part,
    of_table,
    read_dimension,
    write_days,
    write_part,
)

__all__ = ["derive_star", "event_context_fact", "events_fact", "ingest_batch", "snapshot_rules"]

# The day under which a rejected row is kept that has no time.
_NO_DAY = "1970-01-01"


def derive_star(snapshots: DataFrame, config: JobConfig | None = None) -> Star:
    """The star schema of one set of snapshots as a lazy plan, nothing stored."""
    config = config or JobConfig(top_k=None)
    if config.top_k is not None:
        snapshots = topk_union(snapshots, config.top_k)
    texts = statement_texts(snapshots, config.context_patterns)
    statements = annotate(snapshots, texts)
    merged = window_merge(statements)
    members = {c: new_members(accepted(texts), [c]) for c in CONTEXT}
    sources = new_members(snapshots, LOGICAL_SOURCE)
    return Star(
        controllers=members["controller"],
        actions=members["action"],
        job_tags=members["job_tag"],
        logical_sources=everywhere_source(snapshots).unionByName(sources),
        physical_sources=new_members(snapshots, ["fqdn"]),
        fingerprints=new_fingerprints(texts),
        statement_events=events_fact(merged),
        event_context=event_context_fact(context_histogram(statements)),
        fingerprint_stats=fingerprint_stats(merged),
    )


def snapshot_rules() -> dict[str, Column]:
    """What a snapshot row has to meet to be stored: a window that ends after it began, and all labels.

    Rows without a label could not be told apart when they come again, and have no source.
    """
    required = {f"not_null_{c}": F.col(c).isNotNull() for c in [*WINDOW, *SOURCE]}
    return {**required, **rules_for("snapshots")}


def _rejects(invalid: DataFrame, unusable: DataFrame, batch_id: str) -> DataFrame:
    """Rows that break a rule and statements without a fingerprint, with the reason and how many there were."""
    broken = invalid.withColumn("reject_reason", F.array_join("violations", ","))
    columns = [*WINDOW, *SOURCE, "query", "reject_reason"]
    both = broken.select(*columns).unionByName(unusable.select(*columns))
    day = F.coalesce(F.to_date("window_start"), F.to_date("window_end"), F.to_date(F.lit(_NO_DAY)))
    return both.groupBy(*columns).agg(F.count(F.lit(1)).alias("statements")).select(
        *columns, "statements", F.lit(batch_id).alias("batch_id"), day.alias("observed_date")
    )


def ingest_batch(
    snapshots: DataFrame, root: str, batch_id: str, config: JobConfig | None = None
) -> dict[str, int]:
    """Add snapshots to the stored star schema; returns how many rows were stored and rejected, by reason.

    A window may come in several batches: each adds its rows, and a row that another batch
    has brought already counts once. The same batch written again replaces all that it had
    written, also on days that it no longer has. Nothing is seen of a batch before its
    commit, so one that stopped half-way is repeated as a whole. Rows that break a rule of
    ``snapshot_rules`` and statements that have no fingerprint go to the rejects.
    """
    config = config or JobConfig()
    spark = snapshots.sparkSession
    create_star(spark, root)
    known = manifest.parts_of(spark, root)
    version = manifest.new_version()
    rules = snapshot_rules()
    checked = with_violations(snapshots, rules)
    good = checked.where(F.size("violations") == 0).drop("violations")
    invalid = checked.where(F.size("violations") > 0)
    # All are read several times below. A lost executor costs the recomputation of its share.
    level = StorageLevel.MEMORY_AND_DISK
    # Also without a limit a row that comes twice counts once.
    good = topk_union(good, config.top_k).persist(level)
    texts = statement_texts(good, config.context_patterns).persist(level)
    statements = annotate(good, texts)
    stored, refused = Observation(), Observation()
    ledger = ledger_rows(statements, batch_id).observe(
        stored,
        F.count(F.lit(1)).alias("rows"),
        F.count("reject_reason").alias("without_fingerprint"),
        F.collect_set(F.col("observed_date").cast("string")).alias("days"),
    )
    unusable = statements.where(F.col("reject_reason").isNotNull())
    rejects = _rejects(invalid, unusable, batch_id).observe(
        refused,
        F.collect_set(F.col("observed_date").cast("string")).alias("days"),
        *[
            F.coalesce(F.sum(F.when(F.expr(f"array_contains(split(reject_reason, ','), '{r}')"), F.col("statements"))), F.lit(0)).alias(r)
            for r in rules
        ],
    )
    added: list[Part] = []
    try:
        good.count()  # fills the cache before the writes below share it

        def add_members(table: str) -> None:
            old = read_dimension(spark, root, table, known)
            if table == "fingerprints":
                fresh = new_fingerprints(texts, old)
            else:
                seen = good if table.endswith("_sources") else accepted(texts)
                fresh = new_members(seen, DIMENSIONS[table], old)
            new = Observation()
            part = write_part(fresh.observe(new, F.count(F.lit(1)).alias("n")), root, table)
            # Most batches bring nothing new, and a folder without rows need not stay.
            if new.get["n"]:
                added.append(part)
            else:
                delete_part(spark, root, part)

        _side_by_side(
            spark,
            lambda: write_days(ledger, root, "ledger", version),
            lambda: write_days(rejects, root, "rejects", version),
            *[partial(add_members, table) for table in DIMENSIONS],
        )
    finally:
        texts.unpersist()
        good.unpersist()
    for table, seen in (("ledger", stored), ("rejects", refused)):
        added += [Part(table, version, day, (batch_id,)) for day in sorted(seen.get["days"] or [])]
    manifest.commit(spark, root, lambda parts: (*_without_batch(parts, batch_id), *added))
    counts = {"rows": stored.get["rows"], "without_fingerprint": stored.get["without_fingerprint"]}
    return counts | {r: refused.get[r] for r in rules}


def _without_batch(parts: Parts, batch_id: str) -> list[Part]:
    """The folders without what a batch has written before; where it shares one, its rows no longer count."""
    out = []
    for part in parts:
        if part.table in ("ledger", "rejects") and batch_id in part.of:
            if len(part.of) == 1:
                continue
            part = Part(part.table, part.version, part.day, part.of, tuple(sorted({*part.without, batch_id})))
        out.append(part)
    return out


def _side_by_side(spark: SparkSession, *writes: Callable[[], None]) -> None:
    """Submit independent writes together, so that small ones do not leave cores idle."""
    run = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=4) as pool:
        for done in [pool.submit(run(write)) for write in writes]:
            done.result()


def batches_of(spark: SparkSession, root: str) -> set[str]:
    """Names of the batches that count."""
    own = of_table(manifest.parts_of(spark, root), "ledger")
    return {b for p in own for b in p.of if b not in p.without}
