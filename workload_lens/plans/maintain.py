"""What a store needs from time to time: closed days, folded statistics, few folders, retention."""

from datetime import date
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from workload_lens.operators.facts import facts_of
from workload_lens.operators.stats import merge_stats
from workload_lens.plans.ingest import _side_by_side
from workload_lens.schemas import DIMENSIONS, STORE
from workload_lens.sources import manifest
from workload_lens.sources.manifest import Part, Parts
from workload_lens.sources.star import (
    CLOSED,
    DERIVED,
    closed_days,
    drop_expired,
    ledger_state,
    of_table,
    open_days,
    read_dimension,
    read_ledger,
    read_parts,
    write_days,
    write_part,
)


def close_days(spark: SparkSession, root: str, before: date | None = None) -> list[str]:
    """Derive facts, quality and statistics of the days whose ledger has changed; returns these days.

    A day with several ledger folders gets one of all rows that count, which still knows the
    batch of each row, so a batch can be written again later. If the ledger of a day changes
    meanwhile, that day stays as it is and is closed the next time.
    """
    parts = manifest.parts_of(spark, root)
    days = [d for d in open_days(parts) if before is None or d < before.isoformat()]
    if not days:
        _forget_empty_days(spark, root)
        return []
    state, version = ledger_state(parts), manifest.new_version()
    crowded = [d for d in days if len(state[d]) > 1 or any(p.without for p in of_table(parts, "ledger", [d]))]
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]

    tables = facts_of(read_ledger(spark, root, parts, days), keep)
    if crowded:
        # Every batch keeps its own rows here: which of two equal ones counts is decided when they are read.
        tables["ledger"] = read_parts(spark, root, "ledger", of_table(parts, "ledger", crowded))
    try:
        kept[-1].count()  # fills both caches before the writes below share them
        _side_by_side(spark, *[partial(write_days, df, root, t, version) for t, df in tables.items()])
    finally:
        for df in kept:
            df.unpersist()
    batches = {
        d: tuple(sorted({b for p in of_table(parts, "ledger", [d]) for b in p.of if b not in p.without}))
        for d in days
    }
    closed: list[str] = []

    def change(now: Parts) -> Parts | None:
        closed[:] = [d for d in days if ledger_state(now).get(d) == state[d]]
        merged = [d for d in closed if d in crowded]
        if not closed:
            return None
        rest = [
            p for p in now
            if not (p.table in (*DERIVED, CLOSED) and p.day in closed) and not (p.table == "ledger" and p.day in merged)
        ]
        fresh = [Part("ledger", version, d, batches[d]) for d in merged]
        fresh += [Part(table, version, d) for table in DERIVED for d in closed]
        fresh = [p for p in fresh if _has(spark, root, p)]  # a day without accepted rows has no facts
        marks = [Part(CLOSED, version, d, (version,) if d in merged else state[d]) for d in closed]
        return (*rest, *fresh, *marks)

    manifest.commit(spark, root, change)
    _forget_empty_days(spark, root)
    return closed


def _forget_empty_days(spark: SparkSession, root: str) -> None:
    """Drop what was derived from days of which a rewritten batch has left nothing."""

    def change(now: Parts) -> Parts:
        days = ledger_state(now)
        return tuple(p for p in now if p.table not in (*DERIVED, CLOSED) or p.day in days)

    manifest.commit(spark, root, change)


def _has(spark: SparkSession, root: str, part: Part) -> bool:
    fs, path = manifest.file_system(spark, f"{root.rstrip('/')}/{part.folder}")
    return fs.exists(path)


def fold_statistics(spark: SparkSession, root: str) -> bool:
    """Replace the statistics by a new generation, one row per key, made of all closed days.

    If the last generation has only days that still count, the others are merged into it;
    else all days are merged anew. Which days a generation has is committed with it.
    """
    parts = manifest.parts_of(spark, root)
    days = {p.version + p.day: p for p in of_table(parts, "day_stats", closed_days(parts))}
    last = of_table(parts, "fingerprint_stats")
    base = [p for p in last if set(p.of) <= set(days)]
    rest = [p for key, p in days.items() if not any(key in b.of for b in base)]
    if not days or (base and not rest):
        return False
    tables = [read_parts(spark, root, "fingerprint_stats", base)] if base else []
    merged = merge_stats(*tables, *([read_parts(spark, root, "day_stats", rest)] if rest else []))
    ordered = merged.repartition("fingerprint_id").sortWithinPartitions("type", "fingerprint_id")
    part = write_part(ordered, root, "fingerprint_stats")
    part = Part(part.table, part.version, of=tuple(sorted(days)))

    def change(now: Parts) -> Parts | None:
        if of_table(now, "fingerprint_stats") != last:
            return None  # another job has folded meanwhile
        return (*[p for p in now if p.table != "fingerprint_stats"], part)

    return part in manifest.commit(spark, root, change)


def compact_dimensions(spark: SparkSession, root: str, most: int = 8) -> list[str]:
    """Write dimensions that consist of many folders into one, each member once."""
    parts = manifest.parts_of(spark, root)
    done = []
    for table in DIMENSIONS:
        own = of_table(parts, table)
        if len(own) <= most:
            continue
        part = write_part(read_dimension(spark, root, table, parts), root, table)

        def change(now: Parts, table: str = table, own: list[Part] = own, part: Part = part) -> Parts | None:
            if not set(own) <= set(now):
                return None  # another job has done it
            return (*[p for p in now if p not in own], part)

        if part in manifest.commit(spark, root, change):
            done.append(table)
    return done


def compact_ledger(spark: SparkSession, root: str, most: int = 100) -> list[str]:
    """Write the ledger of open days that have many folders into one for each day."""
    parts = manifest.parts_of(spark, root)
    days = [d for d, state in ledger_state(parts).items() if len(state) > most]
    for table, wanted in (("ledger", days), ("rejects", None)):
        own = of_table(parts, table, wanted)
        crowded = sorted({p.day for p in own if sum(q.day == p.day for q in own) > most})
        if not crowded:
            continue
        version = manifest.new_version()
        old = of_table(parts, table, crowded)
        write_days(read_parts(spark, root, table, old), root, table, version)

        def change(now: Parts, table: str = table, old: list[Part] = old, version: str = version) -> Parts | None:
            if not set(old) <= set(now):
                return None  # a batch was written again meanwhile
            fresh = []
            for day in sorted({p.day for p in old}):
                of = {b for p in old if p.day == day for b in p.of if b not in p.without}
                fresh.append(Part(table, version, day, tuple(sorted(of))))
            return (*[p for p in now if p not in old], *[p for p in fresh if _has(spark, root, p)])

        manifest.commit(spark, root, change)
    return days


def maintain(
    spark: SparkSession,
    root: str,
    as_of: date | None = None,
    retention_days: int = 21,
    close_before: date | None = None,
    grace_hours: float = 24.0,
) -> dict[str, list[str]]:
    """Drop what is past retention, close days, fold statistics, and delete folders that nothing refers to."""
    expired = drop_expired(spark, root, as_of, retention_days) if as_of else []
    compact_ledger(spark, root)
    closed = close_days(spark, root, close_before)
    fold_statistics(spark, root)
    compact_dimensions(spark, root)
    return {"expired": expired, "closed": closed, "deleted": manifest.vacuum(spark, root, list(STORE), grace_hours)}
