"""The stored star schema: a ledger by day, and what is derived from it.

Batches only add to the ledger. A day whose facts and statistics were derived from all that
its ledger has now is *closed* and read as it was written; the facts of other days are
derived when they are read. So a window may come in several pieces, late, twice, or in a
batch that is written again, and every reader sees the same rows as from one delivery.
"""

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, fields
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from workload_lens.operators.dims import everywhere_source
from workload_lens.operators.facts import counted_once, facts_of
from workload_lens.operators.stats import merge_stats
from workload_lens.schemas import DAILY, DIMENSIONS, STAR, STORE
from workload_lens.sources import manifest
from workload_lens.sources.manifest import Part, Parts

# Tables that are derived when a day is closed, and the entry that says from what; it has no folder.
DERIVED = ["statement_events", "event_context", "day_stats", "window_quality"]
CLOSED = "closed"


@dataclass(frozen=True)
class Star:
    """Facts, dimensions and statistics, stored or derived."""

    controllers: DataFrame
    actions: DataFrame
    job_tags: DataFrame
    logical_sources: DataFrame
    physical_sources: DataFrame
    fingerprints: DataFrame
    statement_events: DataFrame
    event_context: DataFrame
    fingerprint_stats: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register_views(self, prefix: str = "") -> None:
        """Temp views for ad-hoc SQL over any period."""
        for name, table in self.tables().items():
            table.createOrReplaceTempView(f"{prefix}{name}")


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def of_table(parts: Parts, table: str, days: Iterable[str] | None = None) -> list[Part]:
    wanted = None if days is None else set(days)
    return [p for p in parts if p.table == table and (wanted is None or p.day in wanted)]


def ledger_state(parts: Parts) -> dict[str, tuple[str, ...]]:
    """What the ledger of each day consists of."""
    state = defaultdict(list)
    for part in of_table(parts, "ledger"):
        state[part.day].append(part.state)
    return {day: tuple(sorted(states)) for day, states in state.items()}


def closed_days(parts: Parts) -> list[str]:
    """Days whose facts were derived from all that their ledger has now."""
    state = ledger_state(parts)
    return sorted(p.day for p in of_table(parts, CLOSED) if state.get(p.day) == tuple(sorted(p.of)))


def open_days(parts: Parts) -> list[str]:
    """Days whose ledger has changed since their facts were derived."""
    closed = set(closed_days(parts))
    return sorted(day for day in ledger_state(parts) if day not in closed)


def create_star(spark: SparkSession, root: str) -> None:
    """Create the store if there is none; the sources get their "everywhere" row."""
    if manifest.exists(spark, root):
        return
    seed = everywhere_source(spark.createDataFrame([], STAR["logical_sources"]))
    part = write_part(seed, root, "logical_sources")
    manifest.commit(spark, root, lambda parts: parts or (part,))


def write_part(df: DataFrame, root: str, table: str, version: str | None = None) -> Part:
    """Write rows of a table without days into a folder of their own; they count once it is committed."""
    part = Part(table, version or manifest.new_version())
    df.select(*STORE[table].fieldNames()).write.parquet(f"{root.rstrip('/')}/{part.folder}")
    return part


def delete_part(spark: SparkSession, root: str, part: Part) -> None:
    fs, path = manifest.file_system(spark, f"{root.rstrip('/')}/{part.folder}")
    fs.delete(path, True)


def write_days(df: DataFrame, root: str, table: str, version: str) -> None:
    """Write rows into folders of their days below one version, which nobody else writes.

    The rebalance lets Spark merge small and split large partitions of a day at run time.
    Rows are sorted so that the footers of the files can skip other sources.
    """
    names = STORE[table].fieldNames()
    order = [c for c in ("logical_source_id", "fqdn", "fingerprint_id", "window_start") if c in names]
    (
        df.select(*names)
        .hint("rebalance", F.col("observed_date"))
        .sortWithinPartitions("observed_date", *order)
        .write.partitionBy("observed_date")
        .parquet(f"{table_path(root, table)}/version={version}")
    )


def read_parts(spark: SparkSession, root: str, table: str, parts: Iterable[Part]) -> DataFrame:
    """Rows of some folders of a table; rows of replaced batches are left out.

    Filters on the day prune folders, as the day is a partition.
    """
    parts = list(parts)
    if not parts:
        return spark.createDataFrame([], STORE[table])
    schema = StructType([*STORE[table].fields, StructField("version", StringType())])
    root = root.rstrip("/")
    reader = spark.read.schema(schema).option("basePath", table_path(root, table))
    rows = reader.parquet(*[f"{root}/{p.folder}" for p in parts])
    for part in parts:
        if part.without:
            rows = rows.where((F.col("version") != part.version) | ~F.col("batch_id").isin(*part.without))
    return rows.select(*STORE[table].fieldNames())


def read_ledger(spark: SparkSession, root: str, parts: Parts, days: Iterable[str]) -> DataFrame:
    """The rows of the ledger of some days, each once; days that one batch has brought need no look at their rows."""
    several, single = [], []
    by_day = defaultdict(list)
    for part in of_table(parts, "ledger", days):
        by_day[part.day].append(part)
    for own in by_day.values():
        batches = {b for p in own for b in p.of if b not in p.without}
        (several if len(batches) > 1 else single).extend(own)
    rows = read_parts(spark, root, "ledger", single)
    if several:
        again = counted_once(read_parts(spark, root, "ledger", several))
        rows = again.select(*rows.columns).unionByName(rows) if single else again
    return rows


def read_daily(spark: SparkSession, root: str, table: str, parts: Parts | None = None) -> DataFrame:
    """A derived table: closed days as they were written, open ones from their ledger."""
    parts = manifest.parts_of(spark, root) if parts is None else parts
    opened = open_days(parts)
    closed = of_table(parts, table, closed_days(parts))
    rows = read_parts(spark, root, table, closed)
    if opened:
        fresh = facts_of(read_ledger(spark, root, parts, opened))[table].select(*rows.columns)
        rows = rows.unionByName(fresh) if closed else fresh
    return rows


def read_dimension(spark: SparkSession, root: str, table: str, parts: Parts) -> DataFrame:
    """A dimension. Writers that raced may both have added a member, so of several rows of an id one counts."""
    own = of_table(parts, table)
    rows = read_parts(spark, root, table, own)
    return rows if len(own) < 2 else one_of_each(rows)


def one_of_each(members: DataFrame) -> DataFrame:
    """One row for each id, the same whatever their order."""
    rest = [c for c in members.columns if c != "id"]
    return members.groupBy("id").agg(F.min(F.struct(*rest)).alias("m")).select("id", "m.*")


def day_statistics(spark: SparkSession, root: str, since: date | None = None) -> DataFrame:
    """Statistics by day, from the first day on that counts; single batches are read for open days only."""
    rows = read_daily(spark, root, "day_stats")
    return rows if since is None else rows.where(F.col("observed_date") >= F.lit(since))


def read_statistics(spark: SparkSession, root: str, parts: Parts) -> DataFrame:
    """One row per key: the last generation, with days merged in that it does not have."""
    opened = open_days(parts)
    days = {p.version + p.day: p for p in of_table(parts, "day_stats", closed_days(parts))}
    folded = next(iter(of_table(parts, "fingerprint_stats")), None)
    usable = folded is not None and set(folded.of) <= set(days)
    rest = [p for key, p in days.items() if not usable or key not in folded.of]
    tables = [read_parts(spark, root, "fingerprint_stats", [folded])] if usable else []
    if rest or opened:
        some = read_parts(spark, root, "day_stats", rest)
        if opened:
            fresh = facts_of(read_ledger(spark, root, parts, opened))["day_stats"]
            some = some.unionByName(fresh.select(*some.columns)) if rest else fresh
        tables.append(some)
    if not tables:
        return read_parts(spark, root, "fingerprint_stats", [])
    return tables[0] if usable and len(tables) == 1 else merge_stats(*tables)


def read_table(spark: SparkSession, root: str, table: str, parts: Parts | None = None) -> DataFrame:
    parts = manifest.parts_of(spark, root) if parts is None else parts
    if table in DIMENSIONS:
        return read_dimension(spark, root, table, parts)
    if table == "fingerprint_stats":
        return read_statistics(spark, root, parts)
    if table in DERIVED:
        return read_daily(spark, root, table, parts)
    return read_parts(spark, root, table, of_table(parts, table))


def read_star(spark: SparkSession, root: str) -> Star:
    """All tables of one state of the store."""
    parts = manifest.parts_of(spark, root)
    return Star(**{table: read_table(spark, root, table, parts) for table in STAR})


def retained(facts: DataFrame, as_of: date, days: int = 21) -> DataFrame:
    """The facts that are young enough; reads only their partitions."""
    return facts.where(F.col("observed_date") >= F.lit(as_of - timedelta(days=days)))


def drop_expired(spark: SparkSession, root: str, as_of: date, days: int = 21) -> list[str]:
    """Take the days past retention out of every table: no file is read or rewritten.

    Statistics forget them too, as those of the other days are merged anew.
    """
    oldest = (as_of - timedelta(days=days)).isoformat()
    gone: list[Part] = []

    def change(parts: Parts) -> Parts:
        gone[:] = [p for p in parts if p.table in (*DAILY, CLOSED) and p.day < oldest]
        folded = {p.version + p.day for p in gone if p.table == "day_stats"}
        stale = [p for p in of_table(parts, "fingerprint_stats") if folded & set(p.of)]
        return tuple(p for p in parts if p not in gone and p not in stale)

    manifest.commit(spark, root, change)
    gone = [p for p in gone if p.table != CLOSED]
    for part in gone:
        delete_part(spark, root, part)
    return sorted(f"{root.rstrip('/')}/{p.folder}" for p in gone)
