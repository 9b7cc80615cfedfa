"""The store: commits, pieces of windows, rewritten batches, folding and folders."""

import datetime as dt
import os
import threading

from pyspark.sql import functions as F

from workload_lens.config import JobConfig
from workload_lens.operators.stats import merge_stats
from workload_lens.plans import maintain, reports
from workload_lens.plans.ingest import batches_of, derive_star, ingest_batch
from workload_lens.schemas import STORE
from workload_lens.sources import manifest
from workload_lens.sources.manifest import Part
from workload_lens.sources.star import (
    create_star,
    day_statistics,
    of_table,
    open_days,
    read_star,
    read_table,
    write_part,
)

ALL = JobConfig(top_k=None)


def rows_of(df, *drop):
    rounded = [F.round(c, 6).alias(c) if c in ("mean", "deviation") else F.col(c) for c in df.columns]
    return sorted(map(str, df.select(*rounded).drop("recorded_at", "batch_id", *drop).collect()))


def some_rows(days=(1, 2, 3), factor=1.0):
    return [
        {
            "day": day,
            "query": f"/*controller:k{i % 2},action:a{day}*/ select c{i % 3} from t where x = {i}",
            "queryid": i,
            "calls": factor * (i + day),
            "total_time": 10.0 * i * day,
            "mean_time": 1e9 + i,
            "role": ("primary", "secondary")[i % 2],
            "fqdn": f"host{i % 2}",
        }
        for day in days
        for i in range(6)
    ]


FACTS = ("statement_events", "event_context", "fingerprint_stats")


def facts(spark, snapshots):
    """The facts and statistics of one delivery of some rows."""
    derived = derive_star(snapshots).tables()
    return {t: rows_of(derived[t].select(*[f for f in STORE[t].fieldNames() if f in derived[t].columns])) for t in FACTS}


def stored(spark, root):
    tables = read_star(spark, root).tables()
    return {t: rows_of(tables[t]) for t in FACTS}


def test_pieces_late_pieces_and_repeats_equal_one_delivery(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    rows = some_rows()
    whole = facts(spark, make_snapshots([dict(r) for r in rows]))
    ingest_batch(make_snapshots([dict(r) for r in rows[::2]]), root, "even", ALL)
    maintain.maintain(spark, root)
    ingest_batch(make_snapshots([dict(r) for r in rows[1::2]]), root, "odd", ALL)  # late
    ingest_batch(make_snapshots([dict(r) for r in rows[:9]]), root, "again", ALL)  # of both pieces
    assert stored(spark, root) == whole
    assert maintain.close_days(spark, root) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    maintain.fold_statistics(spark, root)
    assert stored(spark, root) == whole
    assert open_days(manifest.parts_of(spark, root)) == [] and batches_of(spark, root) == {"even", "odd", "again"}


def test_another_row_of_a_statement_adds_to_its_window(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    for batch, calls in (("one", 5.0), ("two", 7.0), ("three", 5.0)):
        ingest_batch(make_snapshots([{"queryid": 1, "calls": calls}]), root, batch, ALL)
    assert read_star(spark, root).statement_events.first()["calls"] == 12.0


def test_a_rewritten_batch_leaves_nothing_behind(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    ingest_batch(make_snapshots(some_rows((1, 2), factor=3.0)), root, "one", ALL)
    ingest_batch(make_snapshots(some_rows((2, 3))), root, "two", ALL)
    maintain.maintain(spark, root)
    shared = [p for p in of_table(manifest.parts_of(spark, root), "ledger") if p.day == "2024-01-02"]
    assert [p.of for p in shared] == [("one", "two")]
    ingest_batch(make_snapshots(some_rows((2,))), root, "one", ALL)
    left = facts(spark, make_snapshots(some_rows((2, 3))))
    assert stored(spark, root) == left
    maintain.maintain(spark, root, grace_hours=0)
    assert stored(spark, root) == left
    assert not any("2024-01-01" in p.folder for p in manifest.parts_of(spark, root))
    assert {r["day"] for r in read_star(spark, root).event_context.select(F.dayofmonth("observed_date").alias("day")).collect()} == {2, 3}


def test_folding_reads_one_generation_and_one_row_a_key(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    for day in (1, 2, 3, 2):
        ingest_batch(make_snapshots(some_rows((day,))), root, f"day-{day}", ALL)
        maintain.close_days(spark, root)
        maintain.fold_statistics(spark, root)
    star = read_star(spark, root)
    assert stored(spark, root) == facts(spark, make_snapshots(some_rows()))
    files = {os.path.dirname(f) for f in star.fingerprint_stats.inputFiles()}
    generation = of_table(manifest.parts_of(spark, root), "fingerprint_stats")
    assert len(files) == 1 and len(generation) == 1 and next(iter(files)).endswith(generation[0].folder)
    keys = star.fingerprint_stats.groupBy("fingerprint_id", "logical_source_id", "type").count()
    assert keys.where("count > 1").count() == 0
    assert maintain.fold_statistics(spark, root) is False


def test_statistics_forget_expired_days(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    ingest_batch(make_snapshots(some_rows((1, 2, 9))), root, "all", ALL)
    since = merge_stats(day_statistics(spark, root, dt.date(2024, 1, 2)))
    kept = derive_star(make_snapshots(some_rows((2, 9)))).fingerprint_stats
    assert rows_of(since) == rows_of(kept)
    maintain.maintain(spark, root)
    done = maintain.maintain(spark, root, dt.date(2024, 1, 23))
    assert done["expired"] and all("2024-01-01" in folder for folder in done["expired"])
    assert rows_of(read_star(spark, root).fingerprint_stats) == rows_of(kept)
    assert read_table(spark, root, "window_quality").select("observed_date").distinct().count() == 2


def test_many_small_batches_leave_few_folders(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    rows = some_rows((1, 2))[::3]
    whole = facts(spark, make_snapshots([dict(r) for r in rows]))
    for i, row in enumerate(rows):
        ingest_batch(make_snapshots([dict(row)]), root, f"b{i}", ALL)
    assert len(of_table(manifest.parts_of(spark, root), "ledger")) == len(rows)
    maintain.compact_ledger(spark, root, most=1)
    maintain.compact_dimensions(spark, root, most=1)
    assert len(of_table(manifest.parts_of(spark, root), "ledger")) == 2
    ingest_batch(make_snapshots([dict(rows[0], calls=99.0)]), root, "b0", ALL)
    assert read_star(spark, root).statement_events.agg(F.max("calls")).first()[0] >= 99.0
    ingest_batch(make_snapshots([dict(rows[0])]), root, "b0", ALL)
    maintain.maintain(spark, root, grace_hours=0)
    assert stored(spark, root) == whole
    folders = [d for d, _, files in os.walk(root) if any(f.endswith(".parquet") for f in files)]
    assert len(folders) == len([p for p in manifest.parts_of(spark, root) if p.table != "closed"]) < 25


def test_a_label_that_is_missing_goes_to_the_rejects(spark, make_snapshots, tmp_path):
    from pyspark.sql.types import StructField, StructType

    root = str(tmp_path)
    frame = make_snapshots([{"queryid": 1}, {"queryid": 2, "fqdn": "x"}])
    loose = spark.createDataFrame(
        frame.withColumn("fqdn", F.expr("nullif(fqdn, 'x')")).rdd,
        StructType([StructField(f.name, f.dataType, True) for f in frame.schema]),
    )
    broken = loose.limit(1).withColumn("window_end", F.col("window_start") - F.expr("interval 1 hour"))
    for batch in ("one", "two"):
        counts = ingest_batch(loose.unionByName(broken), root, batch, ALL)
    assert counts["not_null_fqdn"] == 1 and counts["window_order"] == 1 and counts["rows"] == 1
    assert read_star(spark, root).statement_events.agg(F.sum("calls")).first()[0] == 1.0
    reasons = {r.reject_reason for r in read_table(spark, root, "rejects").collect()}
    assert reasons == {"not_null_fqdn", "window_order"}


def test_writers_that_race_both_count(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    create_star(spark, root)
    errors = []

    def write(day):
        try:
            ingest_batch(make_snapshots(some_rows((day,))), root, f"day-{day}", ALL)
        except Exception as error:  # noqa: BLE001 - shown below
            errors.append(error)

    threads = [threading.Thread(target=write, args=(day,)) for day in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert errors == []
    assert stored(spark, root) == facts(spark, make_snapshots(some_rows((1, 2))))


def test_a_slower_writer_starts_again(spark, tmp_path):
    root, seen = str(tmp_path), []

    def slow(parts):
        seen.append(parts)
        if len(seen) == 1:
            manifest.commit(spark, root, lambda now: (*now, Part("ledger", "fast", "2024-01-01", ("f",))))
        return (*parts, Part("ledger", "slow", "2024-01-01", ("s",)))

    after = manifest.commit(spark, root, slow)
    assert [p.version for p in after] == ["fast", "slow"] and len(seen) == 2
    assert manifest.parts_of(spark, root) == after
    assert manifest.commit(spark, root, lambda now: None) == after


def test_a_report_is_the_same_with_a_member_twice(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    ingest_batch(make_snapshots(some_rows()), root, "all", ALL)

    def report():
        star = read_star(spark, root)
        rows = reports.report_top(star, by="calls", interval="9 days", as_of=dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc))
        return [tuple(r) for r in rows.collect()]

    before = report()
    twice = read_star(spark, root).fingerprints
    part = write_part(twice.withColumn("normalized", F.concat("normalized", F.lit("~"))), root, "fingerprints")
    manifest.commit(spark, root, lambda now: (*now, part))
    assert report() == before and len(before) == 3


def test_what_nothing_refers_to_is_deleted_after_a_while(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    ingest_batch(make_snapshots(some_rows((1,))), root, "one", ALL)
    ingest_batch(make_snapshots(some_rows((1,))), root, "one", ALL)
    assert manifest.vacuum(spark, root, list(STORE), 24.0) == []
    gone = manifest.vacuum(spark, root, list(STORE), 0.0)
    ledgers = [folder for folder in gone if "/ledger/" in folder]
    assert len(ledgers) == 1 and ledgers[0].endswith("/observed_date=2024-01-01")
    assert read_star(spark, root).statement_events.count() == 6  # two roles and three texts, each pair once


def test_an_empty_store(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    create_star(spark, root)
    assert read_star(spark, root).statement_events.count() == 0
    assert read_star(spark, root).fingerprint_stats.count() == 0
    ingest_batch(make_snapshots([]), root, "nothing", ALL)
    assert maintain.maintain(spark, root, dt.date(2024, 1, 1))["closed"] == []
    assert [r.project for r in read_star(spark, root).logical_sources.collect()] == ["all"]


def test_days_before_a_date_are_closed(spark, make_snapshots, tmp_path):
    root = str(tmp_path)
    ingest_batch(make_snapshots(some_rows((1, 2))), root, "all", ALL)
    assert maintain.close_days(spark, root, dt.date(2024, 1, 2)) == ["2024-01-01"]
    assert stored(spark, root) == facts(spark, make_snapshots(some_rows((1, 2))))
