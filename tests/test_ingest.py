import datetime as dt

import pytest
from pyspark.sql import functions as F

from workload_lens.config import JobConfig
from workload_lens.operators import checks
from workload_lens.operators.checks import PreconditionFailed  # noqa: F401 - see test_precondition
from workload_lens.operators.dims import upsert_dim
from workload_lens.operators.merge import statement_texts
from workload_lens.operators.stats import merge_stats
from workload_lens.plans.ingest import derive_star, ingest_batch
from workload_lens.sources.star import drop_expired, read_star, read_table, retained

ALL = JobConfig(top_k=None)


def rows_of(df, *drop):
    # Stored statistics are merged from those of days, so the last digits may differ.
    rounded = [F.round(c, 6).alias(c) if c in ("mean", "deviation") else F.col(c) for c in df.columns]
    return sorted(map(str, df.select(*rounded).drop("recorded_at", "batch_id", *drop).collect()))


def some_rows(days=(1, 2, 3)):
    return [
        {
            "day": day,
            "query": f"/*controller:k{i % 2},action:a{day}*/ select c{i % 3} from t where x = {i}",
            "calls": float(i + day),
            "total_time": 10.0 * i,
            "role": ("primary", "secondary")[i % 2],
            "fqdn": f"host{i % 2}",
        }
        for day in days
        for i in range(6)
    ]


def test_stored_equals_derived(spark, make_snapshots, tmp_path):
    snapshots = make_snapshots(some_rows())
    root = str(tmp_path / "star")
    ingest_batch(snapshots, root, "b1", ALL)
    stored, derived = read_star(spark, root).tables(), derive_star(snapshots).tables()
    for table in stored:
        assert rows_of(stored[table]) == rows_of(derived[table].select(*[
            c for c in stored[table].columns if c in derived[table].columns
        ])), table
    violations = [checks.all_fk_violations(stored, fact) for fact in checks.FOREIGN_KEYS]
    assert [v.count() for v in violations] == [0, 0, 0]
    for table, key in {"statement_events": ["id"], "fingerprints": ["fingerprint"]}.items():
        assert checks.unique_violations(stored[table], key).count() == 0
    good, bad = checks.split_valid(stored["event_context"], checks.rules_for("event_context"))
    assert bad.count() == 0 and good.count() > 0


def test_repeated_and_redelivered_batches_change_nothing(spark, make_snapshots, tmp_path):
    root = str(tmp_path / "star")
    first, second = make_snapshots(some_rows((1, 2))), make_snapshots(some_rows((3,)))
    ingest_batch(first, root, "b1", ALL)
    ingest_batch(second, root, "b2", ALL)
    before = {t: rows_of(df) for t, df in read_star(spark, root).tables().items()}
    ingest_batch(second, root, "b2", ALL)  # the same batch after a failure
    ingest_batch(first, root, "b3", ALL)  # the same windows in another batch
    after = {t: rows_of(df) for t, df in read_star(spark, root).tables().items()}
    assert before == after
    both = derive_star(make_snapshots(some_rows((1, 2, 3)))).fingerprint_stats
    merged = merge_stats(read_star(spark, root).fingerprint_stats)
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "deviation")]
    keys = ["fingerprint_id", "logical_source_id", "type", "count", "last"]
    assert rows_of(merged.select(*keys, *rounded)) == rows_of(both.select(*keys, *rounded))


def test_a_batch_that_stopped_half_way_is_not_seen_and_can_be_repeated(
    spark, make_snapshots, tmp_path, monkeypatch
):
    from workload_lens.plans import ingest

    root = str(tmp_path / "star")
    snapshots = make_snapshots(some_rows())
    write = ingest.write_part

    def failing(df, where, table, version=None):
        if table == "fingerprints":
            raise OSError("lost")
        return write(df, where, table, version)

    monkeypatch.setattr(ingest, "write_part", failing)
    with pytest.raises(OSError):
        ingest_batch(snapshots, root, "b1", ALL)
    assert read_star(spark, root).statement_events.count() == 0
    monkeypatch.setattr(ingest, "write_part", write)
    ingest_batch(snapshots, root, "b1", ALL)
    derived = derive_star(snapshots)
    stored = read_star(spark, root)
    assert rows_of(stored.event_context) == rows_of(derived.event_context)
    assert rows_of(stored.statement_events) == rows_of(derived.statement_events)


def test_quality_and_rejects_are_kept(spark, make_snapshots, tmp_path):
    root = str(tmp_path / "star")
    rows = some_rows((1,)) + [{"query": ""}, {"query": "select 'x from a_cursor_9"}]
    counts = ingest_batch(make_snapshots(rows), root, "b1", ALL)
    quality = read_table(spark, root, "window_quality").groupBy().sum("statements", "rejected")
    assert tuple(quality.first()) == (8, 2)
    rejects = read_table(spark, root, "rejects").collect()
    assert {r.reject_reason for r in rejects} == {"empty", "unfingerprintable"}
    assert counts["rows"] == 8 and counts["without_fingerprint"] == 2 and counts["window_order"] == 0


def test_top_k_applies(spark, make_snapshots, tmp_path):
    root = str(tmp_path / "star")
    rows = [{"query": f"select c{'x' * i}", "calls": float(i)} for i in range(1, 9)]
    ingest_batch(make_snapshots(rows), root, "b1", JobConfig(top_k=1))
    assert read_star(spark, root).statement_events.agg(F.max("calls")).first()[0] == 8.0


def test_a_row_that_comes_twice_counts_once_without_a_limit(spark, make_snapshots, tmp_path):
    row = {"query": "select 1", "queryid": 5, "calls": 10.0}
    ingest_batch(make_snapshots([dict(row), dict(row)]), str(tmp_path), "b1", JobConfig(top_k=None))
    assert read_star(spark, str(tmp_path)).statement_events.first()["calls"] == 10.0


def test_precondition(spark):
    checks.require(spark, "select true")
    for condition in ("select null", "select 1 > 2"):
        with pytest.raises(PreconditionFailed):
            checks.require(spark, condition)


def test_retention(spark, make_snapshots, tmp_path):
    root = str(tmp_path / "star")
    ingest_batch(make_snapshots([{"day": 1}, {"day": 2}, {"day": 9}]), root, "b1", ALL)
    as_of = dt.date(2024, 1, 23)  # day 2 is 21 days old, day 1 is 22
    kept = retained(read_star(spark, root).statement_events, as_of)
    assert sorted(r.observed_date.day for r in kept.collect()) == [2, 9]
    dropped = drop_expired(spark, root, as_of)
    assert len(dropped) == 1 and "2024-01-01" in dropped[0]
    days = {r.observed_date.day for r in read_star(spark, root).event_context.collect()}
    assert days == {2, 9}


def test_existing_members_stay(spark, make_snapshots):
    old = statement_texts(make_snapshots([{"query": "select a", "day": 2}]))
    new = statement_texts(make_snapshots([{"query": "SELECT a"}, {"query": "select b"}]))
    existing = upsert_dim("fingerprints", None, old)
    after = {r.normalized for r in upsert_dim("fingerprints", existing, new).collect()}
    assert after == {"select a", "select b"}
    first = statement_texts(make_snapshots([{"query": "SELECT a", "day": 3}, {"query": "select a"}]))
    assert upsert_dim("fingerprints", None, first).first().normalized == "select a"
    sources = upsert_dim("logical_sources", None, make_snapshots([{}, {}]))
    assert sorted(r.project for r in sources.collect()) == ["all", "shop"]


def test_each_check_finds_its_rows(spark):
    start, end = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    schema = "observed_window_start timestamp, observed_window_end timestamp, c long, event_id long"
    rows = [(start, end, 1, 1), (start, start, 1, 1), (start, end, 0, 1), (start, end, 1, None)]
    df = spark.createDataFrame(rows, schema)
    rules = {
        n: c for n, c in checks.rules_for("event_context").items()
        if n in ("window_order", "positive_count", "not_null_event_id")
    }
    _, bad = checks.split_valid(df, rules)
    assert sorted(r.violations[0] for r in bad.collect()) == [
        "not_null_event_id",
        "positive_count",
        "window_order",
    ]
    dimension = spark.createDataFrame([(1,)], "id long")
    facts = spark.createDataFrame([(1,), (2,), (2,), (None,)], "job_tag_id long")
    assert [tuple(r) for r in checks.fk_violations(facts, "job_tag_id", dimension).collect()] == [
        ("job_tag_id", 2, 2)
    ]
    assert checks.unique_violations(facts, ["job_tag_id"]).first().copies == 2
    types = spark.createDataFrame([("calls",), ("time",), (None,)], "type string")
    assert checks.unknown_types(types).count() == 2
