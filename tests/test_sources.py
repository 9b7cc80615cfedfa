import datetime as dt

import duckdb
from pyspark.sql import functions as F

from workload_lens.operators.calls import tumbling_snapshots
from workload_lens.operators.quality import window_gaps, window_quality
from workload_lens.operators.merge import annotate
from workload_lens.operators.topk import topk_union_branches
from workload_lens.schemas import METRICS, SNAPSHOT, SPLIT_TIMINGS
from workload_lens.sources.snapshots import (
    adapt_split_timings,
    read_snapshots,
    stamp,
    worst_statements_query,
)


def test_files(spark, make_snapshots, tmp_path):
    snapshots = make_snapshots([{"query": "select 1"}, {"query": None}])
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        snapshots.write.format(fmt).save(path)
        again = read_snapshots(spark, path, fmt)
        assert again.columns == SNAPSHOT.fieldNames()
        assert sorted(map(str, again.collect())) == sorted(map(str, snapshots.collect()))


def test_split_timings(spark, make_snapshots, tmp_path):
    df = make_snapshots([{"query": "select 1"}])
    for t in SPLIT_TIMINGS:
        df = df.withColumns(
            {f"{t}_plan_time": F.lit(2.0), f"{t}_exec_time": F.lit(5.0)}
        ).drop(f"{t}_time")
    row = adapt_split_timings(df).first()
    assert [row[f"{t}_time"] for t in SPLIT_TIMINGS] == [7.0] * 5
    df.write.parquet(str(tmp_path / "split"))
    assert read_snapshots(spark, str(tmp_path / "split"), split_timings=True).first() == row


def test_query_for_the_observed_database(make_snapshots):
    """The pushed-down SQL picks what the operator picks."""
    rows = [
        {"query": f"q{i}", "queryid": i, **{m: float((i * (j + 3)) % 17) + i / 100 for j, m in enumerate(METRICS)}}
        for i in range(1, 40)
    ]
    snapshots = make_snapshots(rows)
    expected = {r.queryid for r in topk_union_branches(snapshots, 2).collect()}
    db = duckdb.connect()
    db.register("local_rows", snapshots.toPandas())
    db.execute("create table pg_stat_statements as select * from local_rows")
    found = db.sql(worst_statements_query(k=2)).df()
    assert set(found["queryid"]) == expected and len(found) == len(expected) < 39
    assert "limit" not in worst_statements_query(k=None)
    assert "(total_plan_time + total_exec_time) as total_time" in worst_statements_query(
        split_timings=True
    )


def test_stamp(spark):
    rows = spark.createDataFrame([("select 1", 3)], "query string, calls int")
    window = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))
    source = {"project": "p", "environment": "e", "cluster": "c", "role": "r", "fqdn": "f"}
    row = stamp(rows, window, source).first()
    assert (row.project, row.fqdn, row.calls, row.queryid) == ("p", "f", 3.0, None)
    assert row.window_end - row.window_start == dt.timedelta(days=1)


def test_tumbling_windows(spark):
    at = [dt.datetime(2024, 1, 1, 0, m, tzinfo=dt.timezone.utc) for m in (0, 4, 5)]
    calls = spark.createDataFrame(
        [(at[0], 2.0, "q"), (at[1], 4.0, "q"), (at[2], 9.0, "q")],
        "ts timestamp, duration double, query string",
    )
    rows = tumbling_snapshots(calls, by=["query"]).orderBy("window_start").collect()
    assert [(r.calls, r.mean_time, r.stddev_time) for r in rows] == [(2.0, 3.0, 1.0), (1.0, 9.0, 0.0)]


def test_gaps_and_quality(make_snapshots):
    rows = [{"day": 1}, {"day": 1, "query": ""}, {"day": 2}, {"day": 4}]
    snapshots = make_snapshots(rows)
    gaps = window_gaps(snapshots, 86_400).orderBy("window_start").collect()
    assert [(r.gap_seconds, r.overrun) for r in gaps] == [
        (None, False), (0.0, False), (86_400.0, True)
    ]
    assert all(r.overrun for r in window_gaps(snapshots, 86_399).collect())
    quality = window_quality(annotate(snapshots)).orderBy("window_start").first()
    assert (quality.statements, quality.unique_fingerprints, quality.rejected) == (2, 1, 1)
