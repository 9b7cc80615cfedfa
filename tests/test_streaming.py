import datetime as dt

from pyspark.sql import functions as F

from workload_lens.config import JobConfig
from workload_lens.operators.calls import tumbling_snapshots
from workload_lens.operators.stats import merge_stats
from workload_lens.plans.ingest import derive_star
from workload_lens.schemas import METRICS
from workload_lens.sources.snapshots import stream_snapshots
from workload_lens.sources.star import read_star
from workload_lens.streaming.ingest import hold_until_closed, progress, start_ingest, start_table

ALL = JobConfig(top_k=None)


def _write_days(make_snapshots, folder, days):
    for day in days:
        rows = [
            {"day": day, "query": f"/*action:a{i}*/ select c{i % 2}", "calls": float(i * day)}
            for i in range(1, 5)
        ]
        make_snapshots(rows).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_and_a_second_delivery_changes_nothing(spark, make_snapshots, tmp_path):
    files, root, checkpoint = (str(tmp_path / n) for n in ("files", "star", "checkpoint"))
    _write_days(make_snapshots, files, (1, 2))

    def run():
        stream = stream_snapshots(spark, files, max_files_per_trigger=1)
        query = start_ingest(stream, root, checkpoint, ALL, once=True)
        query.awaitTermination()
        return query

    query = run()
    assert progress(query, ALL)["overrun"] is False
    _write_days(make_snapshots, files, (3,))
    run()
    _write_days(make_snapshots, files, (2,))  # the same window under another name
    run()

    batch = derive_star(spark.read.parquet(files).drop("queryid").distinct().withColumn(
        "queryid", F.lit(None).cast("long")
    ))
    stored = read_star(spark, root)
    keys = ["fingerprint_id", "logical_source_id", "type", "count"]
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "deviation")]

    def stats(df):
        return sorted(map(str, df.select(*keys, *rounded).collect()))

    assert stats(merge_stats(stored.fingerprint_stats)) == stats(batch.fingerprint_stats)
    events = ["id", "calls", "time", "observed_date"]
    assert sorted(map(str, stored.statement_events.select(*events).collect())) == sorted(
        map(str, batch.statement_events.select(*events).collect())
    )
    assert stored.statement_events.select("batch_id").distinct().count() == 3


def test_windows_in_pieces_pass_together(spark, make_snapshots, tmp_path):
    files, table, checkpoint = (str(tmp_path / n) for n in ("files", "table", "checkpoint"))

    def deliver(rows):
        make_snapshots(rows).coalesce(1).write.mode("append").parquet(files)
        stream = hold_until_closed(stream_snapshots(spark, files), "1 hour")
        start_table(stream, table, checkpoint, once=True).awaitTermination()
        return spark.read.schema(stream.schema).parquet(table)

    first = {"day": 1, "query": "select a", "queryid": 1}
    assert deliver([first]).count() == 0
    assert deliver([dict(first), {"day": 1, "query": "select b", "queryid": 2}]).count() == 0
    assert deliver([{"day": 1, "query": "select b", "queryid": 2, "calls": 5.0}]).count() == 0
    closed = deliver([{"day": 5, "query": "select c", "queryid": 3}])
    assert sorted((r.query, r.calls) for r in closed.collect()) == [
        ("select a", 1.0), ("select b", 1.0), ("select b", 5.0)
    ]
    assert set(METRICS) <= set(closed.columns)


def test_tumbling_stream_equals_batch(spark, tmp_path):
    files, table, checkpoint = (str(tmp_path / n) for n in ("files", "table", "checkpoint"))
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(at + dt.timedelta(minutes=m), float(m), f"q{m % 3}") for m in range(60)]
    calls = spark.createDataFrame(rows, "ts timestamp, duration double, query string")
    calls.write.parquet(files)
    stream = tumbling_snapshots(
        spark.readStream.schema(calls.schema).parquet(files), by=["query"], watermark="0 seconds"
    )
    start_table(stream, table, checkpoint, once=True).awaitTermination()
    closed = spark.read.schema(stream.schema).parquet(table)
    batch = tumbling_snapshots(calls, by=["query"]).where("window_end <= '2024-01-01 00:59:00'")
    assert sorted(map(str, closed.collect())) == sorted(map(str, batch.collect()))
    assert closed.count() == 33
