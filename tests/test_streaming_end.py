import datetime as dt
import json

from workload_lens.config import JobConfig
from workload_lens.operators.calls import tumbling_snapshots
from workload_lens.streaming.ingest import StatusLines, end_input, start_table, with_end


def _calls(spark, folder, minutes=60):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(at + dt.timedelta(minutes=m), float(m), f"q{m % 3}") for m in range(minutes)]
    calls = spark.createDataFrame(rows, "ts timestamp, duration double, query string")
    calls.write.parquet(folder)
    return calls


def test_a_bounded_stream_ends_with_every_window(spark, tmp_path):
    files, table, checkpoint, end = (str(tmp_path / n) for n in ("files", "table", "checkpoint", "end"))
    calls = _calls(spark, files)
    source = with_end(spark.readStream.schema(calls.schema).parquet(files), end)
    stream = tumbling_snapshots(source, by=["query"], watermark="0 seconds")

    def start():
        return start_table(stream, table, checkpoint, once=True)

    start().awaitTermination()
    assert spark.read.schema(stream.schema).parquet(table).count() == 33
    end_input(spark, source.schema, end, "ts", start)
    whole = spark.read.schema(stream.schema).parquet(table)
    every = tumbling_snapshots(calls, by=["query"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, every.collect()))
    assert whole.count() == 36 and whole.where("query is null").count() == 0


def test_status_lines_count_rows_and_overruns(spark, tmp_path):
    files, table, checkpoint = (str(tmp_path / n) for n in ("files", "table", "checkpoint"))
    calls = _calls(spark, files)
    stream = tumbling_snapshots(spark.readStream.schema(calls.schema).parquet(files), by=["query"], watermark="0 seconds")
    lines = []
    impatient = JobConfig(observation_interval=0, status_interval=1)
    query = start_table(stream, table, checkpoint, once=True)
    with StatusLines(query, impatient, lines.append) as status:
        query.awaitTermination()
        status.line()
    read = [json.loads(line) for line in lines]
    assert len(read) >= 2 and sum(line["rows"] for line in read) == 60
    assert status.overruns and read[-1]["last_batch"] >= 0
