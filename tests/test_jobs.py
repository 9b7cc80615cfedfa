import datetime as dt

import pytest

from workload_lens.config import JobConfig
from workload_lens.operators.checks import PreconditionFailed
from workload_lens.plans import collect
from workload_lens.sources.star import read_star


class FakeReader:
    """Stands in for the JDBC source: answers each query with given rows."""

    def __init__(self, spark, snapshot):
        self.spark, self.snapshot, self.query, self.queries = spark, snapshot, None, []

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        assert options["url"] == "jdbc:postgresql://db/app"
        return self

    def option(self, name, value):
        assert name == "query"
        self.query = value
        self.queries.append(value)
        return self

    def load(self):
        if "limit" not in self.query:
            return self.spark.sql(self.query)
        return self.snapshot


class FakeSession:
    def __init__(self, reader):
        self.read = reader


def test_collect_one_window(spark, make_snapshots, tmp_path):
    rows = make_snapshots([{"query": "select 1", "calls": 3.0}]).drop(
        "window_start", "window_end", "project", "environment", "cluster", "role", "fqdn"
    )
    reader = FakeReader(spark, rows)
    window = (dt.datetime(2024, 1, 5, 10), dt.datetime(2024, 1, 5, 10, 5))
    config = JobConfig(
        sanity_check="select true", project="p", environment="e", cluster="c", role="r", fqdn="f"
    )
    options = {"url": "jdbc:postgresql://db/app"}
    root = str(tmp_path / "star")
    collect.collect_window(FakeSession(reader), options, root, window, config)
    star = read_star(spark, root)
    event = star.statement_events.first()
    assert event.calls == 3.0 and event.batch_id.startswith("f-")
    assert {r.project for r in star.logical_sources.collect()} == {"all", "p"}
    assert "total_plan_time + total_exec_time" in reader.queries[1]
    bad = JobConfig(sanity_check="select false", fqdn="f")
    with pytest.raises(PreconditionFailed):
        collect.collect_window(FakeSession(reader), options, root, window, bad)


def test_command_line(spark, make_snapshots, tmp_path, monkeypatch, capsys):
    from workload_lens import __main__ as cli

    monkeypatch.setattr(cli, "build_session", lambda: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    files, star = str(tmp_path / "files"), str(tmp_path / "star")
    make_snapshots([{"query": "/*action:a*/ select 1", "day": d} for d in (1, 2)]).write.parquet(files)
    (tmp_path / "job.json").write_text('{"ContextAction": "action:([a-z]+)", "Project": "shop"}')

    def run(*words):
        monkeypatch.setattr("sys.argv", ["workload_lens", *words])
        cli.main()
        return capsys.readouterr().out

    settings = ("--config", str(tmp_path / "job.json"))
    run("ingest", *settings, "--snapshots", files, "--star", star, "--batch", "b1")
    out = run(
        "report", "--star", star, "--name", "most_frequent", "--interval", "5 days",
        "--as-of", "2024-01-04T00:00:00+00:00", "--project", "shop",
    )
    assert "select ?" in out and '"action":"a"' in out
    out = run("retain", "--star", star, "--as-of", "2024-01-23")
    assert out.count("expired") == 1 and read_star(spark, star).statement_events.count() == 1
