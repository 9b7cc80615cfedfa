"""A window that comes again under other queryids counts once; rows of one batch that only these tell apart all count."""

from workload_lens.config import JobConfig
from workload_lens.plans import ingest
from workload_lens.sources.star import read_star

ALL = JobConfig(top_k=None)


def test_a_window_under_other_queryids_counts_once(spark, make_snapshots, tmp_path):
    root = str(tmp_path / "star")

    def rows():
        return make_snapshots([{"query": "select 1", "calls": 2.0}, {"query": "select 1", "calls": 2.0}, {"query": "select a", "calls": 3.0}])

    def calls():
        return sorted(r["calls"] for r in read_star(spark, root).statement_events.collect())

    ingest.ingest_batch(rows(), root, "one", ALL)
    assert calls() == [3, 4]
    ingest.ingest_batch(rows(), root, "two", ALL)
    assert calls() == [3, 4]
