import datetime as dt
import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from workload_lens.functions.moments import (
    combine_parts,
    moment_parts,
    moment_shift,
    pooled_deviation,
    pooled_parts,
    with_centre,
)
from workload_lens.operators.merge import (
    accumulate,
    accepted,
    annotate,
    combine,
    context_histogram,
    finish,
    fingerprint_rejects,
    window_merge,
)
from workload_lens.operators.stats import (
    fingerprint_stats,
    incomplete_stats,
    lifetime_counters,
    merge_stats,
)
from workload_lens.schemas import CONTEXT, EVENT_KEY, METRICS

groups = st.lists(
    st.lists(st.floats(0, 1000).map(lambda x: round(x, 3)), min_size=1, max_size=6),
    min_size=1,
    max_size=6,
)


def pooled(df, ddof, steps):
    """Mean and deviation of (half, n, m, d), directly or by way of the halves."""
    shifted = df.withColumn("key", F.lit(1)).withColumn("shift", moment_shift("m"))
    parts = moment_parts("n", "m", "d", ddof=ddof)
    if steps:
        grouped = shifted.groupBy("key", "half", "shift").agg(*parts)
        grouped = grouped.groupBy("key", "shift").agg(*combine_parts())
    else:
        grouped = shifted.groupBy("key", "shift").agg(*parts)
    once = with_centre(grouped, ["key"]).groupBy("key").agg(*pooled_parts())
    return once.select("mean", pooled_deviation(ddof=ddof)).first()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(groups, st.sampled_from([0, 1]), st.sampled_from([0.0, -1e7, 1e10]))
def test_pooling_equals_direct_statistics(spark, samples, ddof, far):
    deviation = statistics.pstdev if ddof == 0 else lambda v: statistics.stdev(v) if len(v) > 1 else 0.0
    samples = [[x + far for x in v] for v in samples]
    rows = [(i % 2, float(len(v)), statistics.fmean(v), deviation(v)) for i, v in enumerate(samples)]
    df = spark.createDataFrame(rows, "half int, n double, m double, d double")
    everything = [x for v in samples for x in v]
    for steps in (False, True):
        mean, dev = pooled(df, ddof, steps)
        assert mean == pytest.approx(statistics.fmean(everything), abs=1e-6 + abs(far) * 1e-15)
        assert dev == pytest.approx(deviation(everything), abs=1e-4)


def test_large_means_of_one_window_keep_their_deviation(make_snapshots):
    rows = [
        {"query": f"/*action:a{x}*/ select 1", "calls": 1.0, "mean_time": 1e10 + x, "stddev_time": 0.0}
        for x in (0, 100, 200, 300)
    ]
    merged = window_merge(annotate(make_snapshots(rows))).first()
    assert merged.stddev_time == pytest.approx(111.8033989) and merged.mean_time == 1e10 + 150


def test_means_on_both_sides_of_a_shift(spark):
    rows = [(0, 1.0, 4096.0 + x, 0.0) for x in (-0.75, -0.25, 0.25, 0.75)] + [(1, 2.0, 0.0, 0.0), (1, 0.0, 9e9, 5.0)]
    df = spark.createDataFrame(rows, "half int, n double, m double, d double")
    values = [4096.0 + x for x in (-0.75, -0.25, 0.25, 0.75)]
    mean, dev = pooled(df.where("half = 0"), 0, True)
    assert mean == pytest.approx(4096.0) and dev == pytest.approx(statistics.pstdev(values))
    mean, dev = pooled(df, 0, True)
    assert mean == pytest.approx(statistics.fmean([*values, 0, 0]))
    assert dev == pytest.approx(statistics.pstdev([*values, 0, 0]))


def test_single_statement_keeps_its_deviation(make_snapshots):
    rows = [{"calls": 7.0, "mean_time": 1e9, "stddev_time": 0.125}]
    merged = window_merge(annotate(make_snapshots(rows))).first()
    assert merged.stddev_time == 0.125 and merged.mean_time == 1e9


def test_merge_by_fingerprint_and_context(make_snapshots):
    rows = [
        {"query": "/*controller:a*/ select 1", "calls": 2.0, "min_time": 3.0, "max_time": 4.0},
        {"query": "/*controller:b*/ select 2", "calls": 3.0, "min_time": 1.0, "max_time": 9.0},
        {"query": "/*controller:b*/ select 2", "calls": 0.5, "userid": 11},
        {"query": "select x", "calls": 0.25},
        {"query": ""},
    ]
    statements = annotate(make_snapshots(rows))
    merged = {r.calls: r for r in window_merge(statements).collect()}
    assert sorted(merged) == [0.25, 5.5]
    assert (merged[5.5].min_time, merged[5.5].max_time, merged[5.5].rows) == (1.0, 9.0, 3.0)
    contexts = {(r.controller, r.c) for r in context_histogram(statements).collect()}
    assert contexts == {("a", 2), ("b", 3)}
    assert fingerprint_rejects(statements).first().reject_reason == "empty"


def test_merging_in_steps_equals_merging_at_once(make_snapshots):
    rows = [
        {
            "query": f"/*action:a{i % 3}*/ select {'x' if i % 2 else 'y'}",
            "calls": float(i),
            "mean_time": i * 1.5,
            "stddev_time": i / 3,
        }
        for i in range(1, 30)
    ]
    statements = annotate(make_snapshots(rows))
    fine = accumulate(accepted(statements), EVENT_KEY + CONTEXT)
    steps = {r.fingerprint: r for r in finish(combine(fine, EVENT_KEY), EVENT_KEY).collect()}
    for once in window_merge(statements).collect():
        for metric in METRICS:
            assert math.isclose(once[metric], steps[once.fingerprint][metric], rel_tol=1e-9)


def _merged(make_snapshots, days):
    rows = [
        {"day": day, "calls": float(c), "total_time": float(c) ** 2, "role": role, "fqdn": role}
        for day, c, role in days
    ]
    return window_merge(annotate(make_snapshots(rows)))


def test_statistics_and_their_merge(make_snapshots):
    days = [(1, 4, "primary"), (2, 8, "primary"), (3, 1, "primary"), (1, 2, "secondary")]
    merged = _merged(make_snapshots, days)
    whole = fingerprint_stats(merged)
    day = F.dayofmonth("window_start")
    halves = [fingerprint_stats(merged.where(c)) for c in (day < 3, day >= 3)]
    expected = {
        (r.logical_source_id, r.type): (r["count"], r["mean"], r["deviation"], r["last"])
        for r in whole.collect()
    }
    assert len(expected) == 3 * len(METRICS)
    everywhere = expected[(0, "calls")]
    assert everywhere[0] == 4
    assert everywhere[1] == pytest.approx(statistics.fmean([4, 8, 1, 2]))
    assert everywhere[2] == pytest.approx(statistics.stdev([4, 8, 1, 2]))
    for r in merge_stats(*halves).collect():
        count, mean, deviation, last = expected[(r.logical_source_id, r.type)]
        assert (r["count"], r["last"]) == (count, last)
        assert r["mean"] == pytest.approx(mean) and r["deviation"] == pytest.approx(deviation)
    assert incomplete_stats(whole).count() == 0
    assert incomplete_stats(whole.where("type <> 'rows'")).count() == 3


def test_large_means_keep_their_deviation(spark):
    rows = [
        (1, 0, "rows", 1, 1e10 + x, 0.0, dt.datetime(2024, 1, 1)) for x in (0.0, 100.0, 200.0, 300.0)
    ] + [(1, None, "rows", 1, 5.0, 0.0, dt.datetime(2024, 1, 1))]
    columns = "fingerprint_id long, logical_source_id long, type string, count long, mean double, deviation double, last timestamp"
    merged = {r["logical_source_id"]: r for r in merge_stats(spark.createDataFrame(rows, columns)).collect()}
    assert merged[0]["deviation"] == pytest.approx(129.0994449)
    assert merged[0]["mean"] == 1e10 + 150 and merged[0]["count"] == 4
    assert merged[None]["mean"] == 5.0


def test_one_sample_has_no_deviation(make_snapshots):
    stats = fingerprint_stats(_merged(make_snapshots, [(1, 5, "primary")]))
    assert {r["deviation"] for r in stats.collect()} == {0.0}


def test_lifetime_counters(make_snapshots):
    merged = _merged(make_snapshots, [(2, 3, "primary"), (1, 1, "primary"), (1, 1, "secondary")])
    rows = lifetime_counters(merged).orderBy("window_start").collect()
    assert [(r.calls_since_start, r.time_since_start) for r in rows] == [(2.0, 2.0), (5.0, 11.0)]
