import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from workload_lens.plans import reports
from workload_lens.plans.ingest import derive_star

AS_OF = dt.datetime(2024, 1, 3, tzinfo=dt.timezone.utc)


def as_of():
    return F.expr("TIMESTAMP '2024-01-03 00:00:00'")


@pytest.fixture()
def star(make_snapshots):
    rows = [
        # Two contexts of one job tag in one event.
        {"query": "/*action:a,job_tag:j*/ select 1", "calls": 4.0, "total_time": 8.0},
        {"query": "/*action:b,job_tag:j*/ select 1", "calls": 6.0, "total_time": 12.0},
        {"query": "/*controller:c,action:b,job_tag:j*/ select 1", "calls": 5.0, "role": "secondary",
         "total_time": 50.0, "fqdn": "h2"},
        {"query": "/*controller:c,action:b*/ select 1", "calls": 5.0, "day": 2, "total_time": 10.0},
        {"query": "select x", "calls": 0.5, "day": 2, "total_time": 100.0},
        {"query": "/*job_tag:only*/ select y", "calls": 1.0, "day": 2, "total_time": 1.0},
    ]
    return derive_star(make_snapshots(rows))


def test_containment_is_half_open(spark):
    rows = [
        ("in", "2024-01-01 00:00:00", "2024-01-03 00:00:00"),
        ("early", "2023-12-31 23:59:59", "2024-01-03 00:00:00"),
        ("late", "2024-01-01 00:00:00", "2024-01-03 00:00:01"),
    ]
    df = spark.createDataFrame(rows, "k string, s string, e string").select(
        "k",
        F.to_timestamp("s").alias("observed_window_start"),
        F.to_timestamp("e").alias("observed_window_end"),
        F.to_date("s").alias("observed_date"),
    )
    assert [r.k for r in reports.in_interval(df, "2 days", as_of()).collect()] == ["in"]


def test_most_frequent(star):
    rows = reports.report_top(star, interval="2 days", as_of=as_of(), project="shop").collect()
    # "select x" has no whole call, so no context row, so it does not appear.
    assert [r.calls for r in rows] == [20.0, 1.0]
    assert float(rows[0].avg_ms_per_call) == 4.0
    assert rows[0].example.endswith("select ?")
    contexts = json.loads(rows[0].context)
    assert [c["times"] for c in contexts] == [6, 5, 5, 4]
    assert contexts[0] == {"times": 6, "controller": None, "action": "b", "job_tag": "j"}
    limited = reports.report_top(star, n=1, contexts=2, interval="2 days", as_of=as_of())
    assert len(json.loads(limited.first().context)) == 2 and limited.count() == 1


def test_most_time(star):
    top = reports.report_top(star, by="total_ms", interval="2 days", as_of=as_of()).collect()
    assert [r.total_ms for r in top] == [80.0, 1.0]
    nothing = reports.report_top(star, interval="2 days", as_of=as_of(), project="other")
    assert nothing.count() == 0


def test_against_history(star):
    rows = reports.report_vs_history(
        star, interval="1 day", as_of=as_of(), project="shop", cluster="c1"
    ).collect()
    mine = [r for r in rows if r.example.endswith("select ?")]
    assert {r.role for r in mine} == {"primary", "secondary", "all"}
    everywhere = next(r for r in mine if r.role == "all")
    assert everywhere.avg_ms_this_window == 10.0
    assert everywhere.avg_ms_overall == pytest.approx((20 + 50 + 10) / 3)


def test_role_share(star):
    share = reports.report_role_share(
        star, ["job_tag"], interval="2 days", as_of=as_of(), project="shop"
    ).collect()
    # All ten calls of the event count for each of its two contexts; "only" has one role.
    assert [(r.job_tag, r.total_calls) for r in share] == [("j", 25.0)]
    assert share[0].primary_percentage == pytest.approx(80.0)
    exact = reports.report_role_share(
        star, ["job_tag"], interval="2 days", as_of=as_of(), weight="context"
    ).first()
    assert exact.total_calls == 15.0
    pairs = reports.report_role_share(
        star, ["controller", "action"], interval="2 days", as_of=as_of()
    ).collect()
    assert [(r.controller, r.action, r.total_calls) for r in pairs] == [("c", "b", 10.0)]


def test_ranks_break_ties(spark):
    rows = [(1, None, 1, 1, 5), (1, 2, 1, 1, 5), (1, 1, 1, 1, 5), (1, 9, 9, 9, 7)]
    df = spark.createDataFrame(
        rows, "fingerprint_id long, controller_id long, action_id long, job_tag_id long, times long"
    )
    top = reports.top_contexts(df, 3).orderBy("r").collect()
    assert [r.controller_id for r in top] == [9, 1, 2]


def test_views(spark, star):
    star.register_views("v_")
    assert spark.sql("select sum(calls) as c from v_statement_events").first().c == 21.5
