import random

from workload_lens.operators import topk
from workload_lens.schemas import METRICS


def _rows(n, groups=2):
    random.seed(7)
    return [
        {
            "query": f"select {i}",
            "queryid": i,
            "cluster": f"c{i % groups}",
            **{m: float(random.randint(0, 20)) for m in METRICS},
        }
        for i in range(n)
    ]


def _brute_force(rows, k):
    import hashlib

    kept = set()
    for cluster in {r["cluster"] for r in rows}:
        group = [r for r in rows if r["cluster"] == cluster]
        for m in METRICS:
            digest = lambda r: hashlib.md5(r["query"].encode()).hexdigest()
            ranked = sorted(group, key=lambda r: (-r[m], digest(r), r["queryid"]))
            kept.update(r["queryid"] for r in ranked[:k])
    return kept


def test_union_equals_brute_force(make_snapshots, monkeypatch):
    rows = _rows(120)
    expected = _brute_force(rows, 3)
    snapshots = make_snapshots([dict(r) for r in rows])
    kept = [r.queryid for r in topk.topk_union(snapshots, 3).collect()]
    assert sorted(kept) == sorted(expected) and len(kept) < 120
    # The salted way for a large k gives the same rows.
    monkeypatch.setattr(topk, "_GROUP_LIMIT_MAX", 1)
    assert {r.queryid for r in topk.topk_union(snapshots, 3).collect()} == expected


def test_branches_agree_for_one_poll(make_snapshots):
    snapshots = make_snapshots(_rows(60, groups=1))
    one_pass = {r.queryid for r in topk.topk_union(snapshots, 2).collect()}
    assert {r.queryid for r in topk.topk_union_branches(snapshots, 2).collect()} == one_pass


def test_duplicates_nulls_and_no_limit(make_snapshots):
    rows = [
        {"query": "select a", "queryid": 1, "calls": None},
        {"query": "select b", "queryid": 2, "calls": 5.0},
        {"query": "select b", "queryid": 2, "calls": 5.0},
        {"query": "select b", "queryid": 2, "calls": 5.0, "userid": 99},
    ]
    snapshots = make_snapshots(rows)
    assert topk.topk_by_metric(snapshots, "calls", 1).first().queryid == 1
    assert topk.topk_union(snapshots, None).count() == 3
    assert topk.topk_union(snapshots, 10).count() == 3


def test_rows_that_differ_in_which_value_is_null_stay_apart(make_snapshots):
    rows = [
        {"queryid": 1, "blk_read_time": None, "blk_write_time": 7.0},
        {"queryid": 1, "blk_read_time": 7.0, "blk_write_time": None},
    ]
    snapshots = make_snapshots(rows)
    assert topk.topk_union(snapshots, 100).count() == topk.topk_union(snapshots, None).count() == 2


def test_one_metric_above_the_limit_of_spark(make_snapshots, monkeypatch):
    snapshots = make_snapshots(_rows(60))
    few = sorted(r.queryid for r in topk.topk_by_metric(snapshots, "calls", 3).collect())
    monkeypatch.setattr(topk, "_GROUP_LIMIT_MAX", 1)
    assert sorted(r.queryid for r in topk.topk_by_metric(snapshots, "calls", 3).collect()) == few


def test_hot_group_is_limited_before_the_shuffle(make_snapshots):
    plan = topk.topk_union(make_snapshots(_rows(10)), 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    window, shuffle = text.rindex("WindowGroupLimit"), text.index("Window [row_number")
    assert text.count("WindowGroupLimit") == 2 and shuffle < window
