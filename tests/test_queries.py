"""Every registered query against its SQL in DuckDB, and the plans behind them."""

import os

import pytest

import __spark_entry__ as driver
from verification.compare import difference, duckdb_tables
from verification.queries import QUERIES, as_of, stored_star
from workload_lens.plans import reports

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sql():
    return duckdb_tables(SF)


def test_each_query_has_sql():
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal(spark, sql, name):
    rows = driver.queries()[name](spark, SF).toPandas()
    assert difference(rows, sql.sql(driver.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("streaming")))
def test_no_cartesian_and_no_single_task_window(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan and "Python" not in plan


def test_reports_prune_days_and_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    star = stored_star(spark, SF)
    events = reports.fingerprint_totals(reports.in_interval(star.statement_events, "3 days", as_of()))
    plan = plan_of(events)
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    partitions = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "observed_date" in partitions and ">=" in partitions and "<=" in partitions
    pushed = scan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(observed_window_start" in pushed
    schema = scan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "fingerprint_id",
        "observed_window_start",
        "observed_window_end",
        "calls",
        "time",
    }


@pytest.mark.parametrize("name", ["window_merge", "topk_union", "report_vs_history"])
def test_equal_without_broadcast(spark, sql, name):
    """Sides that are too large to broadcast take the other way, with the same rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        query = QUERIES[name](spark, SF)
        joins = [w for w in plan_of(query).split() if w.endswith("HashJoin")]
        assert name == "report_vs_history" or not joins
        found = difference(query.toPandas(), sql.sql(driver.oracle_sql()[name]).df())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found is None
