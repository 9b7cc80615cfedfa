"""Constraints that files do not enforce, as operators."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload_lens.schemas import DIMENSIONS, METRICS, STAR

# The row constraints of the fact tables.
CHECKS = {
    "statement_events": {"window_order": "observed_window_end > observed_window_start"},
    "event_context": {
        "window_order": "observed_window_end > observed_window_start",
        "positive_count": "c > 0",
    },
    "snapshots": {"window_order": "window_end > window_start"},
}

# Fact table -> (column, dimension) that has to exist; NULL is allowed for context ids.
FOREIGN_KEYS = {
    "statement_events": [
        ("fingerprint_id", "fingerprints"),
        ("logical_source_id", "logical_sources"),
        ("physical_source_id", "physical_sources"),
    ],
    "event_context": [
        ("controller_id", "controllers"),
        ("action_id", "actions"),
        ("job_tag_id", "job_tags"),
    ],
    "fingerprint_stats": [
        ("fingerprint_id", "fingerprints"),
        ("logical_source_id", "logical_sources"),
    ],
}


class PreconditionFailed(RuntimeError):
    """The data is not what the job was meant to read."""


def rules_for(table: str) -> dict[str, Column]:
    """CHECK and NOT NULL rules of a table, as name -> condition that a good row meets."""
    rules = {name: F.expr(condition) for name, condition in CHECKS.get(table, {}).items()}
    required = [f.name for f in STAR[table].fields if not f.nullable] if table in STAR else []
    return {**{f"not_null_{c}": F.col(c).isNotNull() for c in required}, **rules}


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add the sorted names of the rules each row breaks. NULL counts as met, as in SQL."""
    broken = [F.when(~condition, F.lit(name)) for name, condition in sorted(rules.items())]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the reasons."""
    checked = with_violations(df, rules)
    good = checked.where(F.size("violations") == 0).drop("violations")
    return good, checked.where(F.size("violations") > 0)


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def fk_violations(df: DataFrame, column: str, dimension: DataFrame) -> DataFrame:
    """Ids of ``column`` that the dimension lacks, with the number of rows that use them.

    Ids are counted before the join, so a hot id is one row per split.
    """
    used = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id"))
    used = used.agg(F.count(F.lit(1)).alias("uses"))
    return used.join(dimension.select("id"), "id", "left_anti").select(
        F.lit(column).alias("column_name"), "id", "uses"
    )


def all_fk_violations(tables: dict[str, DataFrame], fact: str) -> DataFrame:
    parts = [fk_violations(tables[fact], c, tables[dim]) for c, dim in FOREIGN_KEYS[fact]]
    return reduce(DataFrame.unionByName, parts)


def store_violations(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a star schema breaks of its constraints, by the name of the check."""
    found = {}
    for fact in FOREIGN_KEYS:
        found[f"{fact}: foreign keys"] = all_fk_violations(tables, fact)
    for fact in ("statement_events", "event_context"):
        found[f"{fact}: rows"] = split_valid(tables[fact], rules_for(fact))[1]
    for dimension, key in DIMENSIONS.items():
        found[f"{dimension}: keys"] = unique_violations(tables[dimension], key)
        found[f"{dimension}: ids"] = unique_violations(tables[dimension], ["id"])
    found["statement_events: ids"] = unique_violations(tables["statement_events"], ["id"])
    found["fingerprint_stats: types"] = unknown_types(tables["fingerprint_stats"])
    return found


def unknown_types(stats: DataFrame) -> DataFrame:
    """Rows whose metric name is not one of the 19."""
    return stats.where(~F.col("type").isin(METRICS) | F.col("type").isNull())


def require(spark: SparkSession, condition: str) -> None:
    """Run a boolean query and stop if it is not true; meant to precede every batch."""
    rows = spark.sql(condition).limit(2).collect()
    if len(rows) != 1 or rows[0][0] is not True:
        raise PreconditionFailed(f"precondition does not hold: {condition}")
