"""Run registered queries next to their SQL in DuckDB and compare rows.

    python -m verification.compare <folder with the parquet tables> [query ...]
"""

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from verification.oracles import ORACLES
from verification.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duckdb_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif kind.startswith(("float", "int", "bool", "Int")):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} and {len(sql_rows)} rows"
    left, right = _sorted(spark_rows), _sorted(sql_rows)
    same = (left == right) | (left.isna() & right.isna())
    if bool(same.all().all()):
        return None
    bad = [c for c in left.columns if not bool(same[c].all())]
    row = (~same.all(axis=1)).idxmax()
    return (
        f"{int((~same.all(axis=1)).sum())} rows differ in {bad}: "
        f"{left.loc[row, bad].to_dict()} and {right.loc[row, bad].to_dict()}"
    )


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('COMPARE_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sql = duckdb_tables(sf_dir)
    failures = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            rows = QUERIES[name](spark, sf_dir).toPandas()
            verdict = difference(rows, sql.sql(ORACLES[name]).df()) if name in ORACLES else "no SQL"
            count = len(rows)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            verdict, count = f"{type(error).__name__}: {str(error)[:600]}", -1
        failures += verdict is not None
        print(f"{name:38} {count:7} {time.time() - start:6.2f}s  {verdict or 'equal'}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
