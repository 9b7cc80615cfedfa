"""Surrogate keys computed from natural keys.

A key is a function of the natural key alone, so any number of jobs can write facts and
dimensions side by side: no sequence, no lookup join, no insert race. Two natural keys
that meet in one id are found by ``checks.unique_violations`` on the dimension.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from workload_lens.schemas import SOURCE

def hash_id_sql(*parts: str) -> str:
    """Positive 60-bit id of a natural key; NULL if any part is NULL."""
    text = ", char(31), ".join(parts)
    return f"cast(conv(substring(md5(concat({text})), 1, 15), 16, 10) as bigint)"


def hash_id(*parts: str) -> Column:
    return F.expr(hash_id_sql(*parts))


def event_id() -> Column:
    """Id of one merged statement: fingerprint, source and start of the window."""
    start = "cast(unix_micros(window_start) as string)"
    return hash_id("fingerprint", *SOURCE, start)


def row_digest(columns: list[str]) -> list[Column]:
    """Two independent 64-bit digests of a whole row (together one 128-bit row key).

    A hash passes over NULLs, so which columns are NULL is hashed as well.
    """
    nulls = [F.col(c).isNull() for c in columns]
    return [F.xxhash64(F.lit(seed), *nulls, *columns) for seed in (1, 2)]
