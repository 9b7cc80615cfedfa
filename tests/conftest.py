import datetime as dt
import itertools
import os
import sys

import pytest

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workload_lens.schemas import METRICS, SNAPSHOT  # noqa: E402
from workload_lens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        spark__master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def make_snapshots(spark):
    """Snapshot rows from dicts; what is left out gets a plain default."""
    numbers = itertools.count(1)

    def make(rows):
        full = []
        for row in rows:
            day = row.pop("day", 1)
            start = dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc)
            values = {
                "window_start": start,
                "window_end": start + dt.timedelta(days=1),
                "project": "shop",
                "environment": "production",
                "cluster": "c1",
                "role": "primary",
                "fqdn": "db.example",
                "userid": 10,
                "dbid": 1,
                "queryid": next(numbers),
                "query": "select 1",
                **{m: 1.0 for m in METRICS},
                **row,
            }
            full.append(tuple(values[f.name] for f in SNAPSHOT.fields))
        return spark.createDataFrame(full, SNAPSHOT)

    return make
