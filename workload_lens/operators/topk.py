"""The worst statements: union of the top k rows of every metric."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workload_lens.functions.keys import row_digest
from workload_lens.schemas import METRICS, SOURCE, WINDOW

# Above this k Spark no longer limits a ranked group before its shuffle.
_GROUP_LIMIT_MAX = 1000
_SALTS = 64


def _first_in_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, without a task that ranks a whole one.

    Spark limits the groups of each input split itself, unless ``k`` is large; then parts of
    the groups are ranked first. The rows are the same either way.
    """

    def first(rows: DataFrame, keys: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("r", rank).where(F.col("r") <= k).drop("r")

    if k > _GROUP_LIMIT_MAX:
        salt = F.pmod(row_digest(df.columns)[0], F.lit(_SALTS))
        df = first(df.withColumn("salt", salt), [*group, "salt"]).drop("salt")
    return first(df, group)


def topk_by_metric(
    snapshots: DataFrame,
    metric: str,
    k: int = 100,
    group: list[str] | None = None,
) -> DataFrame:
    """Top ``k`` rows of one metric in every window of every source, nulls first."""
    group = WINDOW + SOURCE if group is None else group
    order = [F.desc_nulls_first(metric), F.md5("query"), "userid", "dbid", "queryid"]
    return _first_in_group(snapshots, group, order, k)


def topk_union(
    snapshots: DataFrame,
    k: int | None = 100,
    metrics: list[str] = METRICS,
    group: list[str] | None = None,
) -> DataFrame:
    """Distinct union of the top ``k`` rows of each metric; ``k=None`` keeps all rows.

    One pass ranks narrow rows (group, metric, value, tie-breakers), one per metric. The
    rank predicate becomes a group limit on the map side, so at most ``k`` rows per input
    split, group and metric are shuffled, however large a single group is. The winners then
    pick their full rows by a 128-bit row digest, which spreads evenly over the tasks.
    """
    if k is None:
        return snapshots.distinct()
    group = WINDOW + SOURCE if group is None else group
    columns = snapshots.columns
    d1, d2 = row_digest(columns)
    keyed = snapshots.withColumns({"d1": d1, "d2": d2})
    narrow = keyed.select(
        *group, F.md5("query").alias("q"), "userid", "dbid", "queryid", "d1", "d2", *metrics
    )
    ids = [*group, "q", "userid", "dbid", "queryid", "d1", "d2"]
    ranked = narrow.unpivot(ids, metrics, "metric", "value")
    order = [F.desc_nulls_first("value"), "q", "userid", "dbid", "queryid", "d1", "d2"]
    winners = _first_in_group(ranked, [*group, "metric"], order, k).select("d1", "d2").distinct()
    kept = keyed.join(winners, ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
    return kept.select(columns)


def topk_union_branches(snapshots: DataFrame, k: int = 100) -> DataFrame:
    """The literal form for one poll: a branch per metric, each a take-ordered limit."""
    branches = [
        snapshots.orderBy(
            F.desc_nulls_first(m), F.md5("query"), "userid", "dbid", "queryid"
        ).limit(k)
        for m in METRICS
    ]
    return reduce(DataFrame.unionByName, branches).distinct()
