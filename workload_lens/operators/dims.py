"""Get-or-create for dimension tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workload_lens.functions.keys import hash_id
from workload_lens.functions.text import normalized_text
from workload_lens.schemas import (
    DIMENSIONS,
    EVERYWHERE_ID,
    EVERYWHERE_LABEL,
    LOGICAL_SOURCE,
    STAR,
)


def new_members(
    incoming: DataFrame, natural_key: list[str], existing: DataFrame | None = None
) -> DataFrame:
    """Members of ``incoming`` that the dimension does not have yet, with their ids.

    The id is a function of the natural key. Nothing is numbered, so nothing has to be
    sorted into one task and two jobs that race for a key agree on its id.
    """
    known = F.lit(True)
    for column in natural_key:
        known = known & F.col(column).isNotNull()
    fresh = incoming.select(*natural_key).where(known).distinct()
    if existing is not None:
        fresh = fresh.join(existing.select(*natural_key), natural_key, "left_anti")
    return fresh.select(hash_id(*natural_key).alias("id"), *natural_key)


def new_fingerprints(texts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New fingerprints with the normalized form of the text that was seen first."""
    first = F.min_by("query", F.struct("first_seen", "query")).alias("query")
    fresh = texts.where(F.col("reject_reason").isNull()).groupBy("fingerprint").agg(first)
    if existing is not None:
        fresh = fresh.join(existing.select("fingerprint"), "fingerprint", "left_anti")
    return fresh.select(
        hash_id("fingerprint").alias("id"),
        "fingerprint",
        normalized_text("query").alias("normalized"),
    )


def everywhere_source(like: DataFrame) -> DataFrame:
    """The one-row seed of the logical sources."""
    row = (EVERYWHERE_ID, *[EVERYWHERE_LABEL] * len(LOGICAL_SOURCE))
    return like.sparkSession.createDataFrame([row], STAR["logical_sources"])


def upsert_dim(table: str, existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """The dimension after ``incoming`` was seen: rows that exist stay as they are."""
    if table == "fingerprints":
        fresh = new_fingerprints(incoming, existing)
    else:
        fresh = new_members(incoming, DIMENSIONS[table], existing)
    if existing is None and table == "logical_sources":
        existing = everywhere_source(incoming)
    return fresh if existing is None else existing.select(*fresh.columns).unionByName(fresh)
