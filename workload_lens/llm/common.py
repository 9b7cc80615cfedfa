"""What the operators share: the folder for intermediate tables, words, and row identity."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word of the decontamination contract: runs of ASCII digits, lower-case ASCII letters and non-ASCII characters.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words while their case is as in the text.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


#: Rows that a task turns into Python objects at a time.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones: what is made of one at a time stays in the memory of a worker that is used again."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def plain_words(text: Column) -> Column:
    """The array of words of a text; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))


def cased_words(text: Column) -> Column:
    """The words of ``plain_words`` in the case of the text, at a fraction of the cost; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def lowered(word: Column) -> Column:
    """As ``ascii_lower``; for words, most of which are ASCII and need no look at each character."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the whole cluster sees.

    Only where the session has no such setting, as in tests, a folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        base = tempfile.mkdtemp(prefix="workload-lens-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> list[Column]:
    """Two digests that tell rows apart by the given columns; nulls count, and so does their place."""
    marked = []
    for c in columns:
        marked += [F.col(c).isNull(), F.col(c)]
    return [F.xxhash64(F.lit(1), *marked).alias("key_a"), F.xxhash64(F.lit(2), *marked).alias("key_b")]
