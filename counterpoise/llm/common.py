"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but blank, tab, newline, vertical tab, feed, return.
WORD = r"[^\x20\x09-\x0D]+"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_DEFAULT_ROWS, _TEXT_ROWS = "10000", "500"


def small_batches(spark: SparkSession) -> SparkSession:
    """Whole texts go to Python a few hundred at a time, unless the user chose a batch size."""
    if spark.conf.get(_ARROW_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ARROW_ROWS, _TEXT_ROWS)
    return spark


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 4; NULL ids have none."""
    return (F.crc32(key.cast("string").cast("binary")) % 4).cast("int")


def held_out(key: Column) -> Column:
    return F.coalesce(id_fold(key) == 2, F.lit(False))


def ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
