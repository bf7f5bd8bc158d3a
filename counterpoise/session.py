"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, tempfile.TemporaryDirectory] = {}


_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Per-row work on texts is heavy for its bytes: keep all cores busy on small inputs too.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans rely on, where the user has not chosen others."""
    for name, value in _SETTINGS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Hash-partitions an input with fewer splits than cores; leaves any larger one alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *key)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode, where driver and tasks share one disk; it
    goes away with the Python process.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/") + "/counterpoise"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.TemporaryDirectory(prefix="counterpoise-")
    return _scratch[app].name


def spool(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared scratch area and read it back.

    Used where a result feeds several jobs.  Unlike a cache it survives lost executors
    without recomputation, cuts the lineage, and later passes read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """``df`` written once to the shared scratch area in buckets of ``column``: joins and groups
    by it do not move the rows any more.

    The catalog holds the table only until it is known to the returned plan.
    """
    spark = df.sparkSession
    name = f"counterpoise_{uuid.uuid4().hex}"
    least = spark.sparkContext.defaultParallelism
    n = min(100_000, max(least, df.rdd.getNumPartitions() if buckets is None else buckets))
    path = f"{scratch_dir(spark)}/{name}"
    df.write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  resolves the plan
    spark.sql(f"DROP TABLE {name}")
    return table
