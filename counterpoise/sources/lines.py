"""Readers and writers of the line layouts.

=========  =====================================  =========================
layout     fields                                 result columns
=========  =====================================  =========================
comma      id,sentiment,text                      id, sentiment, text
five_col   c0,c1,c2,text,label                    id, c0, c1, c2, text, label
tsv4       c0 <TAB> sentiment <TAB> c2 <TAB> text id, c0, sentiment, c2, text
=========  =====================================  =========================

A comma inside the text ends it, as in any plain comma split.  ``id`` is the first field when
that is a number and a hash of it otherwise; it need not be unique.

Lines that do not fit come along in the same pass: as rows with ``_corrupt_record``
(``tagged_lines``), or as numbers in an ``Observation`` (``parse_lines``).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LAYOUTS = ("comma", "five_col", "tsv4")


def _row_id(c0: Column) -> Column:
    return F.coalesce(c0.try_cast("bigint"), F.xxhash64(c0))


def _fields(layout: str) -> dict[str, Column]:
    value = F.col("value")
    if layout == "comma":
        parts = F.split(value, ",")
        return {
            "id": _row_id(F.get(parts, F.lit(0))),
            "sentiment": F.get(parts, F.lit(1)),
            "text": F.get(parts, F.lit(2)),
        }
    if layout == "five_col":
        parts = F.split(value, ",")
        return {
            "id": _row_id(F.get(parts, F.lit(0))),
            "c0": F.get(parts, F.lit(0)),
            "c1": F.get(parts, F.lit(1)),
            "c2": F.get(parts, F.lit(2)),
            "text": F.get(parts, F.lit(3)),
            "label": F.get(parts, F.lit(4)),
        }
    if layout == "tsv4":
        parts = F.split(value, "\t")
        return {
            "id": _row_id(F.get(parts, F.lit(0))),
            "c0": F.get(parts, F.lit(0)),
            "sentiment": F.get(parts, F.lit(1)),
            "c2": F.get(parts, F.lit(2)),
            "text": F.get(parts, F.lit(3)),
        }
    raise ValueError(f"unknown layout {layout!r}, expected one of {LAYOUTS}")


CORRUPT = "_corrupt_record"


def tagged_lines(lines: DataFrame, layout: str = "comma") -> DataFrame:
    """All lines of ``lines(value)``: typed columns of the well-formed ones, the others whole in
    ``_corrupt_record``, which is NULL otherwise."""
    fields = _fields(layout)
    complete = F.lit(True)
    for c in fields.values():
        complete = complete & c.isNotNull()
    return lines.select(
        *[F.when(complete, c).alias(n) for n, c in fields.items()],
        F.when(~complete, F.coalesce("value", F.lit(""))).alias(CORRUPT),
    )


def parse_lines(
    lines: DataFrame, layout: str = "comma", observation: Observation | None = None
) -> DataFrame:
    """Typed columns of the well-formed lines of ``lines(value)``.

    ``observation`` gets ``lines`` and ``malformed``, counted while the rows are read.
    """
    if observation is None:
        fields = _fields(layout)
        parsed = lines.select(*[c.alias(n) for n, c in fields.items()])
        return parsed.dropna(subset=list(fields))
    bad = F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed")
    rows = tagged_lines(lines, layout).observe(observation, F.count(F.lit(1)).alias("lines"), bad)
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed_lines(lines: DataFrame, layout: str = "comma") -> DataFrame:
    """The lines ``parse_lines`` leaves out, as ``_corrupt_record``."""
    return tagged_lines(lines, layout).filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_corpus(
    spark: SparkSession, path: str, layout: str = "comma", observation: Observation | None = None
) -> DataFrame:
    return parse_lines(spark.read.text(path), layout, observation)


def to_lines(df: DataFrame, *columns: str, sep: str = ",") -> DataFrame:
    """Rows as separated text lines, ready for ``write.text``."""
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]).alias("value"))


def write_augmented(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    datasets: list[str] | None = None,
    run: str | None = None,
) -> str:
    """All augmented sets in one job, one folder per ``dataset``, and a manifest at the end.

    The text form has the lines ``id,sentiment,text`` for originals and generated rows alike.
    A write goes to a folder of its own (``run``, a new one by default) that no reader looks at.  When
    it has ended, one small file in ``_manifest`` names the data sets it holds, and from then on
    they replace earlier ones.  So an interrupted write leaves the former data in place, a repeated
    one replaces its own data sets only, and the files it left over are never read.

    ``datasets``: write only these.  ``run``: begin an unfinished run again.  Returns the run.
    """
    if datasets is not None:
        df = df.filter(F.col("dataset").isin(list(datasets)))
    if fmt == "text":
        line = F.concat_ws(",", F.col("src_id").cast("string"), "sentiment", "text")
        df = df.select("dataset", line.alias("value"))
    run = run or uuid.uuid4().hex
    spark = df.sparkSession
    finished = _manifests(spark, path)
    if any(m["run"] == run for m in finished):
        raise ValueError(f"run {run} is finished; its data sets are replaced by a new run")
    folder = f"{path}/run={run}"
    df.write.partitionBy("dataset").format(fmt).mode("overwrite").save(folder)
    written = spark.read.format(fmt).load(folder) if datasets is None else None
    names = datasets if written is None else [
        r["dataset"] for r in written.select("dataset").distinct().collect()  # names only
    ]
    order = 1 + max([m["order"] for m in finished], default=-1)
    entry = json.dumps({"run": run, "format": fmt, "order": order, "datasets": sorted(names)})
    one = spark.createDataFrame([(entry,)], "value string").coalesce(1)
    one.write.mode("overwrite").text(f"{path}/_manifest/{run}")
    return run


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    """One small row per finished write."""
    folder = f"{path}/_manifest"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    # a folder without _SUCCESS was not finished
    done = [s.getPath() for s in files.listStatus(where)]
    success = spark._jvm.org.apache.hadoop.fs.Path
    done = [p.toString() for p in done if files.exists(success(p, "_SUCCESS"))]
    if not done:
        return []
    return [json.loads(r["value"]) for r in spark.read.text(done).collect()]


def read_augmented(spark: SparkSession, path: str, *datasets: str) -> DataFrame:
    """The latest finished rows of the given data sets, or of all; only their folders are read."""
    latest: dict[str, dict] = {}
    for m in sorted(_manifests(spark, path), key=lambda m: (m["order"], m["run"])):
        latest |= {d: m for d in m["datasets"]}
    chosen = [d for d in sorted(latest) if not datasets or d in datasets]
    missing = set(datasets) - set(latest)
    if missing or not chosen:
        raise ValueError(f"no finished data set {sorted(missing) or 'at all'} in {path}")
    result = None
    for run in sorted({latest[d]["run"] for d in chosen}):
        own = [d for d in chosen if latest[d]["run"] == run]
        rows = spark.read.format(latest[own[0]]["format"]).load(f"{path}/run={run}")
        rows = rows.filter(F.col("dataset").cast("string").isin(own))
        result = rows if result is None else result.unionByName(rows)
    return result
