"""From raw documents to sharded training data in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result as
Parquet and reads it again for the next stage.

* quality: documents with a calibrated score under 0.7 go; a NULL id is never a labelled row.
* near_duplicates: SimHash fingerprints of three-word shingles are linked at 3 or fewer differing
  bits; of every component one row stays, with the smallest doc_id, NULL after all others.
* decontaminate: documents with a verified test item go.
* mix: every document as often as the mix takes it, whole documents only.
* shard: adds vslot and shard.

Every stage but the last returns exactly the columns of its input, whatever their names; the last
replaces columns named vslot or shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpoise.llm import decontaminate, mixing, quality, sharding, simhash
from counterpoise.llm.common import read, small_batches, word_count
from counterpoise.session import spool

ACCEPT = 0.7
SHARDS = 8


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.fit(quality.stats_table(docs), read(spark, sf_dir, "labels"))
    return docs.filter(quality.quality_score(model, F.col("text")) >= ACCEPT)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = decontaminate.with_leaks(rows, read(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select("row.*")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = word_count(F.col("text")).alias("size")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", size)
    return mixing.materialise(mixing.mix(rows, size="size"), ["row.*"])


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.col("text")
    sized = docs.select(
        sharding.text_size(text).alias("size"),
        sharding.virtual_slot(F.col("doc_id"), text).alias("vslot"),
    )
    slot_map = spool(sharding.first_map(sharding.slot_bytes(sized), SHARDS), "slot-map")
    return sharding.assign(docs, slot_map)


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("shard", stage_shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Trained models, fingerprint hashes and the subset sums have no SQL form; see tests/llm.
ORACLE_SQL = None
