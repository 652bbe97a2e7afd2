"""The corpus pipeline: documents through five stages, each written and read again.

Language identification drops texts without letters and texts far from every
language learned; SimHash keeps one document of each linked group; documents that
share enough of a benchmark item go; sources are mixed to their target weights,
which may repeat a document; the last stage shuffles the records into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import decontam, langid, mixing, sharding, simhash
from quillmere.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The records, all columns, with their shard and slot; where documents have columns so named, under these names with an underscore more."""
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return free(name + "_") if name in taken else name

    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    placed = sharding.shuffled(docs, F.struct("doc_id", F.xxhash64("text")), size)
    shard = F.pmod("place", F.lit(sharding.SHARDS)).cast("int").alias(free("shard"))
    return placed.select("record.*", shard, F.floor(F.col("place") / sharding.SHARDS).cast("long").alias(free("slot")))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", shards),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
