"""From raw documents to packed training batches, a stage at a time.

Stages take and return whole rows of ``documents``, whatever further columns it has and whatever they are
called. Repeated rows count as rows of their own until near-dedup, which leaves one of each id that it keeps; rows without an id
pass there. An empty table passes through all stages and gives no packed row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from likeness.llm import decontaminate, mixing, packing, quality, simhash
from likeness.llm.common import shared_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: a score of one half or more, ties included.

    Null and empty texts score as the share of good labels; without labels of both kinds all score one half and stay.
    """
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id.

    Null and empty texts, and all without words, are copies of each other.
    """
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs. Null and empty texts stay, and all does without items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order. Null and empty texts have no words and are not taken; a null source is one."""
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per packed row of token ids, with the digest of its ids as they stand in the shard. Null and empty texts have none."""
    return packing.checked(*packing.pack(docs))


STAGES = [
    ("quality classifier", keep_good), ("near-dedup", drop_copies), ("decontamination", drop_leaks), ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: The classifier's dictionaries and the hashes have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
