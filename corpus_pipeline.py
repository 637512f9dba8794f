"""A training corpus from raw documents, in five stages.

Each stage takes all documents that its predecessor kept and returns the columns of
documents; the last adds slot and shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, mix, neardup, quality, scratch, shard

#: The least score of a document that the first stage keeps.
QUALITY = 0.3


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels.where(quality.remainder(F.col("doc_id"), 5) != 0))
    free = "_score"
    while free in docs.columns:
        free += "_"
    own = docs.withColumnRenamed("score", free)
    kept = quality.score_documents(own, model).where(F.col("score") >= QUALITY).drop("score")
    return kept.withColumnRenamed(free, "score").select(*(f"`{c}`" for c in docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8)."""
    return neardup.deduplicate(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much of the benchmark in them."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents at their sources' target weights; some come more than once."""
    return mix.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot and shard."""
    return shard.assign_shards(docs)


STAGES = [("quality", good), ("near-dedup", distinct), ("decontamination", clean), ("mixing", mixed), ("sharding", sharded)]
#: A classifier and sketches have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, each on a written table of what the last one kept; that
    table and those that a stage made on its way go when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        at = scratch.mark()
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        kept = scratch.table(out, name)
        scratch.drop_since(at, kept)
        scratch.drop(docs)
        docs = kept
    return docs
