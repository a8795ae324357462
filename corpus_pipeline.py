"""From raw documents to training shards: quality, near duplicates, benchmark leaks, source mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.llm.importance_resampling import resampled
from thermaline.llm.lpt_shards import lpt_shards
from thermaline.llm.spaced_seeds import decontaminated
from thermaline.llm.superminhash import near_duplicates
from thermaline.llm.temperature_mix import mixed_documents
from thermaline.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws; the others are rejected."""
    drawn = resampled(docs, _table(spark, sf_dir, "labels")).select(F.col("doc_id").alias("drawn_id"))
    drawn = stage(drawn.distinct(), "drawn")
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["drawn_id"]), "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates: five words, 80 %."""
    gone = near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(stage(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold passages of the benchmark."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats the documents as often as the temperature mixture of the sources has them; each at least once."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot among 24 shards of nearly equal bytes; equal texts stay together."""
    return lpt_shards(docs, shards=24)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Hashed models, signatures and heaps have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
