"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.llm.filter_audit import filter_audit
from thermaline.llm.importance_resampling import resampled
from thermaline.llm.lpt_shards import lpt_shards
from thermaline.llm.mtree import top_inner_products
from thermaline.llm.phrase_mining import collocations
from thermaline.llm.secret_ownership import secrets
from thermaline.llm.spaced_seeds import contaminated
from thermaline.llm.suffix_dedup import remove_repeats
from thermaline.llm.superminhash import near_duplicates
from thermaline.llm.temperature_mix import mixed
from thermaline.llm.token_counts import token_counts
from thermaline.llm.toxicity_kernel import toxicity
from thermaline.llm.url_boosting import filtered_urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100)


def superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards(table(spark, sf_dir, "documents"), shards=24)


def temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, sf_dir, "documents"), vocabulary, limit=1024)


def secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is the owner of its text, the part of a source in one language a repository."""
    return secrets(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))


def mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in 64ths, rounded down; vectors with null or non-finite components take no part."""
    infinite = F.lit(float("inf"))
    whole = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite)
    )
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.when(whole, scaled).alias("v"))
    return top_inner_products(vectors, F.col("vec_id") % 20 == 0, k=20)


def url_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_urls(table(spark, sf_dir, "pages"))


def string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents whose id has a crc32 divisible by 5 are held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), held_out)


def filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def dynamic_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000)


def registered() -> dict[str, Query]:
    return {
        "op1_importance_resampling": importance_resampling,
        "op2_spaced_seeds": spaced_seeds,
        "op3_suffix_dedup": suffix_dedup,
        "op4_lpt_shards": shards,
        "op5_superminhash": superminhash,
        "op6_temperature_mix": temperature_mix,
        "op7_token_counts": tokens,
        "op8_secret_ownership": secret_ownership,
        "op9_mtree_search": mtree_search,
        "op10_url_boosting": url_boosting,
        "op11_string_kernel": string_kernel_toxicity,
        "op12_filter_orders": filter_orders,
        "op13_dynamic_itemsets": dynamic_itemsets,
    }
