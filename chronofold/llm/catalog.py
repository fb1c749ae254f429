"""The queries opN_<name> of the training-data operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embed_dedup, hamming_search, kd_shard, language_id, mixing, packing, periodic, pii, simhash, site_style, toxicity
from .common import fold, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    toxic, ordinary, prior = toxicity.training_texts(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1, "doc_id", "text", "toxic")
    out = toxicity.score(docs, toxicity.fit(toxic, ordinary, prior), threshold=0.7)
    return out.withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False))).select("doc_id", "held_out", "score", "predicted", "toxic_windows")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    masks = language_id.fit(docs, fold("doc_id", 4) != 2)
    out = language_id.identify(docs, masks)
    return out.withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming_search.sign_code("embedding").alias("code"))
    return hamming_search.top_k(codes, codes.where("id % 50 = 0"), k=10).withColumnRenamed("id", "vec_id")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, limit=4)


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shard.shard(table(spark, sf_dir, "documents"), shards=40)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"), plant=True)


def queries() -> dict:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_toxicity, op3_language_id, op4_hamming_topk, op5_simhash_dedup,
                                    op6_kd_sharding, op7_pii, op8_html_extraction, op9_packing, op10_mixing,
                                    op11_bpe_round_trip, op12_source_divergence, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op4_hamming_topk": hamming_search.ORACLE, "op10_mixing": mixing.ORACLE, "op12_source_divergence": divergence.ORACLE}
